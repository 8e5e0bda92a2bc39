import hashlib
import math
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from qapulse.functions.sample_size import required_sample_size
from qapulse.operators import domains, metrics, sampling, topics, validate
from qapulse.plans.reports import validation_report
from checks.star_posts import star_posts
from qapulse.sources.xml_dump import with_year_month

START = date(2024, 1, 1)


def asked(*dates):
    return [{"Id": i, "PostTypeId": 1, "CreationDate": d} for i, d in enumerate(dates, 1)]


def test_summaries(spark, make_posts, tmp_path):
    days = [datetime(2024, 6, 3, 4), datetime(2024, 8, 30), datetime(2024, 6, 28, 19), datetime(2024, 9, 9), datetime(2024, 8, 1)]
    posts = with_year_month(make_posts(*asked(*days)), "CreationDate")
    row = validate.summarize_table(posts, "posts").first()
    assert (row["table"], row["row_count"], row["partitions"]) == ("posts", 5, 3)
    assert (row["first_date"], row["last_date"]) == (min(days), max(days))
    assert validate.partition_count(posts).first()[0] == 3
    tags = with_year_month(spark.createDataFrame([(1,), (2,)], "Id int"), None)
    flat = validate.summarize_table(tags, "tags", has_dates=False).first()
    assert (flat["row_count"], flat["partitions"], flat["first_date"], flat["last_date"]) == (2, 1, None, None)
    tables = {**dict.fromkeys(validate.DATED_TABLES, posts), "tags": tags}
    files = validation_report(spark, tables, str(tmp_path), START)
    summary = spark.read.option("header", True).csv(files["data_validation.csv"])
    assert {r["table"] for r in summary.collect()} == {"posts", "users", "comments", "postlinks", "tags"}


@pytest.mark.parametrize(
    "start, dates, counts",
    [
        (date(2024, 6, 1), [datetime(2024, 6, 3, 4), datetime(2024, 6, 28, 19), datetime(2024, 6, 30), datetime(2024, 7, 31, 23)], {"2024-06": 3, "2024-07": 1}),
        (date(2023, 11, 1), [datetime(2023, 11, 8), datetime(2024, 2, 17)], {"2023-11": 1, "2023-12": 0, "2024-01": 0, "2024-02": 1}),
        # a window opening inside a month starts at the next month
        (date(2023, 12, 15), [datetime(2023, 12, 20), datetime(2024, 2, 1)], {"2024-01": 0, "2024-02": 1}),
        (date(2023, 12, 15), [datetime(2023, 12, 20)], {}),
        (date(2024, 1, 1), [datetime(2020, 1, 1)], {}),
    ],
)
def test_monthly_series_is_gap_checked(make_posts, start, dates, counts):
    got = validate.questions_per_month(make_posts(*asked(*dates)), start)
    assert [(r["year_month"], r["question_count"], r["is_gap"]) for r in got.collect()] == [
        (m, n, n == 0) for m, n in counts.items()
    ]
    assert validate.gap_summary(got).first()["gaps"] == sum(n == 0 for n in counts.values())


def test_published_sample_caps(spark):
    n = spark.createDataFrame([(186_478,), (1,), (2033,)], "n bigint")
    for k, cap in ((9, 4686), (6, 4252)):
        got = [r[0] for r in n.select(required_sample_size(F.col("n"), power=0.95, n_categories=k)).collect()]
        assert got[0] == cap
        assert got[1] == 1 and got[2] <= 2033


def brute_cap(populations, k):
    z = {9: 2.7729212946086634, 6: 2.638257273476751}[k]
    raw = max(math.ceil(((1.959963984540054 + 1.6448536269514722) / 0.2) ** 2), math.ceil(z**2 * 0.25 / 0.02**2))
    return max(min(math.ceil(raw * n / (raw + n - 1)), n) for n in populations)


def expected_sample(rows, k):
    months = defaultdict(list)
    for r in rows:
        months[r["CreationDate"].strftime("%Y-%m")].append(r["Id"])
    cap = brute_cap([len(v) for v in months.values()], k)
    return {m: sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:cap] for m, ids in months.items()}, cap


def drawn(posts, k):
    got = defaultdict(list)
    sample = sampling.stratified_monthly_sample(posts, START, ["Id"], n_categories=k)
    for r in metrics.labelled(sample).collect():
        got[r["year_month"]].append(r["Id"])
    return got


def test_sample_matches_brute_force(spark, make_posts):
    rows = asked(*[datetime(2024, 1, 1) + timedelta(minutes=40 * i) for i in range(4000)])
    expected, cap = expected_sample(rows, 9)
    got = drawn(make_posts(*rows), 9)
    assert {m: sorted(v) for m, v in got.items()} == {m: sorted(v) for m, v in expected.items()}
    assert cap < max(Counter(r["CreationDate"].strftime("%Y-%m") for r in rows).values())


def test_sample_survives_a_hot_group_of_copies(spark, make_posts):
    rows = asked(*[datetime(2024, 1, 1) + timedelta(minutes=i) for i in range(3000)])
    rows += [dict(rows[0])] * 1500
    expected, cap = expected_sample(rows, 6)
    got = drawn(make_posts(*rows).repartition(6), 6)
    assert len(got["2024-01"]) == cap
    assert Counter(got["2024-01"]) == Counter(expected["2024-01"])


def test_sample_runs_nothing_while_it_is_built(spark, make_posts):
    posts = make_posts(*asked(*[datetime(2024, 1, 1) + timedelta(minutes=i) for i in range(50)]))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "a lazy frame")
    try:
        sample = sampling.stratified_monthly_sample(posts, START, ["Id"])
        assert len(tracker.getJobIdsForGroup("building")) == 0
        assert 0 < sample.count() <= 50
        assert len(tracker.getJobIdsForGroup("building")) > 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sample_of_nothing_is_empty(make_posts):
    posts = make_posts(*asked(datetime(2020, 1, 1)))
    assert sampling.stratified_monthly_sample(posts, START).count() == 0


def test_plan_summary(spark):
    plan = sampling.sample_plan(spark.createDataFrame([(10,), (100_000,)], "n bigint"), power=0.95)
    row = sampling.sample_plan_summary(plan).first()
    assert (row["months"], row["total_population"], row["full_enumeration_months"]) == (2, 100_010, 1)
    assert row["pct_sampled"] == pytest.approx(row["total_sampled"] / 100_010 * 100)


def test_invariants_on_the_test_tables(spark):
    posts, start = star_posts(spark, "/root/testdata/sf0.001"), date(1996, 3, 15)
    per_domain = domains.domain_volume.unordered(posts, start).groupBy("year_month").agg(F.sum("question_count").alias("n"))
    volume = metrics.monthly_volume.unordered(posts, start).where("question_count > 0")
    assert volume.join(per_domain, "year_month").where("n <> question_count").count() == 0
    per_post = topics.per_post_intents(posts, start)
    distribution = topics.monthly_intent_distribution(per_post)
    sums = distribution.groupBy("year_month").agg(F.sum("fraction").alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_wide_intents_have_fixed_columns(spark):
    per_post = spark.createDataFrame(
        [("2024-01", "Errors", 1), ("2024-01", "Review", 2), ("2024-01", "Errors", 3), ("2024-02", "Review", 4)],
        "year_month string, intent string, post_id int",
    )
    first, second = topics.monthly_intent_wide(per_post).collect()
    assert (first["Errors"], first["Review"], first["Learning"]) == (2, 1, 0)
    assert first["Errors_fraction"] == pytest.approx(2 / 3)
    assert second["Errors_fraction"] == 0.0
    prepost = topics.prepost_intent_summary(per_post, date(2024, 2, 20)).collect()
    assert [(r["period"], r["intent"], r["count"]) for r in prepost] == [("post", "Review", 1), ("pre", "Errors", 2), ("pre", "Review", 1)]
