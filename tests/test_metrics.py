from collections import defaultdict
from datetime import date, datetime, timedelta
from random import Random

import numpy as np
import pytest

from qapulse.operators import metrics
from qapulse.plans.reports import metrics_report

START = date(2024, 1, 1)


def d(month, day=5, hour=12):
    return datetime(2024, month, day, hour)


def by_month(df):
    return {r["year_month"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def forum():
    """A made-up forum of 13 weeks: questions, answers and a few wiki posts, with gaps in every field."""
    random, posts = Random(77), []
    for number in range(1, 161):
        when = datetime(2023, 12, 20) + timedelta(minutes=random.randrange(13 * 7 * 24 * 60))
        kind = random.choice([1, 1, 1, 2, 2, 4])
        post = {"Id": number, "PostTypeId": kind, "CreationDate": when, "Score": random.randint(-4, 31)}
        if kind == 1:
            post |= {
                "OwnerUserId": random.choice([None, *range(501, 519)]),
                "AnswerCount": random.choice([None, 0, 0, 1, 4]),
                "CommentCount": random.choice([None, 0, 3, 8]),
                "AcceptedAnswerId": random.choice([None, None, random.randint(1, 200)]),
            }
        elif kind == 2:
            post["ParentId"] = random.choice([None, random.randint(1, 160)])
        posts.append(post)
    return posts


def questions_by_month(forum):
    months = defaultdict(list)
    for post in forum:
        if post["PostTypeId"] == 1 and post["CreationDate"].date() >= START:
            months[f"{post['CreationDate']:%Y-%m}"].append(post)
    return months


def check(got, expected):
    got = by_month(got)
    assert set(got) == set(expected)
    for month, values in expected.items():
        assert {k: got[month][k] for k in values} == pytest.approx(values)


def test_volume(make_posts, forum):
    expected = defaultdict(lambda: {"question_count": 0, "answer_count": 0})
    for post in forum:
        if post["CreationDate"].date() >= START:
            counts = expected[f"{post['CreationDate']:%Y-%m}"]
            counts["question_count"] += post["PostTypeId"] == 1
            counts["answer_count"] += post["PostTypeId"] == 2
    check(metrics.monthly_volume(make_posts(*forum), START), expected)
    # a month with other post types only is still a row
    wiki = make_posts({"Id": 7, "PostTypeId": 4, "CreationDate": d(9)})
    check(metrics.monthly_volume(wiki, START), {"2024-09": {"question_count": 0, "answer_count": 0}})


def test_rates_and_means(make_posts, forum):
    months = questions_by_month(forum)
    posts = make_posts(*forum)
    check(metrics.monthly_active_askers(posts, START), {
        m: {"distinct_askers": len({q["OwnerUserId"] for q in rows} - {None})} for m, rows in months.items()
    })
    check(metrics.monthly_accepted_rate(posts, START), {
        m: {"question_count": len(rows), "accepted_rate": sum(q["AcceptedAnswerId"] is not None for q in rows) / len(rows)}
        for m, rows in months.items()
    })
    check(metrics.monthly_answer_coverage(posts, START), {
        m: {"question_count": len(rows), "coverage_rate": sum((q["AnswerCount"] or 0) > 0 for q in rows) / len(rows)}
        for m, rows in months.items()
    })
    check(metrics.monthly_engagement(posts, START), {
        m: {"mean_score": sum(q["Score"] for q in rows) / len(rows), "mean_comments": sum(q["CommentCount"] or 0 for q in rows) / len(rows)}
        for m, rows in months.items()
    })


def latencies(waits):
    return {
        m: {"median_seconds": float(np.median(w)), "p90_seconds": float(np.percentile(w, 90))} for m, w in waits.items()
    }


def test_first_answer(make_posts, forum):
    waits = defaultdict(list)
    for month, rows in questions_by_month(forum).items():
        for q in rows:
            answers = [p["CreationDate"] for p in forum if p["PostTypeId"] == 2 and p["ParentId"] == q["Id"]]
            if answers:
                waits[month].append((min(answers) - q["CreationDate"]).total_seconds())
    assert any(len(w) > 2 for w in waits.values())
    check(metrics.monthly_time_to_first_answer(make_posts(*forum), START), {
        m: {"answered_count": len(waits[m]), **v} for m, v in latencies(waits).items()
    })


def test_acceptance_takes_posts_of_any_type_and_skips_dangling_ids(make_posts, forum):
    waits, dates = defaultdict(list), {p["Id"]: p["CreationDate"] for p in forum}
    for month, rows in questions_by_month(forum).items():
        for q in rows:
            if q["AcceptedAnswerId"] in dates:
                waits[month].append((dates[q["AcceptedAnswerId"]] - q["CreationDate"]).total_seconds())
    assert sum(map(len, waits.values())) > 10
    check(metrics.monthly_time_to_acceptance(make_posts(*forum), START), {
        m: {"accepted_count": len(waits[m]), **v} for m, v in latencies(waits).items()
    })


def test_first_answer_counts_copies_once_and_keeps_negative_waits(make_posts):
    question = {"Id": 1, "PostTypeId": 1, "CreationDate": d(1)}
    early = {"Id": 2, "PostTypeId": 2, "ParentId": 1, "CreationDate": d(1) - timedelta(seconds=30)}
    got = by_month(metrics.monthly_time_to_first_answer(make_posts(question, question, question, early, early), START))
    assert got["2024-01"]["answered_count"] == 1
    assert got["2024-01"]["median_seconds"] == pytest.approx(-30.0)


def test_window_applies_to_questions_only(make_posts):
    old = {"Id": 1, "PostTypeId": 1, "CreationDate": datetime(2023, 12, 31)}
    new = {"Id": 2, "PostTypeId": 1, "CreationDate": d(1)}
    before_window = {"Id": 3, "PostTypeId": 2, "ParentId": 2, "CreationDate": datetime(2023, 12, 1)}
    late = {"Id": 4, "PostTypeId": 2, "ParentId": 1, "CreationDate": d(2)}
    got = by_month(metrics.monthly_time_to_first_answer(make_posts(old, new, before_window, late), START))
    assert set(got) == {"2024-01"}
    assert got["2024-01"]["median_seconds"] < 0


def test_acceptance_counts_every_pair_of_copies(make_posts):
    question = {"Id": 1, "PostTypeId": 1, "CreationDate": d(1), "AcceptedAnswerId": 2}
    answer = {"Id": 2, "PostTypeId": 2, "CreationDate": d(1) + timedelta(seconds=5)}
    posts = make_posts(*[question] * 3, *[answer] * 2)
    assert metrics.monthly_time_to_acceptance(posts, START).first()["accepted_count"] == 6


def test_counters_agree_with_the_single_metrics(make_posts, forum):
    posts = make_posts(*forum)
    counters = by_month(metrics.monthly_counters(posts, START))
    for operator in (metrics.monthly_volume, metrics.monthly_active_askers, metrics.monthly_engagement):
        for month, row in by_month(operator(posts, START)).items():
            assert {k: counters[month][k] for k in row} == row


def test_questions_per_asker(make_posts):
    posts = make_posts(
        *[{"Id": i, "PostTypeId": 1, "OwnerUserId": o, "CreationDate": d(6)} for i, o in enumerate([31, 44, 31, 31, 44])],
        {"Id": 9, "PostTypeId": 1, "CreationDate": d(8)},
    )
    got = by_month(metrics.questions_per_asker(posts, START))
    assert got["2024-06"]["questions_per_asker"] == pytest.approx(2.5)
    assert got["2024-08"]["questions_per_asker"] is None


COLUMNS = {
    "monthly_volume.csv": ["year_month", "question_count", "answer_count"],
    "active_askers.csv": ["year_month", "distinct_askers"],
    "accepted_rate.csv": ["year_month", "question_count", "accepted_rate"],
    "answer_coverage.csv": ["year_month", "question_count", "coverage_rate"],
    "time_to_first_answer.csv": ["year_month", "answered_count", "median_seconds", "p90_seconds"],
    "time_to_acceptance.csv": ["year_month", "accepted_count", "median_seconds", "p90_seconds"],
    "engagement.csv": ["year_month", "question_count", "mean_score", "mean_comments"],
}


def test_report_writes_every_table(spark, make_posts, forum, tmp_path):
    files = metrics_report(spark, make_posts(*forum), str(tmp_path), START)
    assert set(files) == set(COLUMNS)
    for name, path in files.items():
        assert spark.read.option("header", True).csv(path).columns == COLUMNS[name]
