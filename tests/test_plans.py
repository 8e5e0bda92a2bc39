"""Plans must keep their shape at scale: pruned, pushed down, without products or Python."""

import contextlib
import io
import re
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_file
from qapulse.operators import breaks, domains, features, metrics, sampling, topics, validate
from checks.star_posts import declared, star_posts
from qapulse.sources import lake

SF = "/root/testdata/sf0.001"
START = date(1996, 3, 15)

OPERATORS = {
    **{name: f for name, (f, _) in metrics.METRICS.items()},
    **{name: f for name, (f, _) in domains.DOMAIN_METRICS.items()},
    "questions_per_month": validate.questions_per_month,
    "counters": metrics.monthly_counters,
    "sample": sampling.stratified_monthly_sample,
    "features": features.monthly_feature_distributions,
    "intents": lambda posts, start: topics.monthly_intent_wide(topics.per_post_intents(posts, start)),
    "its": lambda posts, start: breaks.its_regression(breaks.metric_series(posts, start)),
    "cusum": lambda posts, start: breaks.cusum_test(breaks.metric_series(posts, start)),
}


def executed_plan(df):
    df.collect()
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain()
    return text.getvalue().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def posts(spark):
    return star_posts(spark, SF)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    lake.write_partitioned(declared(star_posts(spark, SF), "Posts"), "Posts", root)
    return lake.read_table(spark, root, "Posts")


@pytest.mark.parametrize("name", OPERATORS)
def test_no_products_no_python_no_unbounded_gathering(posts, plan_of, name):
    plan = plan_of(OPERATORS[name](posts, START))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "collect_list", "collect_set"):
        assert bad not in plan, bad


@pytest.mark.parametrize("name", ["monthly_volume", "accepted_rate", "time_to_first_answer", "domain_volume", "sample"])
def test_month_partitions_are_pruned(stored, plan_of, name):
    plan = plan_of(OPERATORS[name](stored, START))
    assert re.search(r"PartitionFilters: \[[^]]*year_month#\d+ >= 1996-03", plan)
    # long filter lists are cut off in the printed plan
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(C", plan)


def test_pruning_keeps_the_result(posts, stored):
    for name in ("monthly_volume", "time_to_first_answer", "domain_volume"):
        assert OPERATORS[name](stored, START).collect() == OPERATORS[name](posts, START).collect()


def test_metrics_read_only_their_columns(stored, plan_of):
    plan = plan_of(metrics.monthly_volume(stored, START))
    assert "ReadSchema: struct<PostTypeId:int,CreationDate:timestamp_ntz>" in plan
    assert "Body" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("threshold", ["-1", "10m"])
@pytest.mark.parametrize("name, joined", [
    ("time_to_first_answer", r"Join \[Id#"), ("time_to_acceptance", r"Join \[AcceptedAnswerId#"), ("domain_response_time", r"Join \[Id#"),
])
def test_latency_rows_are_joined_once(spark, posts, name, joined, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = executed_plan(OPERATORS[name](posts, START))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(joined, plan)) == 1
    assert plan.count("FileScan parquet") == plan.count("ReadSchema") <= 3  # questions, answers of either table
    assert plan.count("ReusedExchange") >= 1


def test_only_candidates_carry_text_into_the_sample_shuffle(posts):
    plan = executed_plan(sampling.stratified_monthly_sample(posts, START))
    join, shuffle = plan.index("BroadcastHashJoin"), plan.index("hashpartitioning(month#")
    assert shuffle < join  # printed top down: the prefix filter is below the text shuffle


def test_a_hot_accepted_answer_is_split(spark, make_posts):
    """A third of the questions accept one answer: the join must not leave them to one task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20kb",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        question = spark.range(0, 30_000, 1, 6).select(
            F.col("id").alias("Id"), F.lit(1).alias("PostTypeId"),
            F.when(F.col("id") % 3 == 0, F.lit(10**6)).otherwise(F.col("id") + 10**6).alias("AcceptedAnswerId"),
            F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("CreationDate"),
        )
        answer = spark.range(10**6, 10**6 + 30_000, 1, 6).select(
            F.col("id").alias("Id"), F.lit(2).alias("PostTypeId"), F.lit(None).cast("bigint").alias("AcceptedAnswerId"),
            F.lit("2024-03-01").cast("timestamp_ntz").alias("CreationDate"),
        )
        result = metrics.monthly_time_to_acceptance(question.unionByName(answer), date(2024, 1, 1))
        plan = executed_plan(result)
        assert "skew=true" in plan
        row = result.first()
        assert row["accepted_count"] == 30_000
        waits = [60 * 86400 - i for i in range(30_000)]
        assert row["median_seconds"] == pytest.approx(sum(waits) / len(waits))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_entry_and_registry(spark):
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())
    result = entry_file.entry(spark)
    assert result.columns == ["year_month", "answered_count", "median_seconds", "p90_seconds"]
    assert result.count() == 66


CHECKED = [
    "coerce_rows", "with_year_month", "run_query", "questions_slice", "summarize_table", "questions_per_month",
    "monthly_counters", "monthly_time_to_first_answer", "monthly_time_to_acceptance", "domain_response_time",
    "domain_prepost_summary", "domain_volume_change", "required_sample_size", "stratified_monthly_sample",
    "body_prose", "code_blocks", "per_post_features", "per_post_intents", "its_regression_many", "chow_test_many",
]


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in ("orders", "lineitem", "events", "part", "pages", "customer"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, database, name):
    result = entry_file.queries()[name](spark, SF)
    cursor = database.execute(entry_file.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(result.columns)
    expected = sorted((str(row) for row in cursor.fetchall()))
    assert sorted(str(tuple(row[c] for c in names)) for row in result.collect()) == expected


@pytest.mark.parametrize("name, column", [("body_prose", "odd_prose"), ("code_blocks", "odd_blocks"), ("classify_intent", "odd_intent")])
def test_every_row_has_its_odd_body_worked_on(spark, tmp_path, name, column):
    spark.sql("SELECT * FROM VALUES (1L, '<p>a</p>'), (2L, NULL), (NULL, '<p>b</p>') AS t(page_id, html)").write.parquet(f"{tmp_path}/pages.parquet")
    for table in ("orders", "lineitem"):
        rows = spark.read.parquet(f"{SF}/{table}.parquet").limit(40)
        key = F.col(f"{table[0]}_orderkey")
        rows.withColumn(f"{table[0]}_orderkey", F.when(key % 5 != 0, key)).write.parquet(f"{tmp_path}/{table}.parquet")
    result = entry_file.queries()[name](spark, str(tmp_path))
    connection = duckdb.connect()
    for table in ("pages", "orders", "lineitem"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    cursor = connection.execute(entry_file.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert column in names and sorted(names) == sorted(result.columns)
    expected = sorted(str(row) for row in cursor.fetchall())
    assert sorted(str(tuple(row[c] for c in names)) for row in result.collect()) == expected


def test_a_body_is_worked_on_once(spark):
    """Repeated parts of a plan cost hundreds of microseconds a row: bodies, their searches and the names of references."""
    plan = entry_file.queries()["code_blocks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("<p>it isn") <= 2  # posts are a union of two
    assert 1 <= plan.count("regexp_extract(") <= 4
    assert "str_to_map" not in plan and "from_json" not in plan
