import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qapulse.functions.quantiles import DIGIT, MICROS_BITS, exact_quantiles, shifts_of

POINTS = {"median": 0.5, "p90": 0.9, "lowest": 0.0, "highest": 1.0}


def check(spark, groups, **options):
    rows = [(k, v) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(4)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", POINTS, "n", **options).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        known = [v for v in values if v is not None]
        assert got[k]["n"] == len(values)
        for name, p in POINTS.items():
            if known:
                assert got[k][name] == pytest.approx(float(np.quantile(np.array(known, dtype=float), p)), rel=1e-12)
            else:
                assert got[k][name] is None


def test_matches_numpy_over_all_shapes(spark):
    rnd = random.Random(7)
    wide = 1 << (DIGIT + 6)
    groups = (
        {
            "wide": [rnd.randrange(-wide, wide) for _ in range(501)],
            "one bucket": [rnd.randrange(1000) for _ in range(400)],
            "bucket edges": [i << DIGIT for i in range(-5, 6)] + [(1 << DIGIT) - 1],
            "single": [42],
            "two": [1, 1 << 40],
            "hot value": [7] * 3000 + [rnd.randrange(10**9) for _ in range(100)],
            "with nulls": [None, 3, None, 9, 10],
            "only nulls": [None, None],
            "whole width": [-(1 << 50), -1, 0, 1, 1 << 50, (1 << 50) + 1],
        }
    )
    check(spark, groups)
    check(spark, groups, bits=MICROS_BITS)
    check(spark, groups, bits=20)  # wider values than promised are still right


def test_many_groups_join_without_a_broadcast_hint(spark, plan_of):
    rnd = random.Random(11)
    groups = {f"g{i}": [rnd.randrange(1 << 30) for _ in range(rnd.randrange(1, 9))] for i in range(200)}
    check(spark, groups, few_groups=False)
    df = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    assert "strategy=broadcast" not in plan_of(exact_quantiles(df, ["k"], "v", {"m": 0.5}, "n", few_groups=False))
    assert "strategy=broadcast" in plan_of(exact_quantiles(df, ["k"], "v", {"m": 0.5}, "n", few_groups=True))


def test_weights_stand_for_copies(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 100, 1), ("a", 5, 2)], "k string, v bigint, w bigint")
    row = exact_quantiles(df, ["k"], "v", {"m": 0.5}, "n", weight="w").first()
    assert row["n"] == 6
    assert row["m"] == pytest.approx(np.median([1, 1, 1, 100, 5, 5]))


def test_groups_are_never_gathered_whole(spark, plan_of):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = plan_of(exact_quantiles(df, ["k"], "v", {"m": 0.5}, "n"))
    for gathering in ("percentile", "collect_list", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert gathering not in plan


def test_digits_cover_all_bits():
    assert shifts_of(64) == [52, 39, 26, 13, 0] and shifts_of(MICROS_BITS) == [39, 26, 13, 0] and shifts_of(1) == [0]


def window_inputs(df):
    """Rows that each window of a run plan got, by the operator below it that counts them."""
    counts = []

    def visit(plan):
        if plan.nodeName() == "Window":
            below = plan
            while not below.metrics().contains("shuffleRecordsWritten"):
                below = below.children().apply(0)
            counts.append(below.metrics().apply("shuffleRecordsWritten").value())
        for i in range(plan.children().size()):
            visit(plan.children().apply(i))

    df.collect()
    visit(df._jdf.queryExecution().executedPlan())
    return counts


def test_windows_see_a_digit_not_the_values(spark):
    """A wide column of 120,000 different values: no window gets more than one row per bucket of a digit and rank."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(120_000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("v"))
        rows = rows.union(spark.range(60_000).select(F.lit(2).alias("k"), F.col("id").alias("v")))
        got = exact_quantiles(rows, ["k"], "v", {"m": 0.5, "p": 0.9}, "n", few_groups=True)
        counts = window_inputs(got)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    groups, ranks = 3, 4
    assert len(counts) >= len(shifts_of(64))
    # Each of the tasks below may hand on a bucket of its own: the exchange is before the window, after the last sum.
    assert max(counts) <= groups * ranks * 2**DIGIT
    assert sum(counts) < 90_000
