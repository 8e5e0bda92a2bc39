"""Structural-break statistics over any number of monthly series.

A series frame holds ``metric, month, value``: at most one row per calendar month and metric. All
series are processed together, partitioned by metric; the fits are closed forms over regression
aggregates, so no series is gathered into a Python task.
"""

from __future__ import annotations

import logging
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qapulse.constants import RELEASE, START
from qapulse.functions.calendar import month_from_label, month_label, ordered_by
from qapulse.functions.student import f_tail_two, t_two_sided
from qapulse.operators.metrics import (
    monthly_counters,
    monthly_time_to_acceptance,
    monthly_time_to_first_answer,
)
from qapulse.sources import storage

log = logging.getLogger(__name__)

# The published label of each tested column.
COUNTER_SERIES = {
    "question_count": "Question Volume",
    "answer_count": "Answer Volume",
    "distinct_askers": "Active Askers",
    "accepted_rate": "Accepted Rate",
    "coverage_rate": "Answer Coverage",
    "mean_score": "Mean Score",
    "mean_comments": "Mean Comments",
}
FIRST_ANSWER_SERIES = {"median_seconds": "Time to First Answer (med)"}
ACCEPTANCE_SERIES = {"median_seconds": "Time to Acceptance (med)"}

# Below this a residual variation counts as none; CRITICAL is the 5 % CUSUM bound over sqrt(n).
_NOTHING = 1e-15
_CRITICAL = 0.948


def to_series(monthly: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Columns of a monthly frame as long series; NULL values are dropped."""
    pairs = [
        F.struct(F.lit(label).alias("metric"), F.col(column).cast("double").alias("value"))
        for column, label in labels.items()
    ]
    return (
        monthly.select(month_from_label(F.col("year_month")).alias("month"), F.explode(F.array(*pairs)).alias("s"))
        .select("s.metric", "month", "s.value")
        .where(F.col("value").isNotNull())
    )


def metric_series(posts: DataFrame, start: date = START) -> DataFrame:
    """The nine published series: seven from one pass over the posts, two from the latency joins."""
    parts = [
        to_series(monthly_counters(posts, start), COUNTER_SERIES),
        to_series(monthly_time_to_first_answer.unordered(posts, start), FIRST_ANSWER_SERIES),
        to_series(monthly_time_to_acceptance.unordered(posts, start), ACCEPTANCE_SERIES),
    ]
    return reduce(DataFrame.unionByName, parts)


#: The stored monthly tables and which of their columns are tested.
STORED_SERIES = {
    "monthly_volume": {c: COUNTER_SERIES[c] for c in ("question_count", "answer_count")},
    "active_askers": {"distinct_askers": COUNTER_SERIES["distinct_askers"]},
    "accepted_rate": {"accepted_rate": COUNTER_SERIES["accepted_rate"]},
    "answer_coverage": {"coverage_rate": COUNTER_SERIES["coverage_rate"]},
    "time_to_first_answer": FIRST_ANSWER_SERIES,
    "time_to_acceptance": ACCEPTANCE_SERIES,
    "engagement": {c: COUNTER_SERIES[c] for c in ("mean_score", "mean_comments")},
}


def stored_series(spark: SparkSession, directory: str) -> DataFrame:
    """The published series from monthly tables stored before, so that tests can be redone without the posts.

    A table is ``name.csv`` (a file, or a folder of parts, with headers) or ``name.parquet``; absent ones are skipped with a warning. None at all
    is an error. Columns are read by name; one that a table lacks fails the query.
    """
    parts = []
    for name, labels in STORED_SERIES.items():
        stored = f"{directory.rstrip('/')}/{name}"
        if storage.exists(spark, f"{stored}.csv"):
            monthly = spark.read.option("header", True).csv(f"{stored}.csv")
        elif storage.exists(spark, f"{stored}.parquet"):
            monthly = spark.read.parquet(f"{stored}.parquet")
        else:
            log.warning("Skipping %s: no such table in %s", ", ".join(labels.values()), directory)
            continue
        parts.append(to_series(monthly, labels))
    if not parts:
        raise RuntimeError(f"No monthly tables in {directory}")
    return reduce(DataFrame.unionByName, parts)


def _whole():
    return Window.partitionBy("metric")


def _indexed(series: DataFrame, release: date) -> DataFrame:
    """Position ``t``, length ``n`` and breakpoint position ``bp`` of every observation.

    The breakpoint is the first month starting at or after the release, kept inside ``[1, n - 2]``.
    """
    order = _whole().orderBy("month")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.count_if(F.col("month") < F.lit(release)).over(whole)
    indexed = series.select(
        "metric",
        "month",
        F.col("value").alias("y"),
        (F.row_number().over(order) - 1).cast("double").alias("t"),
        F.count(F.lit(1)).over(whole).alias("n"),
        before.alias("before"),
    )
    return indexed.select(
        "metric", "month", "y", "t", "n",
        F.greatest(F.lit(1), F.least(F.col("before"), F.col("n") - 2)).alias("bp"),
    )


@ordered_by("metric")
def breakpoint_index(series: DataFrame, release: date = RELEASE) -> DataFrame:
    return _fits(series, release).select(
        "metric", "n", F.col("bp").alias("breakpoint_index"), "breakpoint_month"
    )


def _segment(name: str, inside: Column | None) -> list[Column]:
    y = F.col("y")
    t = F.col("t") if inside is None else F.when(inside, F.col("t"))
    statistics = {
        "n": F.regr_count(y, t), "tm": F.regr_avgx(y, t), "ym": F.regr_avgy(y, t),
        "sxx": F.regr_sxx(y, t), "sxy": F.regr_sxy(y, t), "syy": F.regr_syy(y, t),
    }
    return [column.alias(f"{key}_{name}") for key, column in statistics.items()]


def _slope(s: str) -> Column:
    return F.col(f"sxy_{s}") / F.nullif(F.col(f"sxx_{s}"), F.lit(0.0))


def _level(s: str, at: Column) -> Column:
    return F.col(f"ym_{s}") + _slope(s) * (at - F.col(f"tm_{s}"))


def _rss(s: str) -> Column:
    # A segment of one point leaves no residual.
    fitted = F.coalesce(_slope(s) * F.col(f"sxy_{s}"), F.lit(0.0))
    return F.greatest(F.col(f"syy_{s}") - fitted, F.lit(0.0))


def _fits(series: DataFrame, release: date) -> DataFrame:
    """One row per metric: regression statistics of the whole series and of both segments."""
    first, second = F.col("t") < F.col("bp"), F.col("t") >= F.col("bp")
    return (
        _indexed(series, release)
        .groupBy("metric", "n", "bp")
        .agg(
            *_segment("all", None), *_segment("pre", first), *_segment("post", second),
            month_label(F.min(F.when(second, F.col("month")))).alias("breakpoint_month"),
        )
        .withColumn("df", F.col("n") - 4)
        .withColumn("rss", _rss("pre") + _rss("post"))
    )


@ordered_by("metric")
def chow_test(series: DataFrame, release: date = RELEASE) -> DataFrame:
    """One trend against two: F statistic and p-value per metric, NULL without residual freedom."""
    return _chow(_fits(series, release))


def _chow(fits: DataFrame) -> DataFrame:
    rss, m = F.col("rss"), F.col("df").cast("double")
    statistic = F.when(rss < _NOTHING, float("inf")).otherwise(
        ((_rss("all") - rss) / 2) / (rss / F.when(m > 0, m))
    )
    tested = fits.withColumn("f", F.when(m > 0, statistic))
    return tested.select(
        F.round("f", 4).alias("f_statistic"),
        F.round(f_tail_two(F.col("f"), F.when(m > 0, m)), 6).alias("p_value"),
        F.lit(2).alias("df_numerator"),
        F.col("df").alias("df_denominator"),
        "breakpoint_month",
        "metric",
    )


_TERMS = ["intercept", "trend", "level_change", "slope_change"]


def _its(fits: DataFrame) -> DataFrame:
    m, bp, zero = F.col("df").cast("double"), F.col("bp").cast("double"), F.lit(0.0)
    mse = F.col("rss") / F.when(m > 0, m)

    def spread(s: str) -> Column:
        return 1 / F.nullif(F.col(f"sxx_{s}"), F.lit(0.0))

    def at(s: str, where: Column) -> Column:
        return 1 / F.col(f"n_{s}") + F.pow(where - F.col(f"tm_{s}"), 2) * spread(s)

    # Coefficient and variance factor of each term, in the order of _TERMS.
    pairs = [
        (_level("pre", zero), at("pre", zero)),
        (_slope("pre"), spread("pre")),
        (_level("post", bp) - _level("pre", bp), at("pre", bp) + at("post", bp)),
        (_slope("post") - _slope("pre"), spread("pre") + spread("post")),
    ]
    estimates = F.array(
        *[F.struct(b.alias("b"), F.sqrt(mse * variance).alias("s")) for b, variance in pairs]
    )
    with_t = F.transform(
        estimates,
        lambda x: F.struct(x["b"].alias("b"), x["s"].alias("s"), (x["b"] / F.nullif(x["s"], zero)).alias("t")),
    )
    with_p = F.transform(
        "with_t",
        lambda x: F.struct(
            F.round(x["b"], 6).alias("coef"),
            F.round(x["s"], 6).alias("se"),
            F.round(x["t"], 4).alias("t"),
            F.round(t_two_sided(x["t"], F.when(m > 0, m)), 6).alias("p"),
        ),
    )
    total = F.col("syy_all")
    r_squared = F.when(total > _NOTHING, 1 - F.col("rss") / total).otherwise(0.0)
    return (
        fits.withColumn("with_t", with_t)
        .select("*", with_p.alias("term"), F.round(r_squared, 6).alias("r_squared"))
        .selectExpr(
            *[f"term[{i}].{x} AS {name}_{x}" for i, name in enumerate(_TERMS) for x in ("coef", "se", "t", "p")],
            "r_squared", "n AS n_obs", "breakpoint_month", "metric",
        )
    )


@ordered_by("metric")
def its_regression(series: DataFrame, release: date = RELEASE) -> DataFrame:
    """Level and slope change at the breakpoint, with standard errors, t and two-sided p.

    Standard errors, t and p are NULL without residual freedom or for a segment of one point.
    """
    return _its(_fits(series, release))


def _residual_paths(series: DataFrame, release: date) -> DataFrame:
    """Running residual sum of the common trend, and its sigma, per observation."""
    whole = _whole()
    trend = _indexed(series, release).select(
        "*",
        F.regr_slope("y", "t").over(whole).alias("slope"),
        F.regr_avgx("y", "t").over(whole).alias("tm"),
        F.regr_avgy("y", "t").over(whole).alias("ym"),
    )
    residual = F.col("y") - F.col("ym") - F.coalesce("slope", F.lit(0.0)) * (F.col("t") - F.col("tm"))
    with_residual = trend.withColumn("residual", residual)
    degrees = F.when(F.col("n") > 2, F.col("n") - 2)
    running = whole.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return with_residual.select(
        "metric", "month", "t", "n", "bp", "y",
        F.sum("residual").over(running).alias("path"),
        F.sqrt(F.sum(F.col("residual") * F.col("residual")).over(whole) / degrees).alias("sigma"),
    )


def _critical() -> Column:
    return _CRITICAL * F.sqrt(F.col("n").cast("double"))


@ordered_by("metric")
def cusum_test(series: DataFrame, release: date = RELEASE) -> DataFrame:
    """Largest absolute scaled residual sum and the first month reaching it.

    A series without residual variation gets 0, its first month, a NULL bound and no flag.
    """
    paths = _residual_paths(series, release)
    flat = F.col("sigma") < _NOTHING
    scaled = F.when(flat, 0.0).otherwise(F.abs(F.col("path")) / F.when(~flat, F.col("sigma")))
    # The first of equal peaks; an aggregate keeps the windows' partitioning and needs no second sort.
    peak = F.max_by(F.struct("scaled", "month", "sigma", "n"), F.struct("scaled", (-F.col("t")).alias("t")))
    return (
        paths.withColumn("scaled", scaled)
        .groupBy("metric")
        .agg(peak.alias("peak"))
        .select("metric", "peak.*")
        .select(
            F.round("scaled", 4).alias("cusum_max"),
            month_label(F.col("month")).alias("cusum_max_month"),
            F.when(~flat, F.round(_critical(), 4)).alias("critical_5pct"),
            F.when(flat, False).otherwise(F.col("scaled") > _critical()).alias("significant_5pct"),
            "metric",
        )
    )


@ordered_by("metric", "year_month")
def cusum_paths(series: DataFrame, release: date = RELEASE) -> DataFrame:
    """The scaled residual sum of every month with its bounds; sigma is 1 for a flat series."""
    sigma = F.when(F.col("sigma") < _NOTHING, 1.0).otherwise(F.col("sigma"))
    return _residual_paths(series, release).select(
        "metric",
        month_label(F.col("month")).alias("year_month"),
        (F.col("path") / sigma).alias("cusum"),
        _critical().alias("upper_bound"),
        (-_critical()).alias("lower_bound"),
    )


@ordered_by("metric", "year_month")
def its_fits(series: DataFrame, release: date = RELEASE) -> DataFrame:
    """Observed and fitted value of every month, with its segment.

    The interrupted regression is one line per segment, fitted by window aggregates.
    """
    segment = F.when(F.col("t") < F.col("bp"), "pre").otherwise("post")
    own = Window.partitionBy("metric", "segment")
    lines = _indexed(series, release).withColumn("segment", segment).select(
        "metric", "month", "t", "y", "segment",
        F.regr_slope("y", "t").over(own).alias("slope"),
        F.avg("t").over(own).alias("tm"),
        F.avg("y").over(own).alias("ym"),
    )
    # A segment of one point has no slope; its line passes through the point.
    fitted = F.col("ym") + F.coalesce("slope", F.lit(0.0)) * (F.col("t") - F.col("tm"))
    return lines.select(
        "metric",
        month_label(F.col("month")).alias("year_month"),
        F.col("y").alias("observed"),
        fitted.alias("fitted"),
        "segment",
    )


def structural_break_report(series: DataFrame, release: date = RELEASE) -> dict[str, DataFrame]:
    """The three test tables; pass a stored series frame so that it is computed once."""
    return {
        "chow_test": chow_test(series, release),
        "cusum_test": cusum_test(series, release),
        "its_regression": its_regression(series, release),
    }
