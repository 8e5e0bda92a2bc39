"""Tables behind the report's charts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qapulse.constants import RELEASE, START
from qapulse.functions.calendar import month_from_label, ordered_by, period_by_month_start, questions
from qapulse.functions.intents import AI_ERA, CATEGORIES
from qapulse.operators.features import FEATURES
from qapulse.operators.metrics import by_month, question_measures


def _change(pre: Column, post: Column) -> Column:
    return (post - pre) / pre * 100


@ordered_by("year_month")
def quality_band(posts: DataFrame, start: date = START) -> DataFrame:
    """Accepted rate, coverage rate and the band between them.

    Both rates come from one aggregation: they cover the same months, so nothing has to be joined.
    """
    rates = by_month(questions(posts, start), *question_measures("accepted_rate", "coverage_rate"))
    return rates.withColumn("band", F.col("coverage_rate") - F.col("accepted_rate"))


def response_hours(latency: DataFrame) -> DataFrame:
    """A latency table with median and p90 in hours; serves the overall and the per-domain tables."""
    keys = [c for c in latency.columns if c in ("year_month", "domain")]
    return latency.select(
        *keys,
        (F.col("median_seconds") / 3600).alias("median_hours"),
        (F.col("p90_seconds") / 3600).alias("p90_hours"),
    )


@ordered_by("pct_change", "feature")
def complexity_prepost_change(distributions: DataFrame, release: date = RELEASE) -> DataFrame:
    """Mean of the monthly medians before and after the release, 0 % where the former is 0."""
    period = period_by_month_start(month_from_label(F.col("year_month")), release)
    medians = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_median").alias("median")) for f in FEATURES]
    )
    long = distributions.select(period.alias("period"), F.explode(medians).alias("m")).select("period", "m.*")
    means = long.groupBy("feature").agg(
        *[F.avg(F.when(F.col("period") == p, F.col("median"))).alias(f"{p}_mean") for p in ("pre", "post")]
    )
    pre, post = F.col("pre_mean"), F.col("post_mean")
    pct = F.when(pre == 0, 0.0).otherwise(_change(F.when(pre != 0, pre), post))
    return means.withColumn("pct_change", pct)


@ordered_by("year_month", "stack_order")
def intent_stack(wide: DataFrame) -> DataFrame:
    """Cumulative fractions per month, most common intent (by mean monthly fraction) first."""
    shares = F.array(
        *[F.struct(F.lit(c).alias("intent"), F.col(f"{c}_fraction").alias("fraction")) for c in CATEGORIES]
    )
    long = wide.select("year_month", F.explode(shares).alias("s")).select("year_month", "s.*")
    by_intent = Window.partitionBy("intent")
    position = Window.partitionBy("year_month").orderBy(F.desc("mean_fraction"), "intent")
    stacked = long.withColumn("mean_fraction", F.avg("fraction").over(by_intent))
    return stacked.select(
        "year_month",
        "intent",
        F.row_number().over(position).alias("stack_order"),
        "fraction",
        F.sum("fraction").over(position.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
    )


@ordered_by("intent")
def intent_prepost_compare(prepost: DataFrame) -> DataFrame:
    """One row per intent with its fraction in both periods, missing ones 0."""
    return prepost.groupBy("intent").agg(
        *[
            F.coalesce(F.max(F.when(F.col("period") == p, F.col("fraction"))), F.lit(0.0)).alias(
                f"{p}_fraction"
            )
            for p in ("pre", "post")
        ]
    )


@ordered_by("intent", "year_month")
def intent_trends(distribution: DataFrame) -> DataFrame:
    return distribution.select("intent", "year_month", "fraction")


@ordered_by("intent", "year_month")
def ai_category_trends(distribution: DataFrame) -> DataFrame:
    return intent_trends.unordered(distribution).where(F.col("intent").isin(AI_ERA))


@ordered_by("domain", "year_month")
def domain_volume_index(volume: DataFrame) -> DataFrame:
    """Question count relative to the domain's first month (= 100)."""
    baseline = F.first("question_count").over(Window.partitionBy("domain").orderBy("year_month"))
    return (
        volume.withColumn("baseline", baseline)
        .where(F.col("baseline") != 0)
        .select(
            "domain", "year_month", "question_count",
            (F.col("question_count") / F.col("baseline") * 100).alias("volume_index"),
        )
    )


@ordered_by("pct_change_mean", "domain")
def domain_volume_change_rank(change: DataFrame) -> DataFrame:
    return change.where(F.col("domain") != "Other")


@ordered_by("f_statistic", "metric")
def chow_summary(chow: DataFrame) -> DataFrame:
    p = F.col("p_value")
    label = F.when(p >= 0.0001, F.concat(F.lit("p="), F.format_string("%.4f", p)))
    return chow.select(
        "metric", "f_statistic", "p_value",
        (p < 0.05).alias("significant"),
        label.otherwise("p<0.0001").alias("label"),
    )


@ordered_by("term", "coefficient", "metric")
def its_coefficients(its: DataFrame) -> DataFrame:
    """Level and slope changes in long form, each sorted, flagged at 5 %."""
    terms = F.array(
        *[
            F.struct(
                F.lit(term).alias("term"),
                F.col(f"{term}_coef").alias("coefficient"),
                F.col(f"{term}_p").alias("p_value"),
            )
            for term in ("level_change", "slope_change")
        ]
    )
    return its.select("metric", F.explode(terms).alias("c")).select(
        "metric", "c.*", (F.col("c.p_value") < 0.05).alias("significant")
    )


@ordered_by("metric")
def period_summary(
    series: DataFrame, stat: str = "median", tail: int = 0, release: date = RELEASE
) -> DataFrame:
    """Median or mean of the monthly values per period and its change, without the last ``tail`` months."""
    combine = {"median": F.median, "mean": F.avg}[stat]
    newest = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("month")))
    kept = series.withColumn("age", newest).where(F.col("age") > tail)
    period = period_by_month_start(F.col("month"), release)
    values = [
        combine(F.when(period == p, F.col("value"))).alias(f"{p}_value") for p in ("pre", "post")
    ]
    pre, post = F.col("pre_value"), F.col("post_value")
    return kept.groupBy("metric").agg(*values).withColumn(
        "pct_change", _change(F.when(pre != 0, pre), post)
    )
