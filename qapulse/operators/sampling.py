"""Power-analysis-sized monthly sampling plan and the stratified sample it caps."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qapulse.constants import START
from qapulse.functions.calendar import month_of, ordered_by, questions
from qapulse.functions.sample_size import required_sample_size
from qapulse.operators.metrics import labelled

# Sampling order is the md5 of the id; this many leading hex digits form its histogram (65,536 bins).
_PREFIX = 4
# A month's last candidates are cut down in this many independent groups before they meet.
_SPREAD = 64


@ordered_by("year_month")
def monthly_populations(posts: DataFrame, start: date = START) -> DataFrame:
    return labelled(_populations(posts, start))


def _populations(posts: DataFrame, start: date) -> DataFrame:
    month = month_of(F.col("CreationDate")).alias("month")
    return questions(posts, start).groupBy(month).agg(F.count(F.lit(1)).alias("n"))


def sample_plan(populations: DataFrame, **criteria) -> DataFrame:
    """Add ``required_n`` to a frame of monthly populations ``n``."""
    return populations.withColumn("required_n", required_sample_size(F.col("n"), **criteria))


@ordered_by("year_month")
def monthly_sample_plan(posts: DataFrame, start: date = START, **criteria) -> DataFrame:
    return sample_plan(monthly_populations.unordered(posts, start), **criteria)


def sample_plan_summary(plan: DataFrame) -> DataFrame:
    sampled, population = F.sum("required_n"), F.sum("n")
    return plan.agg(
        F.count(F.lit(1)).alias("months"),
        sampled.alias("total_sampled"),
        population.alias("total_population"),
        F.coalesce(F.try_divide(sampled, population) * 100, F.lit(0.0)).alias("pct_sampled"),
        F.count_if(F.col("required_n") == F.col("n")).alias("full_enumeration_months"),
    )


def _digest(identifier: Column) -> Column:
    return F.md5(identifier.cast("string"))


def stratified_monthly_sample(
    posts: DataFrame,
    start: date = START,
    columns: Sequence[str] = ("Id", "Title", "Body", "Tags"),
    alpha: float = 0.05,
    power: float = 0.95,
    effect_size: float = 0.2,
    margin: float = 0.02,
    n_categories: int = 1,
) -> DataFrame:
    """``month`` and ``columns`` of the first ``cap`` questions of each month, ordered by md5 of the id.

    ``cap`` is the largest monthly requirement, so smaller months are enumerated in full. One pass over
    ids and dates counts each month's digest prefixes; populations, ``cap`` and the prefix at which a month's
    sample ends all follow from those counts. Only rows up to that prefix, about ``cap`` per month,
    carry their text into a shuffle. They are first ranked in ``_SPREAD`` independent groups per month, so that copies of
    one question cannot fill one task. Nothing runs until the frame is used.
    """
    keyed = questions(posts, start).withColumn("month", month_of(F.col("CreationDate")))
    prefix = F.substring(_digest(F.col("Id")), 1, _PREFIX)
    upto = Window.partitionBy("month").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    counted = keyed.groupBy("month", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    criteria = dict(alpha=alpha, power=power, effect_size=effect_size, margin=margin, n_categories=n_categories)
    # From here to the join there is one row per calendar month and prefix, then one per month: safe to broadcast.
    reached = counted.withColumn("upto", F.sum("n").over(upto))
    months = sample_plan(counted.groupBy("month").agg(F.sum("n").alias("n")), **criteria).select(
        F.col("month").alias("end_month"), F.max("required_n").over(every).alias("cap")
    )
    ends = months.join(reached, (F.col("month") == F.col("end_month")) & (F.col("upto") >= F.col("cap")), "left")
    ends = ends.groupBy("end_month", "cap").agg(F.min("prefix").alias("last_prefix"))
    rows = keyed.select(
        "month", *columns, _digest(F.col("Id")).alias("digest"), F.col("Id").alias("sample_id"),
        F.spark_partition_id().alias("part"),
    )
    candidates = rows.join(F.broadcast(ends), F.col("month") == F.col("end_month")).where(
        F.col("last_prefix").isNull()
        | (F.substring("digest", 1, _PREFIX) <= F.col("last_prefix"))
    ).withColumn("part", F.col("part") % _SPREAD)

    order = [F.col("digest"), F.col("sample_id"), F.xxhash64(*columns)]
    ranked = candidates
    for groups in (["month", "part"], ["month"]):
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        ranked = ranked.withColumn("rank", rank).where(F.col("rank") <= F.col("cap"))
    return ranked.select("month", *columns)
