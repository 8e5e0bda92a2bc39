"""Intents of sampled questions and their distributions over months and periods."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qapulse.constants import RELEASE, START
from qapulse.functions.calendar import ordered_by, period_by_label
from qapulse.functions.html import body_prose
from qapulse.functions.intents import CATEGORIES, with_intent
from qapulse.operators.metrics import labelled
from qapulse.operators.sampling import stratified_monthly_sample


def per_post_intents(posts: DataFrame, start: date = START) -> DataFrame:
    """Month, intent and id of every sampled question."""
    sample = stratified_monthly_sample(
        posts, start, ["Id", "Title", "Body"], n_categories=len(CATEGORIES)
    )
    classified = with_intent(sample, F.col("Title"), body_prose(F.col("Body")))
    return labelled(classified.select("month", "intent", F.col("Id").alias("post_id")))


def _shares(counted: DataFrame, key: str) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy(key))
    return counted.withColumn("fraction", F.col("count") / total)


@ordered_by("year_month", "intent")
def monthly_intent_distribution(per_post: DataFrame) -> DataFrame:
    return _shares(per_post.groupBy("year_month", "intent").count(), "year_month")


@ordered_by("year_month")
def monthly_intent_wide(per_post: DataFrame) -> DataFrame:
    """One count and one fraction column per intent; the columns are fixed, absent intents are 0."""
    counts = [F.count_if(F.col("intent") == c).alias(c) for c in CATEGORIES]
    wide = per_post.groupBy("year_month").agg(F.count(F.lit(1)).alias("all"), *counts)
    fractions = [(F.col(c) / F.col("all")).alias(f"{c}_fraction") for c in CATEGORIES]
    return wide.select("year_month", *CATEGORIES, *fractions)


@ordered_by("period", "intent")
def prepost_intent_summary(per_post: DataFrame, release: date = RELEASE) -> DataFrame:
    """Periods are cut at the release month, which counts as post."""
    period = period_by_label(F.col("year_month"), release).alias("period")
    return _shares(per_post.groupBy(period, "intent").count(), "period")
