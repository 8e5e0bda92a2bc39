"""Lexical complexity of sampled questions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qapulse.constants import START
from qapulse.functions.calendar import ordered_by
from qapulse.functions.html import body_prose, code_blocks, link_count
from qapulse.functions.tags import tag_count
from qapulse.operators.metrics import labelled
from qapulse.operators.sampling import stratified_monthly_sample

FEATURES = [
    "title_length", "body_prose_length", "code_block_count", "code_block_total_length",
    "link_count", "tag_count",
]


def with_features(rows: DataFrame, title: Column, body: Column, tags: Column) -> DataFrame:
    """Add the six features of every question; its code blocks are extracted once."""
    blocks = F.col("_blocks")
    lengths = F.aggregate(blocks, F.lit(0), lambda length, block: length + F.length(block))
    values = [
        F.length(F.coalesce(title, F.lit(""))), F.length(body_prose(body)), F.size(blocks), lengths,
        link_count(body), tag_count(tags),
    ]
    added = rows.withColumn("_blocks", code_blocks(body)).select("*", *[
        value.alias(name) for value, name in zip(values, FEATURES)
    ])
    return added.drop("_blocks")


def per_post_features(posts: DataFrame, start: date = START) -> DataFrame:
    """Features and month of every sampled question."""
    sample = stratified_monthly_sample(
        posts, start, ["Title", "Body", "Tags"], n_categories=len(FEATURES)
    )
    measured = with_features(sample, F.col("Title"), F.col("Body"), F.col("Tags"))
    return labelled(measured.select("month", *FEATURES)).select(*FEATURES, "year_month")


@ordered_by("year_month")
def feature_distributions(per_post: DataFrame) -> DataFrame:
    """Median and p90 of each feature per month.

    The sample is capped per month, so the built-in exact percentile holds a bounded number of values.
    """
    quantiles = per_post.groupBy("year_month").agg(
        *[F.percentile(name, [0.5, 0.9]).alias(name) for name in FEATURES]
    )
    return quantiles.select(
        "year_month",
        *[
            F.col(name)[i].alias(f"{name}_{suffix}")
            for name in FEATURES
            for i, suffix in enumerate(("median", "p90"))
        ],
    )


def monthly_feature_distributions(posts: DataFrame, start: date = START) -> DataFrame:
    return feature_distributions(per_post_features(posts, start))
