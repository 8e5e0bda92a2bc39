"""Per-table summaries and the gap-checked monthly question series."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qapulse.constants import START
from qapulse.functions.calendar import month_label, month_of, ordered_by, questions
from qapulse.schemas import INGEST_ORDER
from qapulse.sources import footers, lake

DATED_TABLES = ["posts", "users", "comments", "postlinks"]
FLAT_TABLES = ["tags"]


def summarize_table(rows: DataFrame, table: str, has_dates: bool = True) -> DataFrame:
    """One row: row count, number of partitions, first and last creation date."""
    if has_dates:
        first, last = F.min("CreationDate"), F.max("CreationDate")
    else:
        first = last = F.first(F.lit(None).cast("timestamp_ntz"))
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("year_month").alias("partitions"),
        first.alias("first_date"),
        last.alias("last_date"),
    ).select(F.lit(table).alias("table"), "row_count", "partitions", "first_date", "last_date")


def summarize_stored(spark: SparkSession, root: str, table: str, has_dates: bool = True) -> DataFrame:
    """:func:`summarize_table` of a table of the lake. Rows and months come from file footers, the first and last date from
    the first and last month alone, as a month holds only its own dates."""
    months = {r["year_month"]: r["n"] for r in footers.partition_rows(spark, lake.table_path(root, table)).collect() if r["n"]}
    dated = sorted(set(months) - {"all", "unknown"})
    rows = lake.read_table(spark, root, table).select("CreationDate", "year_month") if has_dates else None
    if rows is None:
        bounds = spark.range(1).agg(*(F.first(F.lit(None).cast("timestamp_ntz")).alias(c) for c in ("first_date", "last_date")))
    else:
        if all(len(m) == 7 for m in dated):  # labels of four-digit years sort as their dates do
            rows = rows.where(F.col("year_month").isin(dated[:1] + dated[-1:]))
        bounds = rows.agg(F.min("CreationDate").alias("first_date"), F.max("CreationDate").alias("last_date"))
    counts = F.lit(sum(months.values())).cast("bigint").alias("row_count"), F.lit(len(months)).cast("bigint").alias("partitions")
    return bounds.select(F.lit(table.lower()).alias("table"), *counts, "first_date", "last_date")


def stored_summary(spark: SparkSession, root: str) -> DataFrame:
    """:func:`validation_summary` of a lake, almost without reading it."""
    parts = [summarize_stored(spark, root, t, t.lower() in DATED_TABLES) for t in INGEST_ORDER]
    return reduce(DataFrame.unionByName, parts)


def partition_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("year_month").alias("partitions"))


@ordered_by("year_month")
def questions_per_month(posts: DataFrame, start: date = START) -> DataFrame:
    """Questions per month, with a zero row and ``is_gap`` for every month without any.

    The spine runs from the first month starting on or after ``start`` to the latest observed month;
    without questions the result is empty.
    """
    counts = (
        questions(posts, start)
        .groupBy(month_of(F.col("CreationDate")).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    next_month = (start.replace(day=1) + timedelta(days=31)).replace(day=1)
    first = F.lit(start if start.day == 1 else next_month)
    last = F.max("month")
    spine = counts.agg(
        F.when(last >= first, F.sequence(first, last, F.expr("interval 1 month"))).alias("months")
    ).select(F.explode("months").alias("month"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return spine.join(counts, "month", "left").select(
        month_label(F.col("month")).alias("year_month"),
        n.alias("question_count"),
        (n == 0).alias("is_gap"),
    )


def validation_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """:func:`summarize_table` of the four dated tables and the flat one."""
    parts = [summarize_table(tables[t], t) for t in DATED_TABLES]
    parts += [summarize_table(tables[t], t, has_dates=False) for t in FLAT_TABLES]
    return reduce(DataFrame.unionByName, parts)


def gap_summary(monthly: DataFrame) -> DataFrame:
    return monthly.agg(
        F.count(F.lit(1)).alias("months"), F.count_if(F.col("is_gap")).alias("gaps")
    )
