"""Whole reports: shared passes, every table written as CSV."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from qapulse.constants import RELEASE, START
from qapulse.operators import breaks, counters as counters_of, domains, features, metrics, topics, validate
from qapulse.session import shared_dir
from qapulse.sources.lake import write_table_csv


def _stored(rows: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table that several outputs read to the shared scratch folder, and read it back.

    Lineage is cut by files every executor can see, so a lost executor never repeats the scan.
    """
    path = shared_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _write_all(tables: Mapping[str, DataFrame], out: str, per_post: Collection[str] = ()) -> dict[str, str]:
    """Write the tables; those of ``per_post`` have a row per post and keep their partitions."""
    return {name: write_table_csv(table, out, name, one_part=name not in per_post) for name, table in tables.items()}


def validation_report(
    spark: SparkSession, tables: Mapping[str, DataFrame], out: str, start: date = START
) -> dict[str, str]:
    return _write_all(
        {
            "data_validation.csv": validate.validation_summary(tables),
            "posts_per_month.csv": validate.questions_per_month(tables["posts"], start),
        },
        out,
    )


_SHARED_METRICS = {
    "active_askers": ["distinct_askers"],
    "accepted_rate": ["question_count", "accepted_rate"],
    "answer_coverage": ["question_count", "coverage_rate"],
    "engagement": ["question_count", "mean_score", "mean_comments"],
}


def _metric_tables(monthly: DataFrame, posts: DataFrame, start: date) -> dict[str, DataFrame]:
    asked = monthly.where("question_count > 0")
    tables = {"monthly_volume.csv": monthly.select("year_month", "question_count", "answer_count")}
    for name, (operator, file) in metrics.METRICS.items():
        if name in _SHARED_METRICS:
            tables[file] = asked.select("year_month", *_SHARED_METRICS[name])
        elif file not in tables:
            tables[file] = operator(posts, start)
    return {f: t.orderBy("year_month") for f, t in tables.items()}


def _domain_tables(by_month: DataFrame, by_period: DataFrame, posts: DataFrame, start: date, release: date) -> dict[str, DataFrame]:
    keys = ["year_month", "domain"]
    shared = by_month.orderBy(*keys)
    return {
        "domain_volume.csv": shared.select(*keys, "question_count"),
        "domain_accepted_rate.csv": shared.select(*keys, "question_count", "accepted_rate"),
        "domain_coverage.csv": shared.select(*keys, "question_count", "coverage_rate"),
        "domain_engagement.csv": shared.select(*keys, "question_count", "mean_score", "mean_comments"),
        "domain_response_time.csv": domains.domain_response_time(posts, start),
        "domain_prepost_summary.csv": by_period.orderBy("domain", "period"),
        "domain_volume_change.csv": domains.volume_change(by_month, release).orderBy("domain"),
    }


def metrics_report(
    spark: SparkSession, posts: DataFrame, out: str, start: date = START
) -> dict[str, str]:
    """All monthly metrics; the five without a join share one pass over the posts."""
    counters = _stored(metrics.monthly_counters(posts, start), "counters")
    return _write_all(_metric_tables(counters, posts, start), out)


def domain_report(
    spark: SparkSession,
    posts: DataFrame,
    out: str,
    start: date = START,
    release: date = RELEASE,
) -> dict[str, str]:
    """All domain tables; all but the response times share one pass."""
    counters = _stored(counters_of.activity_counters(posts, start, release), "domains")
    return _write_all(_domain_tables(*_by_domain(counters), posts, start, release), out)


def activity_report(
    spark: SparkSession,
    posts: DataFrame,
    out: str,
    start: date = START,
    release: date = RELEASE,
) -> dict[str, str]:
    """Both of the above: one pass over the posts gives every table that needs no join, monthly or by domain."""
    counters = _stored(counters_of.activity_counters(posts, start, release), "activity")
    monthly = counters_of.level_of(counters, "month", "year_month", "answer_count", "distinct_askers", *domains.RATES)
    tables = _metric_tables(monthly, posts, start)
    return _write_all({**tables, **_domain_tables(*_by_domain(counters), posts, start, release)}, out)


def _by_domain(counters: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        counters_of.level_of(counters, "domain", "year_month", "domain", *domains.RATES),
        counters_of.level_of(counters, "period", "domain", "period", *domains.RATES),
    )


def features_report(
    spark: SparkSession, posts: DataFrame, out: str, start: date = START
) -> dict[str, str]:
    per_post = _stored(features.per_post_features(posts, start), "features")
    return _write_all(
        {
            "post_features.csv": per_post,
            "lex_features.csv": features.feature_distributions(per_post),
        },
        out,
        per_post=["post_features.csv"],
    )


def topics_report(
    spark: SparkSession,
    posts: DataFrame,
    out: str,
    start: date = START,
    release: date = RELEASE,
) -> dict[str, str]:
    per_post = _stored(topics.per_post_intents(posts, start), "intents")
    return _write_all(
        {
            "post_intents.csv": per_post,
            "monthly_intent_distribution.csv": topics.monthly_intent_distribution(per_post),
            "monthly_intent_wide.csv": topics.monthly_intent_wide(per_post),
            "prepost_intent_summary.csv": topics.prepost_intent_summary(per_post, release),
        },
        out,
        per_post=["post_intents.csv"],
    )


def breaks_report(
    spark: SparkSession,
    posts: DataFrame,
    out: str,
    start: date = START,
    release: date = RELEASE,
) -> dict[str, str]:
    return _breaks_of(breaks.metric_series(posts, start), out, release)


def stored_breaks_report(spark: SparkSession, directory: str, out: str, release: date = RELEASE) -> dict[str, str]:
    """The same from the monthly tables of an earlier :func:`metrics_report`."""
    return _breaks_of(breaks.stored_series(spark, directory), out, release)


def _breaks_of(series: DataFrame, out: str, release: date) -> dict[str, str]:
    series = _stored(series, "series")
    tables = breaks.structural_break_report(series, release)
    return _write_all({f"{name}.csv": table for name, table in tables.items()}, out)
