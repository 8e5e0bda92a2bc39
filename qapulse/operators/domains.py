"""The monthly metrics per technology domain, and their change across the release."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qapulse.constants import RELEASE, START
from qapulse.functions.calendar import month_of, ordered_by, period_by_label, period_by_moment, questions
from qapulse.functions.quantiles import MICROS_BITS, exact_quantiles
from qapulse.functions.tags import tag_domain
from qapulse.operators.metrics import LATENCY, first_answers, labelled, question_measures

RATES = ["question_count", "accepted_rate", "coverage_rate", "mean_score", "mean_comments"]


def _domain() -> Column:
    return tag_domain(F.col("Tags")).alias("domain")


def _by_domain(posts: DataFrame, start: date, *measures: str) -> DataFrame:
    month = month_of(F.col("CreationDate")).alias("month")
    grouped = questions(posts, start).groupBy(month, _domain())
    return labelled(grouped.agg(*question_measures(*measures)))


@ordered_by("year_month", "domain")
def domain_volume(posts: DataFrame, start: date = START) -> DataFrame:
    return _by_domain(posts, start, "question_count")


@ordered_by("year_month", "domain")
def domain_accepted_rate(posts: DataFrame, start: date = START) -> DataFrame:
    return _by_domain(posts, start, "question_count", "accepted_rate")


@ordered_by("year_month", "domain")
def domain_coverage(posts: DataFrame, start: date = START) -> DataFrame:
    return _by_domain(posts, start, "question_count", "coverage_rate")


@ordered_by("year_month", "domain")
def domain_engagement(posts: DataFrame, start: date = START) -> DataFrame:
    return _by_domain(posts, start, "question_count", "mean_score", "mean_comments")


@ordered_by("year_month", "domain")
def domain_counters(posts: DataFrame, start: date = START) -> DataFrame:
    """All of the above from one aggregation, for reports."""
    return _by_domain(posts, start, *RATES)


@ordered_by("year_month", "domain")
def domain_response_time(posts: DataFrame, start: date = START) -> DataFrame:
    waits = first_answers(posts, start, carry=["Tags"]).withColumn("domain", _domain())
    return labelled(
        exact_quantiles(waits, ["month", "domain"], "elapsed", LATENCY, "answered_count", divisor=1e6, few_groups=True, bits=MICROS_BITS)
    )


@ordered_by("domain", "period")
def domain_prepost_summary(
    posts: DataFrame, start: date = START, release: date = RELEASE
) -> DataFrame:
    """Periods are cut at the day of the release."""
    period = period_by_moment(F.col("CreationDate"), release).alias("period")
    return (
        questions(posts, start)
        .groupBy(_domain(), period)
        .agg(*question_measures(*RATES))
    )


def volume_change(volume: DataFrame, release: date = RELEASE) -> DataFrame:
    """Mean monthly volume before and after the release month, for domains seen before it.

    ``volume`` holds ``year_month, domain, question_count``; the release month counts as after.
    """
    period = period_by_label(F.col("year_month"), release)
    pre, post = (F.when(period == p, F.col("question_count")) for p in ("pre", "post"))
    change = (F.col("post_mean") - F.col("pre_mean")) / F.col("pre_mean") * 100
    return (
        volume.groupBy("domain")
        .agg(
            F.avg(pre).alias("pre_mean"),
            F.avg(post).alias("post_mean"),
            F.sum(pre).alias("pre_total"),
            F.sum(post).alias("post_total"),
        )
        .where(F.col("pre_mean").isNotNull())
        .select("domain", "pre_mean", "post_mean", change.alias("pct_change_mean"), "pre_total", "post_total")
    )


@ordered_by("domain")
def domain_volume_change(
    posts: DataFrame, start: date = START, release: date = RELEASE
) -> DataFrame:
    return volume_change(domain_volume.unordered(posts, start), release)


DOMAIN_METRICS = {
    "domain_volume": (domain_volume, "domain_volume.csv"),
    "domain_accepted_rate": (domain_accepted_rate, "domain_accepted_rate.csv"),
    "domain_coverage": (domain_coverage, "domain_coverage.csv"),
    "domain_response_time": (domain_response_time, "domain_response_time.csv"),
    "domain_engagement": (domain_engagement, "domain_engagement.csv"),
    "domain_prepost": (domain_prepost_summary, "domain_prepost_summary.csv"),
    "domain_volume_change": (domain_volume_change, "domain_volume_change.csv"),
}
