"""Monthly activity, resolution, response-time and engagement series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qapulse.constants import START
from qapulse.functions.calendar import (
    ANSWER,
    QUESTION,
    micros_between,
    month_label,
    month_of,
    ordered_by,
    questions,
    since,
)
from qapulse.functions.quantiles import MICROS_BITS, exact_quantiles

LATENCY = {"median_seconds": 0.5, "p90_seconds": 0.9}


def question_measures(*names: str, among: Column | None = None) -> list[Column]:
    """Named aggregates over question rows; ``among`` restricts them to some of the grouped rows."""

    def chosen(value: Column) -> Column:
        return value if among is None else F.when(among, value)

    measures = {
        "question_count": F.count(chosen(F.lit(1))),
        "distinct_askers": F.count_distinct(chosen(F.col("OwnerUserId"))),
        "accepted_rate": F.avg(chosen(F.col("AcceptedAnswerId").isNotNull().cast("int"))),
        "coverage_rate": F.avg(chosen((F.coalesce("AnswerCount", F.lit(0)) > 0).cast("int"))),
        "mean_score": F.avg(chosen(F.col("Score"))),
        "mean_comments": F.avg(chosen(F.coalesce("CommentCount", F.lit(0)))),
    }
    return [measures[name].alias(name) for name in names]


def labelled(result: DataFrame) -> DataFrame:
    """Replace the ``month`` date by its ``year_month`` label, once per result row."""
    others = [c for c in result.columns if c != "month"]
    return result.select(month_label(F.col("month")).alias("year_month"), *others)


def by_month(rows: DataFrame, *aggregates: Column) -> DataFrame:
    return labelled(rows.groupBy(month_of(F.col("CreationDate")).alias("month")).agg(*aggregates))


def _of_type(post_type: int) -> Column:
    return F.count(F.when(F.col("PostTypeId") == post_type, 1))


def answer_count() -> Column:
    return _of_type(ANSWER).alias("answer_count")


@ordered_by("year_month")
def monthly_volume(posts: DataFrame, start: date = START) -> DataFrame:
    """Questions and answers per month; a month with other posts only counts 0 and 0."""
    return by_month(
        since(posts, start),
        _of_type(QUESTION).alias("question_count"),
        answer_count(),
    )


@ordered_by("year_month")
def monthly_active_askers(posts: DataFrame, start: date = START) -> DataFrame:
    """Distinct known askers per month."""
    return by_month(questions(posts, start), *question_measures("distinct_askers"))


@ordered_by("year_month")
def monthly_accepted_rate(posts: DataFrame, start: date = START) -> DataFrame:
    return by_month(questions(posts, start), *question_measures("question_count", "accepted_rate"))


@ordered_by("year_month")
def monthly_answer_coverage(posts: DataFrame, start: date = START) -> DataFrame:
    return by_month(questions(posts, start), *question_measures("question_count", "coverage_rate"))


@ordered_by("year_month")
def monthly_engagement(posts: DataFrame, start: date = START) -> DataFrame:
    return by_month(
        questions(posts, start), *question_measures("question_count", "mean_score", "mean_comments")
    )


def first_answers(posts: DataFrame, start: date, carry: Sequence[str] = ()) -> DataFrame:
    """Month, carried columns and microseconds to the first answer of each answered question.

    Both sides are reduced before they meet: answers to one row per question (a question with
    millions of answers is combined on the map side), questions to distinct rows, as copies of one
    question count once. Answers older than their question are kept.
    """
    asked = questions(posts, start).select("Id", "CreationDate", *carry).distinct()
    answered = (
        posts.where((F.col("PostTypeId") == ANSWER) & F.col("ParentId").isNotNull())
        .groupBy("ParentId")
        .agg(F.min("CreationDate").alias("first_answered"))
    )
    return asked.join(answered, F.col("Id") == F.col("ParentId")).select(
        month_of(F.col("CreationDate")).alias("month"),
        *carry,
        micros_between(F.col("CreationDate"), F.col("first_answered")).alias("elapsed"),
    )


@ordered_by("year_month")
def monthly_time_to_first_answer(posts: DataFrame, start: date = START) -> DataFrame:
    waits = first_answers(posts, start)
    return labelled(
        exact_quantiles(waits, ["month"], "elapsed", LATENCY, "answered_count", divisor=1e6, few_groups=True, bits=MICROS_BITS)
    )


@ordered_by("year_month")
def monthly_time_to_acceptance(posts: DataFrame, start: date = START) -> DataFrame:
    """Time until the accepted answer was written, whatever the type of the accepted post.

    Questions are reduced to weighted (answer, date) pairs, so copies of a question never multiply
    with copies of its answer; a hot answer id is left to the skew join.
    """
    accepted = (
        questions(posts, start)
        .where(F.col("AcceptedAnswerId").isNotNull())
        .groupBy("AcceptedAnswerId", F.col("CreationDate").alias("asked"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    answers = posts.select("Id", "CreationDate")
    waits = accepted.join(answers, F.col("AcceptedAnswerId") == F.col("Id")).select(
        month_of(F.col("asked")).alias("month"),
        micros_between(F.col("asked"), F.col("CreationDate")).alias("elapsed"),
        "copies",
    )
    return labelled(
        exact_quantiles(
            waits, ["month"], "elapsed", LATENCY, "accepted_count", divisor=1e6, weight="copies", few_groups=True, bits=MICROS_BITS
        )
    )


def monthly_counters(posts: DataFrame, start: date = START) -> DataFrame:
    """Every metric that needs no join, from one pass over the posts.

    A month without questions has NULL for all question metrics but the volumes.
    """
    counted = by_month(
        since(posts, start),
        answer_count(),
        *question_measures(
            "question_count", "distinct_askers", "accepted_rate", "coverage_rate", "mean_score",
            "mean_comments", among=F.col("PostTypeId") == QUESTION,
        ),
    )
    askers = F.when(F.col("question_count") > 0, F.col("distinct_askers"))
    return counted.withColumn("distinct_askers", askers)


@ordered_by("year_month")
def questions_per_asker(posts: DataFrame, start: date = START) -> DataFrame:
    """Questions per distinct asker, NULL for a month without known askers."""
    both = by_month(questions(posts, start), *question_measures("question_count", "distinct_askers"))
    ratio = F.try_divide(F.col("question_count"), F.col("distinct_askers"))
    return both.withColumn("questions_per_asker", ratio)


# name -> (operator, csv name)
METRICS = {
    "monthly_volume": (monthly_volume, "monthly_volume.csv"),
    "active_askers": (monthly_active_askers, "active_askers.csv"),
    "accepted_rate": (monthly_accepted_rate, "accepted_rate.csv"),
    "answer_coverage": (monthly_answer_coverage, "answer_coverage.csv"),
    "time_to_first_answer": (monthly_time_to_first_answer, "time_to_first_answer.csv"),
    "time_to_acceptance": (monthly_time_to_acceptance, "time_to_acceptance.csv"),
    "engagement": (monthly_engagement, "engagement.csv"),
}
