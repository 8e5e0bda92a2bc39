"""Month keys, the analysis window and the pre/post cuts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUESTION, ANSWER = 1, 2


def month_of(moment: Column) -> Column:
    """First day of the month as DATE: integer arithmetic per row; text labels are made after grouping."""
    return F.trunc(moment.cast("date"), "MM")


def month_label(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def month_from_label(label: Column) -> Column:
    return F.to_date(F.concat(label, F.lit("-01")))


def since(rows: DataFrame, start: date) -> DataFrame:
    """Rows created on or after ``start``.

    On a month-partitioned table a predicate on ``year_month`` is added, so whole partitions are
    pruned. The pseudo-partitions cannot add rows: their dates are NULL and fail the date predicate.
    """
    inside = F.col("CreationDate") >= F.lit(start)
    if "year_month" in rows.columns:
        inside = (F.col("year_month") >= F.lit(start.strftime("%Y-%m"))) & inside
    return rows.where(inside)


def questions(posts: DataFrame, start: date) -> DataFrame:
    return since(posts.where(F.col("PostTypeId") == QUESTION), start)


def micros_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def _period(is_pre: Column) -> Column:
    return F.when(is_pre, "pre").otherwise("post")


# The three cuts differ on purpose for a release inside a month: (1) splits that month at the day,
# (2) counts the whole month as post, (3) counts the whole month as pre.
def period_by_moment(moment: Column, release: date) -> Column:
    return _period(moment < F.lit(release))


def period_by_label(label: Column, release: date) -> Column:
    return _period(label < F.lit(release.strftime("%Y-%m")))


def period_by_month_start(month: Column, release: date) -> Column:
    return _period(month < F.lit(release))


def ordered_by(*columns: str) -> Callable:
    """Sort an operator's (small) result; ``.unordered`` composes without paying for the sort."""

    def decorate(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(build)
        def ordered(*args, **kwargs) -> DataFrame:
            return build(*args, **kwargs).orderBy(*columns)

        ordered.unordered = build
        return ordered

    return decorate
