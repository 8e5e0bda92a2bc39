"""All counters of the archive from one pass over the posts: per month, per month and domain, per domain and period."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qapulse.constants import RELEASE, START
from qapulse.functions.calendar import QUESTION, month_label, month_of, period_by_moment, since
from qapulse.functions.tags import tag_domain
from qapulse.operators.domains import RATES
from qapulse.operators.metrics import answer_count, question_measures

_MEASURES = ["answer_count", *RATES, "distinct_askers"]


def activity_counters(posts: DataFrame, start: date = START, release: date = RELEASE) -> DataFrame:
    """``year_month, domain, period`` with all counters, one aggregation over three grouping sets.

    Rows of a month have neither domain nor period, rows of a month and domain no period, rows of a domain and period no month;
    ``level`` tells them apart (``month``, ``domain``, ``period``). Posts that are no questions have no domain. Rows are
    combined on the map side within each set, and only askers are carried one by one, for the distinct count.
    """
    asked = F.col("PostTypeId") == QUESTION
    keyed = since(posts, start).withColumns({
        "month": month_of(F.col("CreationDate")),
        "domain": F.when(asked, tag_domain(F.col("Tags"))),
        "period": F.when(asked, period_by_moment(F.col("CreationDate"), release)),
    })
    sets = [["month"], ["month", "domain"], ["domain", "period"]]
    grouped = keyed.groupingSets([[F.col(c) for c in own] for own in sets], "month", "domain", "period").agg(
        F.grouping_id().alias("set"), answer_count(), *question_measures(*RATES, "distinct_askers", among=asked)
    )
    # A key left out of a set is a bit of the set's number.
    level = F.when(F.col("set") == 0b011, "month").when(F.col("set") == 0b001, "domain").otherwise("period")
    named = grouped.select(level.alias("level"), month_label(F.col("month")).alias("year_month"), "domain", "period", *_MEASURES)
    return named.where((F.col("level") == "month") | F.col("domain").isNotNull())


def level_of(counters: DataFrame, level: str, *columns: str) -> DataFrame:
    return counters.where(F.col("level") == level).select(*columns)
