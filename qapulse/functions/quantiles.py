"""Exact interpolated quantiles of a BIGINT column per group, without gathering a group in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in one task's memory. That
fails once a month holds a large share of an archive. Here ranks are found digit by digit: a coarse histogram
of the leading bits tells in which bucket each wanted rank lies, then only that bucket is cut into
``2**DIGIT`` finer ones, and so on down to single values.

* every aggregation is combined on the map side, so a hot month or a hot value spreads over all tasks;
* a window sees one row per bucket of a digit, at most ``2**DIGIT`` (twice as many at the top, for the
  sign), however many values a group has and however they lie.

The rows are counted once, by value; every histogram comes from that one exchange, so what makes the
rows (a join, say) runs once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 13
#: Bits of a span of microseconds of 142 years, sign included.
MICROS_BITS = 53


def shifts_of(bits: int) -> list[int]:
    """Bits still open after each digit, coarse to fine; the last one tells single values apart."""
    return list(range(0, max(bits - 1, 1), DIGIT))[::-1]


def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Mapping[str, float],
    count: str,
    divisor: float = 1.0,
    weight: str | None = None,
    few_groups: bool = False,
    bits: int = 64,
) -> DataFrame:
    """``keys``, the number of rows ``count`` (NULL values included), and one quantile per point.

    The buckets holding a wanted rank, at most ``2 * len(points)`` rows per group, are broadcast. That
    is bounded for calendar months and fixed labels (a century of months with four labels: 20,000
    rows): callers with such keys pass ``few_groups=True``. Otherwise Spark chooses the join.
    ``bits`` is the width of the values, sign included: narrower values need fewer digits. Wider ones are
    still right, with a longer first histogram.
    """
    group = ", ".join(keys)
    counted = rows.selectExpr(*keys, f"{value} AS v", f"CAST({weight or 1} AS BIGINT) AS w").groupBy(*keys, "v").agg(F.sum("w").alias("n"))
    position = {name: f"({p}D * (total - 1))" for name, p in points.items()}
    ranks = [f"{side}_{name}" for name in position for side in ("low", "high")]
    carried = ["total", "all_rows", *ranks]

    first, *others = shifts_of(bits)
    # NULL values form a bucket of their own that holds no rank.
    valid = "IF(bucket IS NULL, 0, n)"
    buckets = counted.groupBy(*keys, F.shiftright("v", first).alias("bucket")).agg(F.sum("n").alias("n")).selectExpr(
        *keys, "bucket", f"{valid} AS n",
        f"SUM({valid}) OVER (PARTITION BY {group} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto",
        f"SUM({valid}) OVER (PARTITION BY {group}) AS total", f"SUM(n) OVER (PARTITION BY {group}) AS all_rows",
    )
    # Ranks below and above each point, counted from the start of the group.
    wanted = [f"{nearest}({at}) AS {side}_{name}" for name, at in position.items() for side, nearest in (("low", "floor"), ("high", "ceil"))]
    hot = _holding(buckets.selectExpr("*", *wanted), keys, ranks)
    last = first
    for shift in others:
        held = hot.selectExpr(*[f"{c} AS hot_{c}" for c in [*keys, "bucket"]], *carried)
        # Null-safe on purpose: it adds no IS NOT NULL filter to one branch only, which would stop Spark
        # from reusing the shuffles of the rows.
        same = F.expr(" AND ".join([*(f"{c} <=> hot_{c}" for c in keys), f"shiftright(v, {last}) <=> hot_bucket"]))
        finer = counted.join(F.broadcast(held) if few_groups else held, same)
        finer = finer.groupBy(*keys, "hot_bucket", F.shiftright("v", shift).alias("bucket"), *carried).agg(F.sum("n").alias("n"))
        within = f"PARTITION BY {group}, hot_bucket ORDER BY bucket ROWS UNBOUNDED PRECEDING"
        finer = finer.selectExpr(*keys, "bucket", *carried, f"{valid} AS n", f"SUM({valid}) OVER ({within}) AS upto")
        hot, last = _holding(finer, keys, ranks), shift
    # With no bit open a bucket is a value; each rank is left in one of them.
    at_rank = [F.max(F.when(F.col(c).isNotNull(), F.col("bucket"))).alias(c) for c in ranks]
    picked = hot.groupBy(*keys).agg(F.max("all_rows").alias(count), F.max("total").alias("total"), *at_rank)
    return picked.selectExpr(
        *keys,
        count,
        *[
            f"(low_{name} + (high_{name} - low_{name}) * ({at} - floor({at}))) / {divisor}D AS {name}"
            for name, at in position.items()
        ],
    )


def _holding(buckets: DataFrame, keys: Sequence[str], ranks: Sequence[str]) -> DataFrame:
    """The buckets that hold a rank, ranks counted from the bucket's start and NULL in other buckets; and those of NULLs."""
    inside = [f"IF({r} >= upto - n AND {r} < upto, {r} - (upto - n), NULL) AS {r}" for r in ranks]
    return buckets.selectExpr(*keys, "bucket", "total", "all_rows", *inside).where(f"COALESCE({', '.join(ranks)}) IS NOT NULL OR bucket IS NULL")
