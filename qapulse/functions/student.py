"""Closed-form tail probabilities for integer degrees of freedom."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def f_tail_two(f: Column, m: Column) -> Column:
    """P(F > f) with (2, m) degrees of freedom."""
    return F.when(f == float("inf"), 0.0).otherwise(F.pow(m / (m + 2 * f), m / 2))


def t_two_sided(t: Column, m: Column) -> Column:
    """P(|T| > |t|) with m >= 1 degrees of freedom, by the finite series in cos(theta)."""
    square = t * t
    sine = F.abs(t) / F.sqrt(m + square)
    cosine = F.sqrt(m / (m + square))
    odd = m % 2 == 1
    steps = F.floor(m / 2).cast("int")

    def term(state: Column, j: Column) -> Column:
        ratio = F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
        return F.struct(
            (state["term"] * cosine * cosine * ratio).alias("term"),
            (state["total"] + state["term"]).alias("total"),
        )

    first = F.when(odd, cosine).otherwise(1.0)
    series = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("term"), F.lit(0.0).alias("total")),
        term,
    )["total"]
    inside = F.when(odd, (F.asin(sine) + sine * series) * (2 / math.pi)).otherwise(sine * series)
    return F.when(m >= 1, F.greatest(1 - inside, F.lit(0.0)))
