"""Sample size that is both powerful and precise enough, as a column expression."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def required_sample_size(
    population: Column,
    alpha: float = 0.05,
    power: float = 0.80,
    effect_size: float = 0.2,
    margin: float = 0.02,
    n_categories: int = 1,
) -> Column:
    """The larger of a power-based and a margin-of-error-based size, corrected for a finite population.

    Only the margin criterion is Bonferroni-adjusted, for ``n_categories`` simultaneous proportions.
    """
    z = NormalDist().inv_cdf
    for_power = math.ceil(((z(1 - alpha / 2) + z(power)) / effect_size) ** 2)
    for_margin = math.ceil(z(1 - alpha / max(n_categories, 1) / 2) ** 2 * 0.25 / margin**2)
    unlimited = max(for_power, for_margin)
    corrected = F.ceil(unlimited * population / (population + (unlimited - 1)).cast("double"))
    return F.least(corrected, population)
