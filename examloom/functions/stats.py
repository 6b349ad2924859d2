"""Paired statistics as closed-form columns, and bootstraps from counts."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quantiles of the normal distribution.
Z_975, Z_80 = 1.959963984540054, 0.8416212335729143


def wilson(k: Column, n: Column, z: float = Z_975) -> Column:
    """struct(accuracy, low, high); zeros for n = 0."""
    p = k / F.nullif(n, F.lit(0))
    shrink = 1 + z * z / F.nullif(n, F.lit(0))
    centre = (p + z * z / (2 * F.nullif(n, F.lit(0)))) / shrink
    half = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / (4 * F.nullif(n, F.lit(0)) * n)) / shrink
    zero = lambda c: F.when(n > 0, c).otherwise(0.0)
    return F.struct(zero(p).alias("accuracy"), zero(F.greatest(F.lit(0.0), centre - half)).alias("low"), zero(F.least(F.lit(1.0), centre + half)).alias("high"))


def log_factorial(x: Column) -> Column:
    """ln(x!) from the table of factorials up to 20 and Stirling's series beyond, to double precision."""
    y = F.greatest(x, F.lit(1)).cast("double")
    series = y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact test of b against c discordant pairs, 1 without any.

    The tail is summed from its largest term down; terms below e^-72 of it are nothing in double precision, so the work is
    bounded by the square root of the number of pairs.
    """
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2)
    steps = F.least(k, (12 * F.sqrt(n)).cast("long") + 60)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) / (n - k + i)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<long>")), start, add)["sum"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(first) * total))


def mcnemar_chi2(b: int, c: int) -> tuple[float, float]:
    """(statistic, p) with continuity correction, on two counts."""
    if b + c == 0:
        return 0.0, 1.0
    x = (abs(b - c) - 1) ** 2 / (b + c)
    return x, math.erfc(math.sqrt(x / 2))


def detectable_effect(n: Column, discordance: Column) -> Column:
    """Smallest difference in points that a paired test finds with 80 % power; infinite without discordance."""
    d = n * discordance
    return F.when(d > 0, (Z_975 + Z_80) * F.sqrt(F.greatest(d, F.lit(0.0))) / n * 100).otherwise(F.lit(float("inf")))


def half_width(n: Column, accuracy: Column) -> Column:
    return Z_975 * F.sqrt(accuracy * (1 - accuracy) / n) * 100


def _interval(draws: list[float]) -> tuple[float, float]:
    draws.sort()
    n = len(draws)
    return draws[int(0.025 * n)], draws[min(n - 1, int(0.975 * n))]


def bootstrap_accuracy(right: int, n: int, resamples: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of a mean of 0 and 1: resampling it is drawing a binomial, so two counts are enough."""
    if n == 0:
        return 0.0, 0.0
    rng = random.Random(seed)
    return _interval([rng.binomialvariate(n, right / n) / n for _ in range(resamples)])


def bootstrap_delta(cells: tuple[int, int, int, int], resamples: int = 10_000, seed: int = 42) -> tuple[float, float, float]:
    """(difference, low, high) in points from (both right, only a, only b, both wrong), by multinomial draws."""
    n = sum(cells)
    if n == 0:
        return 0.0, 0.0, 0.0
    rng, draws = random.Random(seed), []
    for _ in range(resamples):
        left, rest, got = n, 1.0, []
        for x in cells[:3]:
            k = rng.binomialvariate(left, min(1.0, x / n / rest) if rest > 0 else 0.0)
            got.append(k)
            left, rest = left - k, rest - x / n
        draws.append((got[1] - got[2]) / n * 100)
    return ((cells[1] - cells[2]) / n * 100, *_interval(draws))


def safe_corr(x: str, y: str) -> Column:
    """Pearson's coefficient as an aggregate; null for fewer than two rows or without variance."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(x) > 1, F.try_divide(F.covar_pop(x, y), spread))


def lower_percentile(values: Column, q: float) -> Column:
    """The element at floor((n - 1) q) of the ordered values, 0 for none."""
    ordered = F.array_sort(values)
    at = F.greatest(F.floor((F.size(values) - 1) * q) + 1, F.lit(1)).cast("int")
    return F.coalesce(F.try_element_at(ordered, at), F.lit(0))
