"""Log-domain arithmetic as Column expressions, and small driver-side tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log1pexp(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bernoulli_entropy(x: Column) -> Column:
    """Entropy of a Bernoulli variable with logit x."""
    p = expit(x)
    return log1pexp(x) - x * p


def logaddexp(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return top + F.log1p(F.exp(-F.abs(a - b)))


def logsumexp(df: DataFrame, keys: list[str], value: str, out: str, small_groups: bool = False) -> DataFrame:
    """log sum exp of ``value`` by ``keys``; a missing row stands for -inf.

    The maximum by key comes first, so nothing overflows. By default both
    aggregates combine on the map side and are joined, for groups of any size.
    With ``small_groups`` (a few rows a key, where combining saves nothing) the
    rows are shuffled once: a window finds the maximum and the sum stays in its
    partitioning.
    """
    if small_groups:
        shifted = df.select(*keys, F.col(value).alias("x_"), F.max(value).over(Window.partitionBy(*keys)).alias("top_"))
        return shifted.groupBy(*keys).agg((F.max("top_") + F.log(F.sum(F.exp(F.col("x_") - F.col("top_"))))).alias(out))
    top = df.groupBy(*keys).agg(F.max(value).alias("top_"))
    return df.join(top, keys).groupBy(*keys).agg((F.max("top_") + F.log(F.sum(F.exp(F.col(value) - F.col("top_"))))).alias(out))


def softmax(value: Column, partition: list[str]) -> Column:
    """Share of exp(value) in its partition, shifted by the maximum."""
    w = Window.partitionBy(*partition)
    shifted = F.exp(value - F.max(value).over(w))
    return shifted / F.sum(shifted).over(w)


def nbinom_logpmf(n: float, p: float, values: range) -> list[tuple[int, float]]:
    """(k, log P(k)) of a negative binomial with n failures and success chance p."""
    return [(k, math.lgamma(k + n) - math.lgamma(k + 1) - math.lgamma(n) + n * math.log(p) + k * math.log1p(-p)) for k in values]


def window_lengths(n: float, p: float, shortest: int, longest: int) -> list[tuple[int, float]]:
    """Log-pmf over fragment windows: from the shortest to mean + 2 sd, or the longest fragment if that is more."""
    mean, sd = n * (1 - p) / p, math.sqrt(n * (1 - p)) / p
    return nbinom_logpmf(n, p, range(shortest, max(int(mean + 2 * sd), longest) + 1))
