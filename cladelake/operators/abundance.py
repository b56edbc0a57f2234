"""Posterior summaries: quantiles, profiles, overall abundances, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladelake.functions.numeric import softmax


def quantiles(df: DataFrame, keys: list[str], value: str, probs: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """Exact quantiles with linear interpolation, columns q1, q2, ..."""
    return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(f"q{i + 1}") for i, p in enumerate(probs)])


def hellinger(p: DataFrame, q: DataFrame, keys: list[str], strain: str, value: str) -> DataFrame:
    """Hellinger distance of two profiles by ``keys``; a strain absent on one side has 0 there."""
    a, b = p.select(*keys, strain, F.col(value).alias("p_")), q.select(*keys, strain, F.col(value).alias("q_"))
    both = a.join(b, [*keys, strain], "full")
    root = lambda c: F.sqrt(F.coalesce(F.col(c), F.lit(0.0)))
    return both.groupBy(*keys).agg((F.sqrt(F.sum(F.pow(root("p_") - root("q_"), 2))) / F.sqrt(F.lit(2.0))).alias("hellinger"))


def interpret(samples: DataFrame, inclusion: DataFrame, members: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(t, n, strain_id, abundance) from latent samples (t, n, rep, x).

    Representatives included with probability over the threshold are
    renormalised by softmax within (t, n); each shares its abundance equally
    among its cluster's members (rep, strain_id).
    """
    kept = samples.join(F.broadcast(inclusion.where(F.col("prob") > threshold).select("rep")), "rep", "left_semi")
    shares = kept.select("t", "n", "rep", softmax(F.col("x"), ["t", "n"]).alias("y"))
    sized = members.withColumn("size_", F.count("*").over(Window.partitionBy("rep")))
    return shares.join(sized, "rep").select("t", "n", "strain_id", (F.col("y") / F.col("size_")).alias("abundance"))


def overall(profile: DataFrame, depth: DataFrame, lengths: DataFrame) -> DataFrame:
    """Relative to overall abundance: y kept / depth / sum(marker_len / genome_len y).

    ``depth``: (t, kept, depth); ``lengths``: (strain_id, marker_len,
    genome_len). A genome length of 0 raises.
    """
    ratio = F.when(F.col("genome_len") > 0, F.col("marker_len") / F.col("genome_len")).otherwise(F.raise_error(F.lit("genome length 0")).cast("double"))
    y = profile.join(lengths.withColumn("ratio_", ratio).select("strain_id", "ratio_"), "strain_id")
    weight = F.sum(F.col("abundance") * F.col("ratio_")).over(Window.partitionBy("t", "n"))
    y = y.withColumn("weight_", weight).join(depth, "t")
    return y.select("t", "n", "strain_id", (F.col("abundance") * F.col("kept") / F.col("depth") / F.col("weight_")).alias("overall"))


def time_increments(times: DataFrame, t: str = "t") -> DataFrame:
    """(t, dt, dt^-1/2) over sorted distinct times; the first has none."""
    w = Window.orderBy(t)
    dt = F.col(t) - F.lag(t).over(w)
    return times.select(t).distinct().select(t, dt.alias("dt")).where("dt is not null").select(t, "dt", F.pow("dt", F.lit(-0.5)).alias("scale"))


def jeffreys_log_prior(first: Column, increments: Column, strains: int, times: int) -> Column:
    """-S/2 log |x_1|^2 - (T-1) S / 2 log sum |dx|^2 / dt, of the two sums."""
    return -0.5 * strains * F.log(first) - 0.5 * (times - 1) * strains * F.log(increments)


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, out: str = "mean") -> DataFrame:
    """Mean of the last ``width`` values."""
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - width, 0)))


def to_wide(profile: DataFrame, t: str = "t", strain: str = "strain_id", value: str = "abundance", strains: list[str] | None = None) -> DataFrame:
    """One row for each time, one column for each strain."""
    return profile.groupBy(t).pivot(strain, strains).agg(F.first(value))


def to_long(wide: DataFrame, t: str = "t", strain: str = "strain_id", value: str = "abundance") -> DataFrame:
    return wide.unpivot([t], [c for c in wide.columns if c != t], strain, value)
