"""Interval merging and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """Number the islands of overlapping or touching intervals within each key, from 1.

    A running maximum of ends over the ordered intervals tells where a gap
    begins; ``order`` breaks ties so that results repeat.
    """
    w = Window.partitionBy(*keys).orderBy(start, end, *order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col(start) > before)).cast("bigint")
    return df.withColumn("opens_", opens).withColumn("island", F.sum("opens_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens_")


def merge(df: DataFrame, keys: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """One row for each island: extent and number of members."""
    return islands(df, keys, start, end, order).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 1000) -> DataFrame:
    """Pairs of inclusive intervals that overlap, with the clipped extent (clip_start, clip_end).

    Both sides are dealt to bins of ``width`` and joined on keys and bin; a
    pair is kept in the bin where its overlap starts, so it appears once and
    no theta join or distinct is needed. A very long interval is many bins,
    not one hot key.
    """
    ls, le = left_span
    rs, re_ = right_span
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    a = left.where(F.col(ls) <= F.col(le)).withColumn("bin_", bins(ls, le))
    b = right.where(F.col(rs) <= F.col(re_)).withColumn("bin_", bins(rs, re_))
    both = a.join(b, [*keys, "bin_"]).where((F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le)))
    first = F.greatest(ls, rs)
    return both.where(F.floor(first / width) == F.col("bin_")).withColumn("clip_start", first).withColumn("clip_end", F.least(le, re_)).drop("bin_")
