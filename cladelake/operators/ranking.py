"""Places in a global order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows drawn for each range that the order is cut into.
DRAWN = 32
#: Ranges at most; beyond that they hold more rows, which a window sorts with spilling.
RANGES = 4096


def _ranges_below(key: Column, bounds: Column, n: int) -> Column:
    """How many of ``n`` sorted bounds lie below ``key``, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(bounds, at + step - 1) < key), at + step).otherwise(at))


def global_rank(df: DataFrame, order: list[str], out: str = "place", range_rows: int = 1_000_000) -> DataFrame:
    """Adds each row's place from 1 in the ascending order of the columns ``order``, nulls first.

    The order is cut into ranges of about ``range_rows`` rows at bounds drawn
    by hash, ``DRAWN`` keys a range; rows are numbered inside their range and
    start after all rows of the ranges before it. Bounds decide where the work
    is done, never a place. Rows that tie on all of ``order`` get consecutive
    places in no particular sequence. ``df`` is read once for its count, once
    for bounds, once for the ranges' counts.
    """
    total = df.count()
    cuts = min(-(-total // range_rows), RANGES) - 1
    key = F.struct(*order)
    inside = Window.partitionBy("range_").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    if cuts <= 0:
        return df.withColumn("range_", F.lit(0)).withColumn(out, F.row_number().over(inside).cast("bigint")).drop("range_")
    rate = min(1.0, DRAWN * (cuts + 1) / total)
    drawn = df.where(F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < int(rate * (1 << 30))).select(*order).distinct().orderBy(*[F.col(c).asc_nulls_first() for c in order]).collect()
    picked = [drawn[i] for i in range(DRAWN // 2, len(drawn), DRAWN)]
    types = {f.name: f.dataType for f in df.schema}
    bounds = F.array(*[F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in order]) for r in picked])
    ranged = df.withColumn("range_", _ranges_below(key, bounds, len(picked)) if picked else F.lit(0))
    counts = ranged.groupBy("range_").count()
    before = Window.partitionBy().orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start_"))
    return ranged.withColumn(out, F.row_number().over(inside)).join(F.broadcast(starts), "range_").withColumn(out, (F.col(out) + F.col("start_")).cast("bigint")).drop("range_", "start_")
