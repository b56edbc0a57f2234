"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sources get weights by their rank in code point order (null last), share the
asked-for part of all words by weight, and stop at ``cap`` times their own
size; the excess goes to the others by weight. Within a source every document
expects target / size copies: with documents in a fixed order and one random
offset, a document is emitted once for each integer that its stretch of the
running sum crosses, so floor or ceil of the expectation.

The order puts documents of like size side by side (size bucket, salt of id
and text, size, id), which keeps each source's taken words near its target. Its prefix
sums have two levels: rows are ranked inside (source, size bucket, salt), and
the few bucket counts give each bucket's start, so a source with a third of
all rows is spread over thousands of windows.

Null texts have size 0; a null source is a source of its own. Ties (equal
size and id) are rows that cannot be told apart by what is returned. An empty
table gives an empty result; sources of no words get target 0. Extra columns
play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladelake.llm import shared

WORD = r"[^\x20\x09-\x0D]+"
#: Hash salts inside a size bucket of a source.
SALTS = 64


def md5_number(text: Column) -> Column:
    """The first eight hex digits of the md5, as a number in [0, 2**32)."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def size_bucket(size: Column) -> Column:
    """Buckets of at most an eighth of their size wide: bit length and the three bits after the first."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 8 + F.expr("shiftright(size_, greatest(length(bin(size_)) - 4, 0))") % 8)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: int = 3) -> DataFrame:
    """A target for each row of ``sizes`` (source_, source_size, one row a source).

    With sources sorted by cap * size / weight, the level at which a source
    would be filled if all before it were capped peaks at the first one that
    is not; a target is that level times the weight, or the cap if less.
    """
    ranked = sizes.withColumn("weight_", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source_").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    by_fill = Window.orderBy((cap * F.col("source_size") / F.col("weight_")).asc(), F.col("source_").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / (F.sum("weight_").over(everything) - F.coalesce(F.sum("weight_").over(before), F.lit(0)))
    return ranked.withColumn("level_", level).withColumn("target", F.least((F.col("source_size") * cap).cast("double"), F.max("level_").over(everything) * F.col("weight_"))).drop("level_")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: int = 3, seed: int = 17, salts: int = SALTS) -> DataFrame:
    """Copies of each document in the mix.

    Returns the id column, ``source``, ``size``, ``source_size``, ``target``,
    ``copies`` and ``taken`` (copies times size).
    """
    sized = docs.select(F.col(id_col).alias("id_"), F.col(source_col).cast("string").alias("source_"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size_"), F.col(text_col).cast("string").alias("text_"))
    sized = sized.select("*", F.coalesce(F.concat(F.lit("+"), F.col("source_")), F.lit("-")).alias("key_"), size_bucket(F.col("size_")).cast("int").alias("bucket_"), (md5_number(F.concat(F.coalesce(F.col("id_").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text_", F.lit("")))) % salts).cast("int").alias("salt_"))
    sized = shared.materialize(sized.drop("text_"), "mix-sizes")
    counts = sized.groupBy("key_", "source_", "bucket_", "salt_").agg(F.count("*").alias("n_"), F.sum("size_").alias("words_"))
    counts = shared.materialize(counts, "mix-buckets")
    goal = targets(counts.groupBy("source_").agg(F.sum("words_").alias("source_size")), weights, share, cap)
    goal = goal.select(F.coalesce(F.concat(F.lit("+"), F.col("source_")), F.lit("-")).alias("key_"), "source_size", "target")
    place = Window.partitionBy("key_").orderBy("bucket_", "salt_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start_", F.coalesce(F.sum("n_").over(place), F.lit(0))).drop("source_", "n_", "words_").join(goal, "key_")
    inside = Window.partitionBy("key_", "bucket_", "salt_").orderBy("size_", F.col("id_").asc_nulls_first())
    rows = sized.withColumn("rank_", F.row_number().over(inside)).join(starts, ["key_", "bucket_", "salt_"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = md5_number(F.concat(F.lit(f"{seed}:"), F.col("key_"))) / float(1 << 32)
    rank = F.col("start_") + F.col("rank_")
    copies = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    rows = rows.withColumn("copies", F.least(copies, F.lit(cap)).cast("bigint"))  # a rank beyond doubles may round up
    return rows.select(F.col("id_").alias(id_col), F.col("source_").alias("source"), F.col("size_").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("size_")).alias("taken"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 by source, at most 3 times a source's size."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('+' || source, '-') AS k, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 8))::BIGINT % 64) AS salt
  FROM documents),
bucketed AS (
  SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 4, 0)) % 8 END AS bucket FROM sized),
sources AS (
  SELECT source, k, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sized GROUP BY source, k),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT * 1.0::DOUBLE - coalesce(sum(source_size) OVER before, 0)::BIGINT * 3)
           / ((sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER before, 0)::BIGINT)::DOUBLE AS level
  FROM sources WINDOW before AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT *, least((source_size * 3)::DOUBLE, max(level) OVER () * w) AS target FROM levels),
ranked AS (
  SELECT b.doc_id, b.size, g.source_size, g.target, row_number() OVER (PARTITION BY b.k ORDER BY b.bucket, b.salt, b.size, b.doc_id NULLS FIRST) AS r,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || b.k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM bucketed b JOIN goals g USING (k))
SELECT doc_id, size, source_size, target, ((floor(r * rate + u) - floor((r - 1) * rate + u)) * size)::BIGINT AS taken FROM ranked
"""
