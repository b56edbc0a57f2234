"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of each benchmark
item; an item of fewer words is one pattern. For each pattern length a table
gives, for a block of two words, how far the search may jump; a block that ends
a pattern selects a bucket of patterns, the block before them, where a pattern
would start, those of the bucket that are compared word by word.

Words: A-Z lower-cased, then runs of ASCII letters, digits and anything beyond
ASCII. Null or blank texts have no words and no hits; items without words hit
nothing. Repeated rows give repeated results, repeated item ids count once,
items without an id mark words but are not listed. Empty tables give no rows
or no hits. Input columns that clash with an output give way to it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladelake.llm import shared

_ranges = ((48, 58, 48), (65, 91, 97), (97, 123, 97), (128, 256, 128))
#: Bytes of words, A-Z lower-cased; anything else is a blank.
WORD_BYTES = bytes(next((to + b - lo for lo, hi, to in _ranges if lo <= b < hi), 32) for b in range(256))
#: Bytes of a long text that are split into words at a time.
PIECE = 1 << 20
SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
OUTPUTS = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType()))]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class PatternGroup:
    """Search tables for patterns of one length."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))

    def key(self, words: list[bytes], end: int):
        return (words[end - 1], words[end]) if self.block == 2 else words[end]

    def add(self, pattern: list[bytes], items: set) -> None:
        for end in range(self.block - 1, self.length):
            key, jump = self.key(pattern, end), self.length - 1 - end
            self.shift[key] = min(self.shift.get(key, jump), jump)
        self.buckets[self.key(pattern, self.length - 1)][self.key(pattern, self.block - 1)].append((pattern, items))

    def find(self, words: list[bytes], mark: bytearray, items: set) -> None:
        """Mark the words inside occurrences and collect their items."""
        m, n, shift, pair = self.length, len(words), self.shift.get, self.block == 2
        far, at, ones = m - self.block + 1, m - 1, b"\1" * m
        while at < n:
            key = (words[at - 1], words[at]) if pair else words[at]
            jump = shift(key, far)
            if jump:
                at += jump
                continue
            seen = words[at - m + 1 : at + 1]
            for pattern, owners in self.buckets[key].get(self.key(seen, self.block - 1), ()):
                if pattern == seen:
                    mark[at - m + 1 : at + 1] = ones
                    items |= owners
            at += 1


def build(rows: Iterable[tuple[str | None, str | None]], window: int) -> list[PatternGroup]:
    """Search tables for all items, one group for each pattern length."""
    owners: dict[tuple[bytes, ...], set] = defaultdict(set)
    for item, text in rows:
        words = words_of((text or "").encode())
        if not words:
            continue
        for i in range(max(1, len(words) - window + 1)):
            found = owners[tuple(words[i : i + window])]
            if item is not None:
                found.add(item)
    groups: dict[int, PatternGroup] = {}
    for pattern in sorted(owners):
        groups.setdefault(len(pattern), PatternGroup(len(pattern))).add(list(pattern), owners[pattern])
    return list(groups.values())


def pieces(text: bytes) -> Iterator[bytes]:
    """Consecutive parts of about ``PIECE`` normalised bytes, cut at blanks."""
    text, at = text.translate(WORD_BYTES), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            if cut < 0:
                cut = text.find(b" ", end)
            end = len(text) if cut < 0 else cut + 1
        yield text[at:end]
        at = end


def scan(groups: list[PatternGroup], text: bytes) -> tuple[int, list[dict], list[int]]:
    """Number of words, merged spans of hit words, items found, in order."""
    reach = max((g.length for g in groups), default=1) - 1
    words: list[bytes] = []
    mark, items, base, spans = bytearray(), set(), 0, []

    def flush(upto: int) -> None:
        hit = mark.find(1, 0, upto)
        while hit >= 0:
            end = mark.find(0, hit, upto)
            end = upto if end < 0 else end
            if spans and spans[-1]["last"] == base + hit - 1:
                spans[-1]["last"] = base + end - 1
            else:
                spans.append({"first": base + hit, "last": base + end - 1})
            hit = mark.find(1, end, upto)

    for piece in pieces(text):
        words += piece.split()
        mark += bytes(len(words) - len(mark))
        for g in groups:
            g.find(words, mark, items)
        done = max(0, len(words) - reach)  # the rest may take part in what follows
        flush(done)
        words, mark, base = words[done:], mark[done:], base + done
    flush(len(words))
    return base + len(words), spans, sorted(items)


def search(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, window: int = 10, max_bytes: int = 32 << 20) -> DataFrame:
    """Find benchmark windows in whole documents.

    Adds ``n_words``, ``n_hit`` (words inside any occurrence), ``spans`` (word
    positions, ends included), ``items`` (ids as strings) and ``contaminated``. The items are
    sent to the executors while they are at most ``max_bytes`` of text; beyond
    that they are dealt by hash into parts of that size, each searched in a
    pass of its own over the documents (a written table between passes).
    """
    keep = list(keep if keep is not None else docs.columns)
    bench = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text_"))
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text_")), F.lit(0)), F.coalesce(F.max(F.octet_length("text_")), F.lit(0))).first()
    parts = max(1, -(-2 * total[0] // max_bytes)) if total[0] > max_bytes else 1
    spark = docs.sparkSession
    outputs = {f.name for f in OUTPUTS} | {"n_hit", "contaminated"}
    keep = [c for c in keep if c not in outputs]
    df = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text_"))
    names = [f"k{i}" for i in range(len(keep))]
    for part in range(parts):
        some = bench if parts == 1 else bench.where(F.pmod(F.xxhash64("item", "text_"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast([tuple(r) for r in some.toLocalIterator()])

        def make(held=held):
            groups = build(held.value, window)

            def step(texts: pa.Array) -> list:
                data, offsets = shared.buffers(texts)
                raw, at = data.tobytes(), offsets.tolist()
                found = [scan(groups, raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
                return [np.array([f[0] for f in found], np.int64), pa.array([f[1] for f in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array([f[2] for f in found], pa.list_(pa.string()))]

            return step

        more = part < parts - 1
        carried = names + (["spans_0", "items_0"] if part else []) + (["text_"] if more else [])
        df = shared.map_texts(df, "text_", carried, OUTPUTS, make)
        if part:
            df = df.withColumns({"spans": F.array_sort(F.concat("spans_0", "spans")), "items": F.array_union("items_0", "items")}).drop("spans_0", "items_0")
        if more:
            df = shared.materialize(df.withColumnsRenamed({"spans": "spans_0", "items": "items_0"}).drop("n_words"), "decontaminate")
    if parts > 1:
        df = df.withColumn("items", F.array_sort("items"))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("last"))
        step = lambda a, x: F.struct((a["n"] + F.greatest(x["last"] - F.greatest(x["first"] - 1, a["last"]), F.lit(0))).cast("bigint").alias("n"), F.greatest(a["last"], x["last"]).alias("last"))
        hit = F.aggregate("spans", start, step)["n"]
    else:
        hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["last"] - x["first"] + 1)
    df = df.withColumn("n_hit", hit).withColumn("contaminated", F.col("n_hit") > 0)
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_words", "n_hit", "spans", "items", "contaminated")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    found = search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    listed = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
pattern AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
place AS (
  SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM pattern)),
found AS (
  SELECT place.r, place.i, place.m, pattern.item_id
  FROM place JOIN pattern ON place.m = pattern.m AND array_to_string(place.w[place.i : place.i + place.m - 1], ' ') = pattern.p),
hit AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + m)) AS j FROM found) GROUP BY r),
item AS (
  SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items,
       sha256(coalesce(item.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""
