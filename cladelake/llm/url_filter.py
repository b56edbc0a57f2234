"""URL rules looked up in Bloom filter cascades, in DataFrame functions only.

A rule is a host and the start of a path; it fits the host, its subdomains and
all paths with that start. A url's candidate keys are its host's last labels
with its path's first characters, for the (label count, length) pairs that
rules have. A cascade tells exactly which keys of the corpus are listed: level
0 is a Bloom filter of the listed keys, level 1 one of the corpus's keys that
level 0 takes for listed, level 2 one of the listed keys that level 1 takes for
those, and so on until a level makes no mistake on the corpus's whole key
universe. Looking up is arithmetic on literals, without a join.

Level 0's rate of mistakes is set so that level 1 holds about as many keys as
level 0, so a cascade has a few bits times log2(universe / listed) per listed
key. Its size is checked against ``max_bits``; beyond that ``judge`` looks the
candidates up by a shuffled join, where a url's longest candidate is found by
an aggregate.

A null url, or one without ``://``, has empty host and path and no rule. Of
rules that fit, the longest text wins, then the longer host; a key listed both
ways blocks. Urls without a rule get ``default``. Repeated rows give repeated
results, an empty table an empty one; without rules every url gets the default.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladelake.llm import shared


@dataclass(frozen=True)
class Level:
    """A Bloom filter: 64-bit words as text, number of bits and of hash functions, and the seed of its hashes."""

    words: str
    bits: int
    hashes: int
    seed: int

    def _places(self, key: Column) -> list[Column]:
        one, two = (F.pmod(F.xxhash64(key, F.lit(2 * self.seed + i)), F.lit(self.bits)) for i in (0, 1))
        return [F.pmod(one + two * i, F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        sure = F.lit(True)
        for place in self._places(key):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            sure = sure & (F.expr("1L") == F.call_function("shiftrightunsigned", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)))
        return sure


def fill(keys: DataFrame, rate: float, seed: int, count: int) -> Level:
    """A Bloom filter over column ``key`` with about the given rate of mistakes."""
    bits = max(64, math.ceil(count * math.log2(1 / rate) / math.log(2)))
    hashes = max(1, round(math.log2(1 / rate)))
    level = Level("", bits, hashes, seed)
    place = keys.select(F.explode(F.array(*level._places(F.col("key")))).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % 64).cast("int"))).alias("word")).collect()
    table = [0] * (bits // 64 + 1)
    for r in words:
        table[r["at"]] = r["word"]
    return Level(",".join(map(str, table)), bits, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)  # what every level takes in is on the last level's side
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].holds(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)


def build(listed: DataFrame, universe: DataFrame, universe_size: int, max_bits: int) -> Cascade | None:
    """Cascade for ``listed`` (column key), exact on ``universe`` (column key, repeats allowed); None if it outgrows ``max_bits``."""
    listed = listed.select("key").distinct()
    count = listed.count()
    if not count:
        return Cascade([])
    rate = min(0.5, max(count * math.sqrt(0.5) / max(universe_size, 1), 2.0**-40))
    if count * math.log2(1 / rate) / math.log(2) > max_bits:
        return None
    levels = [fill(listed, rate, 0, count)]
    wrong = universe.where(levels[0].holds(F.col("key"))).select("key").distinct().join(listed, "key", "left_anti")
    wrong = shared.materialize(wrong, "cascade")
    inside, outside = listed, wrong
    while True:
        encode, against = (outside, inside) if len(levels) % 2 else (inside, outside)
        n = encode.count()
        if not n:
            return Cascade(levels)
        if sum(x.bits for x in levels) + n * 2 > max_bits:
            return None
        levels.append(fill(encode, 0.5, len(levels), n))
        left = shared.materialize(against.where(levels[-1].holds(F.col("key"))), "cascade")
        inside, outside = (inside, left) if len(levels) % 2 else (left, outside)


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased."""
    return F.coalesce(shared.lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys under which rules may list the url, longest first, then longer host."""
    labels = F.split(host, r"\.")
    out = []
    for n, length in shapes:
        tail = F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
        fits = (F.size(labels) >= n) & (F.length(path) >= length) & (host != "")
        out.append(F.when(fits, F.struct((-F.length(tail) - length).alias("l"), (-F.length(tail)).alias("h"), F.concat(tail, F.substring(path, 1, length)).alias("key"))))
    found = F.array_sort(F.array_compact(F.array(*out)))
    return F.transform(found, lambda x: x["key"])


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: list[str] | None = None, default: str = "allow", max_bits: int = 1 << 25, max_shapes: int = 1000) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: columns action (allow or block), host, path. Rules may have at
    most ``max_shapes`` different pairs of label count and path length.
    """
    outputs = ("host", "path", "rule", "verdict")
    keep = [c for c in (keep if keep is not None else pages.columns) if c not in outputs]
    url = F.col(f"`{url_col}`").cast("string")
    df = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], host_of(url).alias("host"), path_of(url).alias("path"))
    known = rules.where("host is not null and path is not null and action in ('allow', 'block')").select("action", F.concat(shared.lower_ascii("host"), "path").alias("key"), F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("l"))
    shapes = sorted((r["n"], r["l"]) for r in known.select("n", "l").distinct().limit(max_shapes + 1).collect())
    if len(shapes) > max_shapes:
        raise ValueError(f"more than {max_shapes} shapes of rules")
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    if not shapes:
        return df.select(*names, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    df = df.withColumn("keys", candidates(F.col("host"), F.col("path"), shapes))
    universe = df.select(F.explode("keys").alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    block = build(known.where("action = 'block'"), universe, size, max_bits)
    allow = build(known.where("action = 'allow'"), universe, size, max_bits)
    if block is None or allow is None:
        return _joined(df, known, default).select(*names, "host", "path", "rule", "verdict")
    rule = F.get(F.filter("keys", lambda k: block.holds(k) | allow.holds(k)), F.lit(0))
    df = df.withColumn("rule", rule)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(block.holds(F.col("rule")), "block").otherwise("allow")
    return df.withColumn("verdict", verdict).select(*names, "host", "path", "rule", "verdict")


def _joined(df: DataFrame, known: DataFrame, default: str) -> DataFrame:
    """The same by joins, for lists too long for literals: each distinct (host, path) is judged once."""
    lists = known.groupBy("key").agg(F.max(F.col("action") == "block").alias("blocked"))
    each = df.select("host", "path", "keys").distinct()
    hit = each.select("host", "path", F.posexplode("keys").alias("at", "key")).join(lists, "key")
    best = hit.groupBy("host", "path").agg(F.min_by(F.struct("key", "blocked"), "at").alias("best")).select("host", "path", F.col("best.key").alias("rule"), F.col("best.blocked").alias("blocked"))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(F.col("blocked"), "block").otherwise("allow")
    return df.join(best, ["host", "path"], "left").withColumn("verdict", verdict)


#: The rules of query op7.
RULES = "VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/') AS rules(action, host, path)"


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules; urls without a rule are not listed, so allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.sql(f"SELECT * FROM {RULES}"), keep=["page_id"])


OP7_SQL = r"""
WITH rules(action, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (
  SELECT row_number() OVER () AS r, page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT u.r, rules.host || rules.path AS rule, action,
         row_number() OVER (PARTITION BY u.r ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC, action DESC) AS n
  FROM u JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path))
SELECT u.page_id, u.host, u.path, fits.rule, coalesce(fits.action, 'allow') AS verdict FROM u LEFT JOIN fits ON u.r = fits.r AND fits.n = 1
"""
