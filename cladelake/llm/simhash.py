"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has 64 bits over its word shingles; documents whose
fingerprints differ in at most ``radius`` bits are linked, and components of
links are groups of near-duplicates.

The 64 bits are split into partitions, correlated bits together, and each
partition i gets a threshold t_i with sum(t_i) = radius - partitions + 1: two
fingerprints within the radius then differ by at most t_i bits in at least one
partition (t_i = -1: the partition need not be probed). Partition number and
thresholds come from dynamic programming on estimated candidate counts.
Distinct fingerprints are sent to the keys of their bits in each partition and
to all keys within the threshold; what meets under a key is verified on all 64
bits, and only a spanning forest of it is kept.

Exact copies share a fingerprint and never meet; fingerprints that many
documents share are told their group by broadcast, not in one task. A bucket
in which more than ``hot`` distinct fingerprints are indexed is split by
partitions of the bits that are left, by the same principle. That is exact at
any size; no pair list of a group is made.

Null and blank texts have fingerprint zero and are linked like any other.
Repeated rows fall into one component; a null id gets the smallest id of its
component (null if it has none). An empty table gives an empty result. Input
columns that clash with an output give way to it.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladelake.llm import shared
from cladelake.llm.components import representatives

#: Bytes of a long text that are shingled at a time.
PIECE = 1 << 20
#: A fingerprint that 1/OFTEN of all documents share, so one of OFTEN at most, gets its group from a broadcast.
OFTEN = 1000
#: Fingerprints whose probes one task makes, as far as shuffle partitions allow.
PROBE_ROWS = 10_000


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half of the shingles' XXH64.

    A-Z count as a-z; words are runs of anything but blanks; fewer words than
    ``shingle`` make one shingle, none make fingerprint zero.
    """
    digest = xxhash.xxh64_digest
    ones, total, at, tail = np.zeros(64, np.int64), 0, 0, []
    text = text.lower()
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = tail + text[at:end].split()
        at, n = end, len(words)
        if n < shingle:
            if at < len(text) or total or not n:
                tail = words
                continue
            hashed = [digest(b" ".join(words), seed)]
        else:
            line = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, n) + 1
            stop = np.cumsum(size) - 1
            first, last = (stop - size + 1)[: n - shingle + 1].tolist(), stop[shingle - 1 :].tolist()
            hashed = [digest(line[a:b], seed) for a, b in zip(first, last, strict=True)]
        for i in range(0, len(hashed), 1 << 15):
            part = hashed[i : i + (1 << 15)]
            ones += np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashed)
        tail = words[n - shingle + 1 :] if n >= shingle else words
    if not total and tail:  # blanks at the end
        return fingerprint(b" ".join(tail), shingle, seed)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Adds ``simhash``, the fingerprint as a signed 64-bit number."""

    def make():
        def step(texts: pa.Array) -> list:
            data, offsets = shared.buffers(texts)
            raw, at = data.tobytes(), offsets.tolist()
            return [np.array([fingerprint(raw[a:b], shingle, seed) for a, b in zip(at, at[1:], strict=False)], np.uint64).view(np.int64)]

        return step

    return shared.map_texts(docs, text_col, keep if keep is not None else docs.columns, [T.StructField("simhash", T.LongType())], make)


def grouped_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Split the columns into groups of equal size, each grown from a free bit by the bit most correlated with the group."""
    with np.errstate(invalid="ignore", divide="ignore"):
        tied = np.abs(np.nan_to_num(np.corrcoef(bits.T)))
    np.fill_diagonal(tied, 0)
    width = bits.shape[1]
    free, groups = list(range(width)), []
    for k in range(parts):
        want = width // parts + (k >= parts - width % parts)
        group = [max(free, key=lambda b: (tied[b][free].max(), -b))]
        free.remove(group[0])
        while len(group) < want:
            best = max(free, key=lambda b: (tied[b][group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    """Number of values within ``radius`` bits of a value of ``width`` bits."""
    return sum(len(list(itertools.combinations(range(width), r))) for r in range(radius + 1)) if radius >= 0 else 0


def plan(sample: np.ndarray, total: int, radius: int = 4, places: list[int] | None = None) -> list[tuple[list[int], int]]:
    """Partitions and thresholds with the least estimated work.

    ``sample``: distinct fingerprints; ``total``: how many there are;
    ``places``: the bits to split, all 64 by default. A pair's chance to be a
    candidate is the chance that its differing bits in the partition are at
    most the threshold, bits taken as independent at their measured rates; the
    work is candidates plus rows that probe. Two or three partitions, more
    only where the radius asks for them, and thresholds up to 2: more and
    narrower partitions have buckets that soon grow with the input. Eight bits
    or fewer are one partition.
    """
    places = list(range(64)) if places is None else places
    if len(places) <= 8:
        return [(places, min(radius, len(places)))]
    bits = np.unpackbits(np.ascontiguousarray(sample.astype(np.uint64)).byteswap().view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1][:, places].astype(np.float64)
    if not len(bits):
        bits = np.zeros((1, len(places)))
    rate = bits.mean(0)
    differ = 2 * rate * (1 - rate)
    best, chosen = np.inf, None
    least = max(2, -(-(radius + 1) // 3))
    for parts in range(least, max(3, least) + 1):
        groups = grouped_bits(bits, parts) if len(bits) > 2 else [list(map(int, g)) for g in np.array_split(np.arange(len(places)), parts)]
        cost = []
        for g in groups:
            chance = np.array([1.0, 0.0, 0.0])  # of 0, 1 and 2 differing bits
            for b in g:
                chance = chance * (1 - differ[b]) + np.concatenate(([0.0], chance[:-1])) * differ[b]
            near = np.cumsum(chance)
            cost.append({-1: 0.0} | {t: (ball(len(g), t) + (t > 0)) * total + near[t] * total**2 for t in range(3)})
        # least cost by thresholds spent so far
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            after: dict[int, tuple[float, list[int]]] = {}
            for spent, (work, ts) in state.items():
                for t, w in c.items():
                    if spent + t not in after or work + w < after[spent + t][0]:
                        after[spent + t] = (work + w, [*ts, t])
            state = after
        goal = state.get(radius - parts + 1)
        if goal and goal[0] < best:
            best, chosen = goal[0], [([places[b] for b in g], t) for g, t in zip(groups, goal[1], strict=True)]
    return chosen


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(group: list[int], radius: int) -> list[int]:
    """Values to XOR with, for all changes of at most ``radius`` bits of the group."""
    return [_signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in itertools.combinations(group, r)]


@dataclass(frozen=True)
class Part:
    """Bits of which buckets are made: ``own`` of this partition, ``path`` of this and of those a crowded bucket was split from."""

    own: int
    path: int
    masks: np.ndarray
    threshold: int

    @classmethod
    def of(cls, group: list[int], threshold: int, above: int = 0) -> Part:
        own = sum(1 << b for b in group)
        return cls(_signed(own), _signed((own | above) & (1 << 64) - 1), np.array(_masks(group, threshold), np.int64), threshold)

    @property
    def rest(self) -> list[int]:
        return [b for b in range(64) if not self.path >> b & 1]


def _first_keys(parts: list[Part], probe: bool):
    """A function from fingerprints to (fp, part, key).

    A key is the fingerprint's own bits in a partition, under which it is
    indexed, or with ``probe`` also another within the threshold. Of two
    fingerprints the one with the larger bits probes the smaller's key.
    """

    def keys(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy()
                for i, p in enumerate(parts):
                    own = (fp & p.own)[:, None]
                    key = own ^ (p.masks if probe else p.masks[:1])
                    row, col = np.nonzero(key <= own)
                    yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(np.full(len(row), i, np.int32)), pa.array(key[row, col])], names=["fp", "part", "key"])

    return keys


def _next_keys(above: list[Part], below: list[list[int]], parts: list[Part], probe: bool):
    """A function from (fp, part, key) of crowded buckets to the same of the partitions they are split into.

    Those that are indexed in the crowded bucket are indexed below it by
    their bits there, and all its members probe. A key holds the bits of all
    partitions on its path.
    """

    def keys(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp, part, key = (batch.column(i).slice(at, 4096).to_numpy() for i in range(3))
                for k in np.unique(part).tolist():
                    mine = part == k
                    f, base = fp[mine], key[mine]
                    if not probe:
                        own = (f & above[k].path) == base
                        f, base = f[own], base[own]
                    for i in below[k]:
                        p = parts[i]
                        found = base[:, None] | ((f & p.own)[:, None] ^ (p.masks if probe else p.masks[:1]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(f, found.shape[1])), pa.array(np.full(found.size, i, np.int32)), pa.array(found.ravel())], names=["fp", "part", "key"])

    return keys


def forest(members: np.ndarray, indexed: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest member of each component of links to its others.

    ``members`` ascend. Links between two members that are both not indexed
    here are not looked for. A member once reached is compared with those not
    reached yet only, so a crowd of near copies takes little more than one pass.
    """
    label = np.full(len(members), -1, np.int64)
    left, left_indexed = np.arange(len(members)), np.flatnonzero(indexed)
    for seed in np.flatnonzero(indexed).tolist():
        if label[seed] >= 0:
            continue
        label[seed], queue = seed, [seed]
        while queue:
            u = queue.pop()
            among = left if indexed[u] else left_indexed
            found = among[(np.bitwise_count(members[among] ^ members[u]) <= radius) & (label[among] < 0)]
            if len(found):
                label[found] = seed
                queue.extend(found.tolist())
                left, left_indexed = left[label[left] < 0], left_indexed[label[left_indexed] < 0]
    reached = np.flatnonzero(label >= 0)
    if not len(reached):
        return reached, reached
    order = reached[np.argsort(label[reached], kind="stable")]
    new = np.concatenate(([True], label[order][1:] != label[order][:-1]))
    top = order[new][np.cumsum(new) - 1]
    return top[~new], order[~new]


def _verify(parts: list[Part], radius: int):
    """A function from (part, key, fps) to links (a, b), a < b."""
    paths = np.array([p.path for p in parts], np.int64)

    def verify(batches):
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            size = np.diff(edge)
            path, key = paths[batch.column(0).to_numpy()], batch.column(1).to_numpy()
            two = edge[:-1][size == 2]
            two = two[np.bitwise_count((flat[two] ^ flat[two + 1]).view(np.uint64)) <= radius]
            a, b = [flat[two]], [flat[two + 1]]
            for k in np.flatnonzero(size > 2):
                members = np.sort(flat[edge[k] : edge[k + 1]])
                i, j = forest(members.view(np.uint64), (members & path[k]) == key[k], radius)
                a.append(members[i])
                b.append(members[j])
            x, y = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return verify


def links(distinct: DataFrame, radius: int = 4, fit_rows: int = 20000, hot: int = 1000) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all pairs of fingerprints within the radius.

    ``distinct`` has one row per fingerprint, in column ``fp``. ``fit_rows``
    bounds the sample that partitions and thresholds are fitted on. What meets
    under a key is verified there; each component of it gives edges to its
    smallest member. A bucket in which more than ``hot`` fingerprints are
    indexed is split: its members are dealt by partitions of the bits that
    are left, again by the pigeonhole principle, until none is crowded or no
    bit is left. So what meets in one list is at most ``hot`` times the number
    of values probed with.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    sample = np.sort(distinct.where(shared.unit_hash("fp", seed=9) < min(1.0, fit_rows / max(total, 1))).toArrow().column("fp").to_numpy())
    parts = [Part.of(g, t) for g, t in plan(sample, total, radius) if t >= 0]
    shape = "fp bigint, part int, key bigint"
    index = distinct.select("fp").mapInArrow(_first_keys(parts, False), shape)
    # a row makes dozens of probes, so a file of fingerprints is more than one task should take
    tasks = min(-(-total // PROBE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    probes = distinct.select("fp").repartition(max(tasks, 1), "fp").mapInArrow(_first_keys(parts, True), shape)
    edges = []
    while True:
        crowded = shared.materialize(index.groupBy("part", "key").count().where(F.col("count") > hot).select("part", "key"), "crowded")
        full = not crowded.isEmpty()
        sparse = probes.join(crowded, ["part", "key"], "left_anti") if full else probes
        met = sparse.groupBy("part", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        edges.append(met.mapInArrow(_verify(parts, radius), "a bigint, b bigint"))
        if not full:
            break
        members = shared.materialize(probes.join(crowded, ["part", "key"], "left_semi"), "crowded-members")
        below, deeper = [], []
        for p in parts:
            split = [Part.of(g, t, p.path) for g, t in plan(sample, total, radius, p.rest) if t >= 0]
            below.append(list(range(len(deeper), len(deeper) + len(split))))
            deeper += split
        members = members.select("fp", "part", "key")
        index = members.mapInArrow(_next_keys(parts, below, deeper, False), shape)
        probes = members.mapInArrow(_next_keys(parts, below, deeper, True), shape)
        parts = deeper
    found = functools.reduce(DataFrame.union, edges).distinct()
    # a node tied to several smaller ones: tie it to the smallest, and that one to the others
    tied = found.select("a", "b", F.min("a").over(Window.partitionBy("b")).alias("least"))
    pair = F.when(F.col("a") == F.col("least"), F.struct("a", "b")).otherwise(F.struct(F.col("least").alias("a"), F.col("a").alias("b")))
    return tied.select(pair.alias("p")).select("p.a", "p.b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, seed: int = 42, hot: int = 1000) -> DataFrame:
    """Fingerprint and group of each document.

    Returns the id column, ``simhash``, ``component_id``, the smallest id in
    the document's component of links, and ``root``, the component's smallest
    fingerprint (signed): ids may repeat or be absent, roots tell components apart.
    """
    prints = fingerprints(docs, text_col, [id_col], shingle, seed).withColumnRenamed(id_col, "id_")
    prints = shared.materialize(prints, "simhash")
    counted = prints.groupBy(F.col("simhash").alias("fp")).agg(F.min("id_").alias("least_"), F.count("*").alias("n_"))
    smallest = shared.materialize(counted, "simhash-distinct")
    found = shared.materialize(links(smallest.select("fp"), radius, hot=hot), "simhash-links")
    if found.isEmpty():
        group = smallest.select("fp", F.col("fp").alias("root"), F.col("least_").alias("component_id"), "n_")
    else:
        led = shared.materialize(smallest.join(representatives(found).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("leader", "fp").alias("leader"), "least_", "n_"), "simhash-led")
        least = led.groupBy("leader").agg(F.min("fp").alias("root"), F.min("least_").alias("component_id"))
        group = led.join(least, "leader").select("fp", "root", "component_id", "n_")
    group = shared.materialize(group.withColumnRenamed("fp", "simhash"), "simhash-groups")
    often = F.col("n_") * OFTEN >= prints.count()
    few = F.broadcast(group.where(often).drop("n_"))
    rest = prints.join(few.select("simhash"), "simhash", "left_anti").join(group.where(~often).drop("n_"), "simhash")
    return prints.join(few, "simhash").unionByName(rest).select(F.col("id_").alias(id_col), "simhash", "component_id", "root")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 4-word shingles, at most 4 differing bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
