"""Language-model scores by context-tree weighting over binary-decomposed bytes.

Each bit of a byte has, for the bits of the byte before it, a context tree over
the preceding bytes. A node estimates its bit by Krichevsky-Trofimov counts and
mixes that, by Bayes' rule at weight 1/2, with the product of its children:
P_w = (P_kt + prod P_w(child)) / 2. Counts come from all training texts; the
posterior weights that follow are frozen, and a text's code length is the sum
over its bits (and an end-of-text byte) of the mixture over all depths of its
context.

Nodes are all contexts seen at least ``least`` times, whatever their number;
rarer children of a node share one node that stands for the rest. The tree is
never in one place: contexts that end in the same two bytes are weighed
together as one group, and only the depths above them meet on the driver. Texts
are dealt in chunks; the distinct grams of each chunk meet their group's
counts, and their code lengths go back to the chunk's texts.

Beside the score there is a word base line: log10((c + 0.5) / (N + 0.5 (V + 1)))
summed over a text's words and one end token. Words of at least 1/``common`` of
all training tokens, at most ``common`` of them, are looked up from a
broadcast; the others go through a join.

Null texts count as empty: one token, the end. Repeated rows give repeated
results; an empty table gives an empty result; without training texts every
byte costs 8 bits and every token 0. Input columns that clash with an output
give way to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladelake.llm import shared

#: Stands before a text's first byte and after its last; UTF-8 has no such byte.
END = 255
BLANKS = b" \t\n\r\x0b\x0c"
PIECE = 1 << 20


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, A-Z lower-cased, in lists of about 1 MB."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end] not in BLANKS:
            end += 1
        yield text[at:end].lower().split()
        at = end


def grams(text: np.ndarray, depth: int) -> np.ndarray:
    """Each byte of a text and its end, with the ``depth`` bytes before it, as one number."""
    padded = np.concatenate((np.full(depth, END, np.uint8), text, np.full(1, END, np.uint8))).astype(np.int64)
    n = len(text) + 1
    code = padded[:n].copy()
    for j in range(1, depth + 1):
        code <<= 8
        code |= padded[j : j + n]
    return code


def corpus_counts(train: DataFrame, text_col: str, depth: int) -> DataFrame:
    """(token, code, n): counts of words (code null) and of byte grams (token null) over whole texts, written."""
    source = train.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def count(batches):
        words: Counter = Counter()
        held: list[np.ndarray] = []
        code_, n_ = np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = 0

        def of_words():
            out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["token", "code", "n"])
            words.clear()
            return out

        def fold():
            """Merge the grams at hand into the counts so far."""
            code, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            every, at = np.unique(np.concatenate((code_, code)), return_inverse=True)
            return every, np.bincount(at, np.concatenate((n_, n)), len(every)).astype(np.int64)

        def of_grams():
            return pa.RecordBatch.from_arrays([pa.nulls(len(code_), pa.binary()), pa.array(code_), pa.array(n_)], names=["token", "code", "n"])

        for batch in batches:
            data, offsets = shared.buffers(batch.column(0))
            raw = data.tobytes()
            for i in range(len(offsets) - 1):
                a, b = int(offsets[i]), int(offsets[i + 1])
                for part in word_pieces(raw[a:b]):
                    words.update(part)
                    if len(words) > 400_000:
                        yield of_words()
                for at in range(a, b + 1, 4 * PIECE):  # long texts in parts that bring their own context
                    end = min(at + 4 * PIECE, b)
                    code = grams(data[max(a, at - depth) : end], depth)[at - max(a, at - depth) :]
                    held.append(code if end == b else code[:-1])
                    size += len(code)
                    if size > 4 * PIECE:
                        code_, n_ = fold()
                        size = 0
                        if len(code_) > 2 * PIECE:
                            yield of_grams()
                            code_, n_ = code_[:0], n_[:0]
                    if end == b:
                        break
        if words:
            yield of_words()
        if held:
            code_, n_ = fold()
        if len(code_):
            yield of_grams()

    parts = source.mapInArrow(count, "token binary, code bigint, n bigint")
    return shared.materialize(parts.groupBy("token", "code").agg(F.sum("n").alias("n")), "lm-counts")


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series at x + 6."""
    shift = np.zeros_like(x)
    for k in range(6):
        shift += np.log(x + k)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 255 bit nodes (heap order from 1), from byte counts (rows x 256)."""
    zeros, ones = np.zeros((len(counts), 256)), np.zeros((len(counts), 256))
    level = counts.astype(np.float64)
    for width in (128, 64, 32, 16, 8, 4, 2, 1):
        zeros[:, width : 2 * width], ones[:, width : 2 * width] = level[:, 0::2], level[:, 1::2]
        level = level[:, 0::2] + level[:, 1::2]
    return zeros, ones


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of sequences with these counts."""
    out = np.zeros(zeros.shape)
    some = (zeros + ones) > 0
    a, b = zeros[some], ones[some]
    out[some] = lgamma(a + 0.5) + lgamma(b + 0.5) - np.log(np.pi) - lgamma(a + b + 1)
    return out


@dataclass
class ContextTree:
    """children[d]: node x byte -> node of depth d + 1 or -1; first[d]: row of depth d's first node; bits: rows x 256 code lengths of the next byte, in half precision."""

    children: list[np.ndarray]
    first: list[int]
    bits: np.ndarray

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text, its end included."""
        n = len(offsets) - 1
        total = np.zeros(n)
        depth = len(self.children)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
            end = min(end, n)
            if end == at + 1 and offsets[end] - offsets[at] > 4 * PIECE:  # one long text, in parts
                a, b = int(offsets[at]), int(offsets[end])
                for i in range(a, b, 2 * PIECE):
                    j = min(i + 2 * PIECE, b)
                    lead = data[max(a, i - depth) : i]
                    part = np.concatenate((np.full(depth - len(lead), END, np.uint8), lead, data[i:j], np.full(int(j == b), END, np.uint8)))
                    total[at] += self._lengths(part, depth).sum()
            else:
                pad = np.full(depth, END, np.uint8)
                size = np.diff(offsets[at : end + 1])
                stream = np.concatenate([x for i in range(at, end) for x in (pad, data[offsets[i] : offsets[i + 1]], pad[:1] if depth else np.full(1, END, np.uint8))])
                cost = self._lengths(stream, depth)
                # a text's own bytes and its end; the padding in between costs nothing
                begin = np.concatenate(([0], np.cumsum(size + 1 + depth)[:-1]))
                sums = np.concatenate(([0.0], np.cumsum(cost)))
                total[at:end] = sums[begin + size + 1] - sums[begin]
            at = end
        return total

    def _lengths(self, stream: np.ndarray, depth: int) -> np.ndarray:
        """Code length of each byte after the first ``depth``."""
        wide = stream.astype(np.int32)
        n = len(stream) - depth
        node = np.zeros(n, np.int32)
        row = np.full(n, self.first[0], np.int32)
        for d in range(depth):
            before = wide[depth - 1 - d : depth - 1 - d + n]
            node = self.children[d].ravel()[node * 256 + before]  # -1 leads to the last row, all -1
            row = np.where(node >= 0, self.first[d + 1] + node, row)
        return self.bits.ravel()[row * np.int64(256) + wide[depth:]].astype(np.float64)


def grow(levels: list[tuple[np.ndarray, np.ndarray]]) -> ContextTree:
    """The tree from sorted context numbers and their rows of 256 byte counts, for each depth."""
    keys = [k for k, _ in levels]
    counts: list = [x for _, x in levels]
    depth = len(levels) - 1
    parent = [np.zeros(0, np.int64)] + [np.searchsorted(keys[d - 1], keys[d] % (1 << (8 * (d - 1)))) for d in range(1, depth + 1)]
    weighted: list = [None] * (depth + 1)
    stay: list = [None] * (depth + 1)
    ratio: list = [None] * (depth + 1)
    rest: list = [None] * (depth + 1)
    half = np.log(0.5)
    for d in range(depth, -1, -1):
        n = len(keys[d])
        weighted[d], ratio[d] = np.zeros((n, 256)), np.zeros((n, 256), np.float32)
        if d < depth:
            stay[d], rest[d] = np.zeros((n, 256), np.float32), np.zeros((n, 256), np.float32)
            order = np.argsort(parent[d + 1], kind="stable")
            edge = np.searchsorted(parent[d + 1][order], np.arange(n + 1))
        for at in range(0, n, 1024):  # a thousand nodes at a time
            part = slice(at, min(at + 1024, n))
            zeros, ones = bit_counts(counts[d][part])
            kt = log_kt(zeros, ones)
            ratio[d][part] = (ones + 0.5) / (zeros + ones + 1)
            if d == depth:
                weighted[d][part] = kt
                continue
            child = order[edge[part.start] : edge[part.stop]]
            mine = parent[d + 1][child] - at
            spent, below = np.zeros(kt.shape), np.zeros(kt.shape)
            np.add.at(spent, mine, counts[d + 1][child])
            np.add.at(below, mine, weighted[d + 1][child])
            z, o = bit_counts(np.maximum(counts[d][part] - spent, 0))
            rest[d][part] = (o + 0.5) / (z + o + 1)
            weighted[d][part] = np.logaddexp(half + kt, half + below + log_kt(z, o))
            stay[d][part] = np.exp(half + kt - weighted[d][part])
        if d < depth:
            weighted[d + 1] = counts[d + 1] = None
    rows, children = [], []
    so_far, weight = np.zeros((len(keys[0]), 256), np.float32), np.ones((len(keys[0]), 256), np.float32)
    for d in range(depth + 1):
        if d == depth:
            one = so_far + weight * ratio[d]
        else:
            one = so_far + weight * (stay[d] * ratio[d] + (1 - stay[d]) * rest[d])
            after = so_far + weight * stay[d] * ratio[d]
            weight = weight * (1 - stay[d])
            so_far, weight = after[parent[d + 1]], weight[parent[d + 1]]
            table = np.full((len(keys[d]) + 1, 256), -1, np.int32)
            table[parent[d + 1], keys[d + 1] >> (8 * d)] = np.arange(len(keys[d + 1]))
            children.append(table)
        ratio[d] = stay[d] = rest[d] = None
        one = np.clip(one, 1e-9, 1 - 1e-9)
        cost = np.zeros((len(one), 1), np.float32)
        for width in (1, 2, 4, 8, 16, 32, 64, 128):
            p = one[:, width : 2 * width]
            cost = np.stack((cost - np.log2(1 - p), cost - np.log2(p)), 2).reshape(len(one), 2 * width)
        rows.append(cost.astype(np.float16))
    first = np.concatenate(([0], np.cumsum([len(x) for x in rows])))[:-1].tolist()
    return ContextTree(children, first, np.concatenate(rows))


def context_tree(counts: DataFrame, depth: int = 5, nodes: int = 32768) -> ContextTree:
    """Fetch the nodes' counts, at most ``nodes`` contexts a depth, and grow the tree."""
    coded = counts.where("code is not null")
    total = coded.agg(F.sum("n")).first()[0] or 0
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(depth + 1):
        by = coded.select((F.col("code").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1))).alias("code"), "n").groupBy("code").agg(F.sum("n").alias("n")) if d < depth else coded.select("code", "n")
        by = by.select(F.shiftright("code", 8).alias("context"), F.col("code").bitwiseAND(F.lit(255)).alias("byte"), "n")
        whole = by.groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") * nodes >= total)
        got = by.join(whole.select("context"), "context", "left_semi").toArrow() if total else None
        keys, dense = np.zeros(int(d == 0), np.int64), np.zeros((int(d == 0), 256), np.float32)
        if got is not None and got.num_rows:
            keys, place = np.unique(got.column("context").to_numpy(), return_inverse=True)
            dense = np.zeros((len(keys), 256), np.float32)
            dense[place, got.column("byte").to_numpy()] = got.column("n").to_numpy()
        levels.append((keys, dense))
    return grow(levels)


def text_grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, grams of it and each row after it, the grams) of some texts at a time; a long text comes in parts."""
    for a, b in shared.slices(offsets, 2 * PIECE, 1 << 20):
        if offsets[b] - offsets[a] > 4 * PIECE:
            for i in range(int(offsets[a]), int(offsets[b]), 2 * PIECE):
                j, lead = min(i + 2 * PIECE, int(offsets[b])), max(int(offsets[a]), i - depth)
                code = grams(data[lead:j], depth)[i - lead :]
                code = code if j == offsets[b] else code[:-1]
                yield a, np.array([len(code)]), code
            continue
        size = np.diff(offsets[a : b + 1])
        width = size + depth + 1
        begin = np.cumsum(width) - width
        stream = np.full(int(width.sum()), END, np.uint8)
        row = np.repeat(np.arange(b - a), size)
        stream[np.arange(len(row)) + (begin + depth - (offsets[a:b] - offsets[a]))[row]] = data[offsets[a] : offsets[b]]
        wide = stream.astype(np.int64)
        code = wide.copy()
        for j in range(1, depth + 1):
            code[j:] |= wide[:-j] << (8 * j)
        own = np.ones(len(stream), bool)
        for j in range(depth):
            own[begin + j] = False
        yield a, size + 1, code[own]


def seek(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted number in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of the values of each."""
    keys, at = np.unique(key, return_inverse=True)
    return keys, *(np.bincount(at, v, len(keys)).astype(np.float64) for v in values)  # of nothing, bincount makes integers


def shorter(key: np.ndarray, depth: int) -> np.ndarray:
    """Keys (context * 256 + bit node) with the context cut to its last ``depth`` bytes."""
    return key & ((1 << (8 * (depth + 1))) - 1)


@dataclass
class Level:
    """Seen bit nodes of the kept contexts of one depth: sorted keys (context * 256 + bit node), counts, log weighted probability, and the parts of the mixture."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    stay: np.ndarray
    rest: np.ndarray

    @property
    def contexts(self) -> np.ndarray:
        return self.keys[(self.keys & 255) == 1] >> 8

    @property
    def ratio(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)


def often_enough(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, least: int) -> np.ndarray:
    """Which keys are of contexts seen ``least`` times; a context's first key is its whole count."""
    first = (keys & 255) == 1
    return (zeros + ones)[first][np.cumsum(first) - 1] >= least


def weigh(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, depth: int, least: int, below: Level | None) -> Level:
    """The level of a depth from its counts and the level below (None: there is none)."""
    if depth:  # the root is always a node
        kept = often_enough(keys, zeros, ones, least)
        keys, zeros, ones = keys[kept], zeros[kept], ones[kept]
    kt = log_kt(zeros, ones)
    if below is None:
        return Level(keys, zeros, ones, kt, np.ones(len(keys)), np.full(len(keys), 0.5))
    parent = np.searchsorted(keys, shorter(below.keys, depth))
    spent_z, spent_o, split = (np.bincount(parent, x, len(keys)).astype(np.float64) for x in (below.zeros, below.ones, below.weighted))
    z, o = zeros - spent_z, ones - spent_o
    half = np.log(0.5)
    weighted = np.logaddexp(half + kt, half + split + log_kt(z, o))
    return Level(keys, zeros, ones, weighted, np.exp(half + kt - weighted), (o + 0.5) / (z + o + 1))


def predict(levels: list[Level], first: int, below: np.ndarray | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of a one that the levels from depth ``first`` give the keys (of full contexts), and the weight left for the depth after them.

    ``below`` has the kept contexts of that depth; None: the last level is the deepest.
    """
    so_far, weight = np.zeros(len(keys)), np.ones(len(keys))
    for i, level in enumerate(levels):
        d = first + i
        at, seen = seek(level.keys, shorter(keys, d))
        ratio, stay, rest = (np.where(seen, x[at], y) if len(x) else np.full(len(keys), y) for x, y in ((level.ratio, 0.5), (level.stay, 0.5), (level.rest, 0.5)))
        last = i == len(levels) - 1
        if last and below is None:
            return so_far + weight * ratio, np.zeros(len(keys))
        deeper = seek(below if last else levels[i + 1].contexts, shorter(keys, d + 1) >> 8)[1]
        so_far += weight * np.where(deeper, stay * ratio, stay * ratio + (1 - stay) * rest)
        weight *= np.where(deeper, 1 - stay, 0)
    return so_far, weight


def bit_keys(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context * 256 + bit node) of the eight bits of each gram, and the bits."""
    byte, step = (code & 255)[:, None], np.arange(8)
    return ((code >> 8)[:, None] << 8) | ((byte | 256) >> (8 - step)), (byte >> (7 - step)) & 1


def group_model(code: np.ndarray, n: np.ndarray, top: int, depth: int, least: int) -> tuple[tuple, list[Level]]:
    """Weigh all contexts of a group, in which all that share their last ``top`` bytes are.

    Returns (keys, zeros, ones, log weighted) of depth ``top``, NaN for contexts
    that are not kept, and the levels from there on.
    """
    keys, bit = bit_keys(code)
    times = np.repeat(n, 8)
    counts = summed(keys.ravel(), times * (1 - bit.ravel()), times * bit.ravel())
    levels: list[Level] = []
    for d in range(depth, top - 1, -1):
        if d < depth:
            counts = summed(shorter(counts[0], d), *counts[1:])
        levels.insert(0, weigh(*counts, d, least, levels[0] if levels else None))
    at, kept = seek(levels[0].keys, counts[0])
    weighted = np.where(kept, levels[0].weighted[at], np.nan) if len(levels[0].keys) else np.full(len(counts[0]), np.nan)
    return (*counts, weighted), levels


def top_model(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray, top: int, least: int) -> tuple[list[Level], np.ndarray]:
    """The levels above depth ``top``, and the kept contexts of that depth."""
    kept = ~np.isnan(weighted)
    nothing = np.zeros(int(kept.sum()))
    below = Level(keys[kept], zeros[kept], ones[kept], weighted[kept], nothing, nothing)
    contexts, levels = below.contexts, []
    counts: tuple = (keys, zeros, ones)
    for d in range(top - 1, -1, -1):
        counts = summed(shorter(counts[0], d), *counts[1:])
        below = weigh(*counts, d, least, below)
        levels.insert(0, below)
    return levels, contexts


def bucket(code, top: int, buckets: int = 1024):
    """Bucket of grams (numbers or a column); contexts with the same last ``top`` (at most 2) bytes share it."""
    if isinstance(code, np.ndarray):
        return (((code >> 8) & ((1 << (8 * top)) - 1)) * 40503 & 65535) * buckets >> 16
    root = F.shiftright(code, 8).bitwiseAND(F.lit((1 << (8 * top)) - 1))
    return F.shiftright((root * 40503).bitwiseAND(F.lit(65535)) * buckets, 16)


def packed(numbers: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences."""
    return pa.compress(np.diff(numbers, prepend=0).tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(blob, 8 * n, "zstd", asbytes=True), np.int64))


def packed_texts(texts: DataFrame) -> DataFrame:
    """(chunk_, blob): rows and texts of a chunk, compressed a few MB at a time."""

    def pack(batches):
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            for a, b in shared.slices(shared.buffers(batch.column(2))[1], rows=1 << 20):
                edges = [a, *(a + 1 + np.nonzero(np.diff(chunk[a:b]))[0]).tolist(), b]
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    sink = pa.BufferOutputStream()
                    part = batch.slice(i, j - i).select([1, 2])
                    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([int(chunk[i])]), pa.array([sink.getvalue().to_pybytes()])], names=["chunk_", "blob"])

    return texts.select("chunk_", "row_", "t_").mapInArrow(pack, "chunk_ bigint, blob binary")


def chunks(docs: DataFrame, text_col: str, limit: int) -> DataFrame:
    """The texts with ``chunk_``, a number that texts of up to ``limit`` bytes in all share, written."""

    def make():
        part, state = TaskContext.get().partitionId() << 32, [0, 0]

        def step(texts: pa.Array) -> list:
            size = int(shared.buffers(texts)[1][-1])
            if state[1] and state[1] + size > limit:
                state[:] = [state[0] + 1, 0]
            state[1] += size
            return [texts, np.full(len(texts), part + state[0])]

        return step

    fields = [T.StructField("t_", T.StringType()), T.StructField("chunk_", T.LongType())]
    return shared.materialize(shared.map_texts(docs, text_col, [c for c in docs.columns if c != text_col], fields, make), "lm-texts")


def chunk_grams(texts: DataFrame, depth: int) -> DataFrame:
    """(chunk_, bucket, n, grams): the distinct grams of each chunk, packed by bucket."""

    def collect(batches):
        held: list[np.ndarray] = []
        size, now = 0, None

        def out():
            code = np.unique(np.concatenate(held))
            held.clear()
            place = bucket(code, min(2, depth))
            order = np.argsort(place, kind="stable")
            code, place = code[order], place[order]
            edges = [0, *(np.nonzero(np.diff(place))[0] + 1).tolist(), len(code)]
            blobs = [packed(code[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), now)), pa.array(place[edges[:-1]]), pa.array(np.diff(edges)), pa.array(blobs, pa.binary())], names=["chunk_", "bucket", "n", "grams"])

        for batch in batches:
            chunk = batch.column(0).to_numpy()
            edges = [0, *(np.nonzero(np.diff(chunk))[0] + 1).tolist(), len(chunk)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if now is not None and chunk[i] != now and held:
                    yield out()
                    size = 0
                now = int(chunk[i])
                for _, _, code in text_grams(*shared.buffers(batch.column(1).slice(i, j - i)), depth):
                    held.append(np.unique(code))
                    size += len(held[-1])
                    if size > 4 * PIECE:
                        held[:] = [np.unique(np.concatenate(held))]
                        size = len(held[0])
        if held:
            yield out()

    return texts.select("chunk_", "t_").mapInArrow(collect, "chunk_ bigint, bucket bigint, n bigint, grams binary")


def gram_costs(counts: DataFrame, wanted: DataFrame, depth: int, least: int) -> DataFrame:
    """Packed grams (see ``chunk_grams``) with the bits of each one's last byte after the bytes before it, as ``costs``."""
    spark = counts.sparkSession
    top = min(2, depth)
    coded = counts.where("code is not null").select(bucket(F.col("code"), top).cast("bigint").alias("bucket"), "code", "n")

    def of_group(table: pa.Table) -> tuple[tuple, list[Level]]:
        return group_model(table["code"].to_numpy(), table["n"].to_numpy().astype(np.float64), top, depth, least)

    def stats(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("key", "z", "o", "w"), of_group(table)[0], strict=True)))

    got = coded.groupBy("bucket").applyInArrow(stats, "key bigint, z double, o double, w double").toArrow().sort_by("key")
    held = spark.sparkContext.broadcast(top_model(*(got[c].to_numpy() for c in ("key", "z", "o", "w")), top, least))

    def price(table: pa.Table, want: pa.Table) -> pa.Table:
        levels, contexts = held.value
        size = want["n"].to_numpy()
        parts = [unpacked(b.as_py(), n) for b, n in zip(want["grams"], size.tolist(), strict=True)]
        code, at = np.unique(np.concatenate([*parts, np.zeros(0, np.int64)]), return_inverse=True)
        keys, bit = bit_keys(code)
        so_far, weight = predict(levels, 0, contexts, keys.ravel())
        one = so_far + weight * predict(of_group(table)[1], top, None, keys.ravel())[0]
        one = np.clip(one, 1e-9, 1 - 1e-9).reshape(keys.shape)
        cost = -np.log2(np.where(bit, one, 1 - one)).sum(1).astype(np.float32)[at]
        costs = [x.tobytes() for x in np.split(cost, np.cumsum(size)[:-1])] if len(size) else []
        return pa.table({"chunk_": want["chunk_"], "n": want["n"], "grams": want["grams"], "costs": pa.array(costs, pa.binary())})

    return coded.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(price, "chunk_ bigint, n bigint, grams binary, costs binary")


@dataclass
class GramTable:
    """Costs of grams in an open-addressing table of at most half load."""

    slots: np.ndarray
    code: np.ndarray
    cost: np.ndarray
    shift: int

    @classmethod
    def of(cls, code: np.ndarray, cost: np.ndarray) -> GramTable:
        bits = max(4, int(2 * len(code)).bit_length())
        table = cls(np.full(1 << bits, -1, np.int32), np.append(code, -1), np.append(cost, np.float32(np.nan)), 64 - bits)
        left, slot = np.arange(len(code), dtype=np.int32), table._home(code)
        while len(left):
            free = table.slots[slot] < 0
            table.slots[slot[free]] = left[free]
            lost = table.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(table.slots) - 1)
        return table

    def _home(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def costs(self, code: np.ndarray) -> np.ndarray:
        """The cost of each gram, which must be in the table."""
        slot = self._home(code)
        at = self.slots[slot]
        wrong = np.nonzero(self.code[at] != code)[0]
        while len(wrong):
            if (at[wrong] < 0).any():
                raise KeyError("a gram without code length")
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            at[wrong] = self.slots[slot[wrong]]
            wrong = wrong[self.code[at[wrong]] != code[wrong]]
        return self.cost[at]

    def text_costs(self, data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
        """Bits of each text, its end included."""
        total = np.zeros(len(offsets) - 1)
        for a, size, code in text_grams(data, offsets, depth):
            total[a : a + len(size)] += np.add.reduceat(self.costs(code).astype(np.float64), np.cumsum(size) - size)
        return total


def score(docs: DataFrame, train: DataFrame, text_col: str = "text", keep: list[str] | None = None, depth: int = 5, least: int = 2, common: int = 200_000, chunk: int = 32 << 20) -> DataFrame:
    """Score whole texts by a model of the texts of ``train``.

    Adds ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``
    (log10 of the text's probability), ``n_bytes`` and ``bits_per_byte``.
    """
    outputs = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in outputs]
    spark = docs.sparkSession
    texts = train.count()
    counts = corpus_counts(train, text_col, depth)
    vocabulary = counts.where("token is not null").select("token", F.col("n").alias("c"))
    words, kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train, v_train = words + texts, kinds + (texts > 0)
    below = n_train + 0.5 * (v_train + 1)
    often = vocabulary.where(F.col("c") * common >= n_train).toArrow()
    known = dict(zip(often.column("token").to_pylist(), np.log10((often.column("c").to_numpy() + 0.5) / below).tolist(), strict=True))
    end_cost, unseen = float(np.log10((texts + 0.5) / below)), float(np.log10(0.5 / below))
    held = spark.sparkContext.broadcast(known)

    def make():
        known = held.value

        def step(texts_: pa.Array) -> list:
            data, offsets = shared.buffers(texts_)
            raw = data.tobytes()
            tokens, sure, base, rare = [], [], [], []
            for i in range(len(texts_)):
                found: Counter = Counter()
                for part in word_pieces(raw[offsets[i] : offsets[i + 1]]):
                    found.update(part)
                total, seen, other = 0.0, 0, []
                for w, n in found.items():
                    cost = known.get(w)
                    if cost is None:
                        other.append((w, n))
                    else:
                        total += n * cost
                        seen += n
                tokens.append(sum(found.values()) + 1)
                sure.append(seen)
                base.append(total)
                rare.append(other)
            flat = pa.array([w for r in rare for w, _ in r], pa.binary()), pa.array([n for r in rare for _, n in r], pa.int64())
            edges = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rare]))), pa.int32())
            lists = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(list(flat), ["token", "n"]))
            return [np.array(tokens, np.int64), np.array(sure, np.int64), np.array(base), np.diff(offsets), lists]

        return step

    rare_type = T.ArrayType(T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.LongType())]))
    fields = [T.StructField("tokens_", T.LongType()), T.StructField("sure_", T.LongType()), T.StructField("base_", T.DoubleType()), T.StructField("bytes_", T.LongType()), T.StructField("rare_", rare_type)]
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t_"))
    texts_ = chunks(renamed.withColumn("row_", F.monotonically_increasing_id()), "t_", chunk)
    rows = shared.map_texts(texts_, "t_", [*[f"c{i}" for i in range(len(keep))], "row_"], fields, make)
    rows = shared.materialize(rows, "lm-rows")

    def measure(texts: pa.Table, priced: pa.Table) -> pa.Table:
        code = np.concatenate([unpacked(b.as_py(), n.as_py()) for b, n in zip(priced["grams"], priced["n"], strict=True)])
        cost = np.concatenate([np.frombuffer(b.as_py(), np.float32) for b in priced["costs"]])
        code, first = np.unique(code, return_index=True)
        table = GramTable.of(code, cost[first])
        out = []
        for blob in texts["blob"]:
            part = pa.ipc.open_stream(blob.as_buffer()).read_all()
            out.append(pa.table({"row_": part["row_"], "bits_": pa.array(table.text_costs(*shared.buffers(part["t_"]), depth))}))
        return pa.concat_tables(out)

    bits = packed_texts(texts_).groupBy("chunk_").cogroup(gram_costs(counts, chunk_grams(texts_, depth), depth, least).groupBy("chunk_")).applyInArrow(measure, "row_ bigint, bits_ double")
    rare = rows.select("row_", F.explode("rare_").alias("r")).select("row_", "r.token", "r.n")
    cost = F.log10((F.col("c") + 0.5) / F.lit(float(below)))
    joined = rare.join(vocabulary.where(F.col("c") * common < n_train), "token").groupBy("row_").agg(F.sum("n").alias("seen_"), F.sum(F.col("n") * cost).alias("cost_"))
    both = rows.drop("rare_").join(bits, "row_").join(joined, "row_", "left")
    seen = F.col("sure_") + F.coalesce("seen_", F.lit(0))
    other = F.col("tokens_") - 1 - seen
    return both.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)],
        F.col("tokens_").alias("n_tokens"),
        (seen + int(texts > 0)).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base_") + F.coalesce("cost_", F.lit(0.0)) + other * unseen + end_cost).alias("base_score"),
        (F.col("bits_") * float(-np.log10(2))).alias("score"),
        F.col("bytes_").alias("n_bytes"),
        (F.col("bits_") / (F.col("bytes_") + 1)).alias("bits_per_byte"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; learned where crc32(doc_id) mod 5 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    train = docs.where(~shared.is_remainder("doc_id", 5, 1) & F.col("doc_id").isNotNull())
    return score(docs, train, keep=["doc_id"]).withColumn("held_out", shared.is_remainder("doc_id", 5, 1)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
