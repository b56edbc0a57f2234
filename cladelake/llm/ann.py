"""Approximate nearest neighbours by largest inner product.

Vectors are coded by product quantisation with 4-bit codes per subspace. The
codebooks minimise a score-aware loss: the residual's part parallel to the
vector, which is what large inner products see, weighs ``eta`` times the part
orthogonal to it. A search scans a table of partial inner products for each
query over the codes, two subspaces to a byte; the best rows of each block are
scored exactly, in double precision, on the original vectors.

Vectors that are null or zero, hold null or non-finite components, have no id,
or are not of the most frequent length take no part. Equal vectors are scanned
once a block and answer with their smallest ids, as many as can be in a result.
Ties go to the smaller id. Of rows that repeat an id, the least vector is the
query; none of them answers its own id. Fewer candidates than asked for: all.
An empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladelake.llm import shared

#: Rows of the index that are scanned at a time.
BLOCK = 8192


@dataclass
class Quantiser:
    """books: subspaces x 16 x dimensions of a subspace; eta: weight of parallel residuals."""

    books: np.ndarray
    eta: float

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into subspaces, filled with zeros at the end."""
        out = np.zeros((len(x), self.padded))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), self.books.shape[0], -1)

    def encode(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes by coordinate descent on the score-aware loss."""
        parts = self.split(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        miss = ((parts[:, :, None, :] - self.books) ** 2).sum(-1)
        along = ((parts[:, :, None, :] - self.books) * unit[:, :, None, :]).sum(-1)  # parallel residual by code
        codes = miss.argmin(2)
        rows, n_sub = np.arange(len(x)), self.books.shape[0]
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for m in range(n_sub):
                rest = total - along[rows, m, codes[:, m]]
                best = (miss[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                total = rest + along[rows, m, best]
                codes[:, m] = best
        return codes.astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Partial inner products: queries x bytes x 256, two subspaces to a byte."""
        t = np.einsum("qmd,mkd->qmk", self.split(queries), self.books)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(queries), -1, 256).astype(np.float32)


def pack(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def fit(x: np.ndarray, per_sub: int = 2, threshold: float = 0.2, rounds: int = 5, seed: int = 11) -> Quantiser:
    """Codebooks of subspaces of ``per_sub`` dimensions: k-means, then rounds of coding and of solving for all codewords at once.

    eta = (d - 1) T^2 / (1 - T^2): inner products above T times the norms matter.
    """
    n, d = x.shape
    n_sub = -(-d // per_sub)
    n_sub += n_sub % 2
    rng = np.random.default_rng(seed)
    q = Quantiser(np.zeros((n_sub, 16, per_sub)), max(1.0, (d - 1) * threshold**2 / (1 - threshold**2)))
    parts = q.split(x)
    for m in range(n_sub):
        book = parts[rng.choice(n, 16, replace=n < 16), m]
        for _ in range(10):
            near = ((parts[:, m, None] - book) ** 2).sum(-1).argmin(1)
            for k in np.unique(near):
                book[k] = parts[near == k, m].mean(0)
        q.books[m] = book
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    size = n_sub * 16 * per_sub
    for _ in range(rounds):
        codes = q.encode(x)
        where = ((np.arange(n_sub) * 16 + codes)[:, :, None] * per_sub + np.arange(per_sub)).reshape(n, -1)
        count = np.bincount(where.ravel(), minlength=size)
        goal = q.eta * np.bincount(where.ravel(), weights=parts.reshape(n, -1).ravel(), minlength=size)
        left = np.diag(count.astype(float))
        for at in range(0, n, 2048):
            v = np.zeros((min(2048, n - at), size))
            np.put_along_axis(v, where[at : at + 2048], unit.reshape(n, -1)[at : at + 2048], 1)
            left += (q.eta - 1) * (v.T @ v)
        used = count > 0
        books = q.books.reshape(-1).copy()
        books[used] = np.linalg.solve(left[np.ix_(used, used)] + 1e-9 * np.eye(used.sum()), goal[used])
        q.books = books.reshape(q.books.shape)
    return q


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("vec", odd) & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("vec") == (size["size"] if size else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def build_index(rows: DataFrame, fit_rows: int = 8000) -> tuple[DataFrame, Quantiser | None]:
    """Codes of all rows, in a written table; codebooks are fitted on about ``fit_rows`` rows."""
    total = rows.count()
    if not total:
        return rows.withColumn("code", F.lit(None).cast("binary")), None
    sample = rows.where(shared.unit_hash("id", seed=31) < min(1.0, fit_rows / total)).toArrow()
    if not sample.num_rows:
        sample = rows.limit(256).toArrow()
    order = np.argsort(sample.column("id").to_numpy(), kind="stable")
    quantiser = fit(matrix(sample.column("vec"))[order])
    held = rows.sparkSession.sparkContext.broadcast(quantiser)

    def code(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                packed = pack(held.value.encode(matrix(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "vec", "code"])

    return shared.materialize(rows.mapInArrow(code, "id bigint, vec array<double>, code binary"), "ann-index"), quantiser


class Best:
    """The ``k`` best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.scores, self.ids = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        top = np.lexsort((i, -s))[: self.scores.shape[1]]
        self.scores[q], self.ids[q] = s[top], i[top]


def scan_block(best: Best, own: np.ndarray, queries: np.ndarray, tables: np.ndarray, ids: np.ndarray, vecs: np.ndarray, codes: np.ndarray, rerank: int) -> None:
    """Offer each query its best rows of one block."""
    k = best.scores.shape[1]
    _, first, group = np.unique(np.ascontiguousarray(vecs).view(f"V{vecs.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, group.ravel()))
    begin = np.searchsorted(group.ravel()[order], np.arange(len(first) + 1))
    vecs, codes = vecs[first], codes[first]
    columns = np.ascontiguousarray(codes.T)
    for q in range(len(queries)):
        if len(first) > rerank:
            rough = tables[q, 0][columns[0]].copy()
            for j in range(1, len(columns)):
                rough += tables[q, j][columns[j]]
            near = np.argpartition(-rough, rerank - 1)[:rerank]
        else:
            near = np.arange(len(first))
        exact = vecs[near] @ queries[q]
        for u, s in ((near[t], exact[t]) for t in np.argsort(-exact, kind="stable")[: k + 1]):
            if s < best.scores[q, -1]:
                break
            some = ids[order[begin[u] : min(begin[u + 1], begin[u] + k + 1)]]
            some = some[some != own[q]]
            if len(some):
                best.offer(q, np.full(len(some), s), some)


def search(index: DataFrame, quantiser: Quantiser | None, queries: DataFrame, k: int = 20, rerank: int = 200, max_bytes: int = 8 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found.

    ``queries``: (id, vec). They are taken in blocks of at most ``max_bytes``
    of vectors; every block is sent to the executors, scans the whole index and
    is written before the next. Each task returns k rows a query, each block of
    the index gives ``rerank`` rows to exact scoring.
    """
    spark = index.sparkSession
    queries = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    width = 8 * (quantiser.padded if quantiser else 1)
    parts = max(1, -(-queries.count() * width // max_bytes))
    found = []
    for part in range(parts if quantiser else 0):
        some = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow()
        if not some.num_rows:
            continue
        held = spark.sparkContext.broadcast((some.column("id").to_numpy(), matrix(some.column("vec"))))

        def near(batches, held=held):
            own, wanted = held.value
            best = Best(len(own), k)
            seen = False
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    piece = b.slice(at, BLOCK)
                    codes = np.frombuffer(b"".join(piece.column(2).to_pylist()), np.uint8).reshape(piece.num_rows, -1)
                    ids, vecs = piece.column(0).to_numpy(), matrix(piece.column(1))
                    for first in range(0, len(own), 1024):  # tables of 1024 queries at a time
                        view = slice(first, first + 1024)
                        some = Best(0, k)
                        some.scores, some.ids = best.scores[view], best.ids[view]
                        scan_block(some, own[view], wanted[view], quantiser.tables(wanted[view]), ids, vecs, codes, rerank)
                    seen = True
            if seen:
                q, r = np.nonzero(best.scores > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(best.ids[q, r]), pa.array(best.scores[q, r])], names=["query_id", "vec_id", "score"])

        found.append(shared.materialize(index.mapInArrow(near, "query_id bigint, vec_id bigint, score double"), "ann-found"))
        held.unpersist()
    if not found:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    both = found[0]
    for f in found[1:]:
        both = both.union(f)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20, among all others."""
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    index, quantiser = build_index(rows)
    return search(index, quantiser, index.where("id % 20 = 0").select("id", "vec"))
