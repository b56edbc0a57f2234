"""Document quality by positive-unlabelled learning with a non-negative risk.

Trusted positives are documents labelled of good quality; the unlabelled web
text is a sample of all documents, whatever their labels. The class prior is
estimated by the best bin: a first classifier of positives against unlabelled
text ranks both, and the prior is the smallest ratio of unlabelled to positive
rows above a threshold. A linear model on hashed byte 3-grams and a few
statistics of the whole text then minimises the non-negative unbiased risk
prior * R+(p) + max(0, R-(u) - prior * R-(p)).

Nulls and blanks get the score of an all-zero profile. Repeated rows give
repeated results; an empty table gives an empty result; without positives
every score is 0. Input columns that clash with an output give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladelake.llm import grams, shared

OUTPUTS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
KINDS = np.zeros(256, np.uint8)  # 0 other, then blank, lower, upper, digit, beyond ASCII, line end
KINDS[[32, 9, 11, 12]] = 1
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[128:], KINDS[[10, 13]] = 2, 3, 4, 5, 6


def features(texts: pa.Array, bits: int) -> np.ndarray:
    """Profile roots, and statistics that tell what a profile's shape is like."""
    counts, total = grams.profiles(texts, 3, bits, lower=False)
    roots = grams.hellinger(counts, total)
    data, offsets = shared.buffers(texts)
    kinds = KINDS[data]
    stats = np.zeros((len(texts), 12), np.float32)
    for i in range(len(texts)):
        part = kinds[offsets[i] : offsets[i + 1]]
        if len(part):
            share = np.bincount(part, minlength=7) / len(part)
            stats[i, :7] = np.sqrt(share)
    p = counts / np.maximum(total, 1)[:, None]
    stats[:, 7] = np.log1p(total) / 10
    stats[:, 8] = -(p * np.log(np.maximum(p, 1e-12))).sum(1) / 8  # entropy of the profile
    stats[:, 9] = np.sqrt((p * p).sum(1))
    stats[:, 10] = (counts > 0).sum(1) / np.maximum(np.minimum(total, 1 << bits), 1)  # distinct grams
    stats[:, 11] = stats[:, 8] * stats[:, 7]
    return np.hstack((roots, stats))


@dataclass
class PuModel:
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    bias: float
    prior: float
    bits: int

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.prior <= 0:
            return np.zeros(len(texts))
        z = ((features(texts, self.bits) - self.mean) * self.scale) @ self.coef + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40).astype(np.float64)))


def descend(p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int, rate: float = 0.01, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear model by Adam on all rows. Without a prior: positives against unlabelled, as equals.

    With one: the non-negative risk of the logistic loss; while the part that
    cannot be negative is, the step goes against that part alone.
    """
    d = p.shape[1]
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        up, down_u = (sig(zp) - 1) / len(p), sig(zu) / len(u)
        if prior is None:
            gp, gu = up, down_u
        else:
            down_p = sig(zp) / len(p)
            if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
                gp, gu = prior * up - prior * down_p, down_u
            else:
                gp, gu = prior * down_p, -down_u
        g = np.append(p.T @ gp + u.T @ gu + l2 * w[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def best_bin(p: np.ndarray, u: np.ndarray) -> float:
    """Prior from rankings of held-back rows: least ratio of the shares of unlabelled and positive rows above a threshold, confidence bounds added."""
    cut = np.quantile(p, np.linspace(0, 0.9, 46))
    qp = np.array([(p >= c).mean() for c in cut])
    qu = np.array([(u >= c).mean() for c in cut])
    slack = np.sqrt(np.log(20) / (2 * len(u))) + np.sqrt(np.log(20) / (2 * len(p)))
    at = int(np.argmin((qu + slack) / qp))
    return float(np.clip(qu[at] / qp[at], 0.02, 0.98))


def fit(p: np.ndarray, u: np.ndarray, bits: int, rounds: int) -> PuModel:
    """The model of trusted and unlabelled features."""
    width = (1 << bits) + 12
    if not len(p) or not len(u):
        return PuModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0, bits)
    x = np.vstack((p, u))
    mean = x.mean(0)
    scale = (1 / (x.std(0) + 0.02)).astype(np.float32)
    scale[: 1 << bits] /= 8  # profiles count for about as much as the statistics
    p, u = (p - mean) * scale, (u - mean) * scale
    half = lambda a, k: a[np.arange(len(a)) % 2 == k] if len(a) > 1 else a
    w, b = descend(half(p, 0), half(u, 0), None, rounds // 2)
    prior = best_bin(half(p, 1) @ w + b, half(u, 1) @ w + b)
    w, b = descend(p, u, prior, rounds)
    return PuModel(mean, scale, w, b, prior, bits)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", key_col: str = "doc_id", label_col: str = "quality", positives: int = 2500, unlabelled: int = 4000, bits: int = 10, rounds: int = 300) -> PuModel:
    """Fit on at most about ``positives`` trusted rows and ``unlabelled`` rows of ``docs``.

    Features of sampled rows are made on the executors from whole texts, and
    one task there fits the model. Rows that repeat an id and a text count once.
    """
    trusted = shared.stratified(labels.where((F.col(label_col) == 1) & F.col(key_col).isNotNull()).select(key_col, label_col).distinct(), label_col, key_col, positives)
    total = max(docs.count(), 1)
    plain = docs.select(F.col(key_col).alias("key_"), F.col(text_col).cast("string").alias("text_"))
    web = plain.where(shared.unit_hash("key_", "text_", seed=23) < unlabelled / total).withColumn("kind_", F.lit(0)).distinct()
    good = plain.where("text_ is not null").join(F.broadcast(trusted.select(F.col(key_col).alias("key_"))), "key_").withColumn("kind_", F.lit(1)).distinct()
    good = shared.stratified(shared.materialize(good, "quality-trusted"), "kind_", ["key_", "text_"], positives)
    sample = web.unionByName(good).withColumn("key_", F.col("key_").cast("string"))

    def make():
        return lambda texts: [pa.array([r.tobytes() for r in features(texts, bits).astype(np.float32)], pa.binary())]

    def work(table: pa.Table) -> PuModel:
        table = table.sort_by([("kind_", "ascending"), ("key_", "ascending"), ("x", "ascending")])
        kind = table["kind_"].to_numpy()
        x = np.stack([np.frombuffer(r.as_py(), np.float32) for r in table["x"]])
        return fit(x[kind == 1], x[kind == 0], bits, rounds)

    made = shared.fit_on_executor(shared.map_texts(sample, "text_", ["key_", "kind_"], [T.StructField("x", T.BinaryType())], make), work)
    return made[0] if made else fit(np.zeros((0, 0)), np.zeros((0, 0)), bits, rounds)


def score(docs: DataFrame, model: PuModel, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if the score is ``threshold`` or more)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def step(texts: pa.Array) -> list:
            s = model.scores(texts)
            return [s, (s >= threshold).astype(np.int32)]

        return step

    return shared.map_texts(docs, text_col, keep if keep is not None else docs.columns, OUTPUTS, make)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; labels learned where crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~shared.is_remainder("doc_id", 5, 0)))
    return score(docs, model, keep=["doc_id"]).select("doc_id", shared.is_remainder("doc_id", 5, 0).alias("held_out"), "score", "predicted")
