"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits; one linear classifier on hashed
byte 3-gram profiles predicts each bit; decoding picks the codeword with the
smallest loss, where a bit's loss is weighted by how well its classifier does
for that language on training rows kept aside.

Nulls, blanks and texts without a letter get ``und`` with score 0. Rows are
never merged: repeated rows and repeated ids give repeated results. An empty
table, or one without labelled rows, gives ``und`` for every row. Ties go to
the language that sorts first. Columns of the input that clash with an output
are replaced by the output.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladelake.llm import grams, shared

UND = "und"
LETTER = re.compile(r"[^\W\d_]")
OUTPUTS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("margin", T.DoubleType()),
    T.StructField("ambiguous", T.BooleanType()),
]


@dataclass
class EcocModel:
    """langs: classes; code: classes x bits of +1/-1; weights: bits; trust: weight of each bit's loss by class; scale: sharpness of scores."""

    langs: list[str]
    code: np.ndarray
    coef: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    scale: float
    n: int
    bits: int

    def margins(self, texts: pa.Array) -> np.ndarray:
        counts, total = grams.profiles(texts, self.n, self.bits)
        return grams.hellinger(counts, total) @ self.coef + self.bias

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each class's codeword, rows x classes."""
        m = np.clip(margins, -30, 30)
        pos, neg = np.logaddexp(0, -m), np.logaddexp(0, m)
        plus = self.code > 0
        return pos @ (self.trust * plus).T + neg @ (self.trust * ~plus).T


def codewords(classes: int, length: int | None = None, seed: int = 5) -> np.ndarray:
    """A codeword for each class.

    Up to 7 classes: the exhaustive code, every split of the classes once.
    Beyond: of 200 random codes of ``length`` bits (10 log2 classes by
    default), the one whose closest two rows differ most.
    """
    if classes == 1:
        return np.ones((1, 1), np.int8)
    if classes <= 7:
        cols = [[1, *c] for c in itertools.product((1, -1), repeat=classes - 1) if -1 in c]
        return np.array(cols, np.int8).T.copy()
    length = length or int(np.ceil(10 * np.log2(classes)))
    rng, best, kept = np.random.default_rng(seed), -1, None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), size=(classes, length))
        far = (length - code.astype(int) @ code.T.astype(int)) // 2
        np.fill_diagonal(far, length)
        if (d := far.min()) > best and not (np.abs(code.sum(0)) == classes).any():
            best, kept = d, code
    return kept if kept is not None else code


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.5, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions for all columns of ``y`` (+1/-1) at once, by Adam on the whole set."""
    n, d = x.shape
    w, b = np.zeros((d, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = np.zeros((d + 1, y.shape[1]), np.float32), np.zeros((d + 1, y.shape[1]), np.float32)
    for t in range(1, rounds + 1):
        g = (-y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))).astype(np.float32) / n
        grad = np.vstack((x.T @ g + l2 * w, g.sum(0)))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(x: np.ndarray, y: np.ndarray, n: int, bits: int) -> EcocModel:
    """The model of profiles and their languages."""
    langs = sorted(set(y))
    index = np.array([{k: i for i, k in enumerate(langs)}[v] for v in y])
    code = codewords(len(langs))
    aside = np.arange(len(y)) % 5 == 4
    if len(langs) == 1 or aside.sum() < 5 * len(langs):
        aside = np.zeros(len(y), bool)
    coef, bias = fit_linear(x[~aside], code[index[~aside]].astype(np.float32))
    check = aside if aside.any() else ~aside
    right = (x[check] @ coef + bias) * code[index[check]] > 0
    trust = np.stack([(right[index[check] == k].mean(0) if (index[check] == k).any() else right.mean(0)) for k in range(len(langs))])
    trust = np.maximum(trust, 1e-3)
    trust = trust / trust.sum(1, keepdims=True)
    model = EcocModel(langs, code, coef, bias, trust, 1.0, n, bits)
    if len(langs) > 1:  # the sharpness of scores that suits the rows kept aside best
        loss = model.losses(x[check] @ coef + bias)
        fits = {s: -np.log(np.maximum(softmax(-s * loss)[np.arange(check.sum()), index[check]], 1e-9)).mean() for s in (0.5, 1, 2, 4, 8)}
        model.scale = min(fits, key=fits.get)
    return model


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", key_col: str = "doc_id", per_class: int = 800, sample_rows: int = 40_000, n: int = 3, bits: int = 11) -> EcocModel | None:
    """Fit on at most about ``per_class`` rows of each language.

    With so many languages that this is more than ``sample_rows`` rows, fewer
    of each are taken, eight at least. Profiles of the sampled rows are made on
    the executors from whole texts, and one task there fits the model. Rows
    that repeat an id, a text and a language count once.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(key_col).cast("string").alias("key_"), F.col(label_col).cast("string").alias("label_"), F.col(text_col).cast("string").alias("text_"))
    classes = rows.select("label_").distinct().count()
    sample = shared.stratified(rows, "label_", ["key_", "text_"], min(per_class, max(8, sample_rows // max(classes, 1)))).distinct()

    def make():
        def step(texts: pa.Array) -> list:
            x = grams.hellinger(*grams.profiles(texts, n, bits)).astype(np.float16)
            return [pa.array([r.tobytes() for r in x], pa.binary())]

        return step

    def work(table: pa.Table) -> EcocModel:
        table = table.sort_by([("key_", "ascending"), ("label_", "ascending"), ("x", "ascending")])
        return fit(np.stack([np.frombuffer(r.as_py(), np.float16) for r in table["x"]]).astype(np.float32), np.array(table["label_"].to_pylist(), dtype=object), n, bits)

    made = shared.fit_on_executor(shared.map_texts(sample, "text_", ["label_", "key_"], [T.StructField("x", T.BinaryType())], make), work)
    return made[0] if made else None


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def identify(docs: DataFrame, model: EcocModel | None, text_col: str = "text", keep: list[str] | None = None, ambiguity: float = 0.1) -> DataFrame:
    """Predict each row's language.

    Adds ``lang_pred``, ``score`` (0 to 1), ``margin`` (the score less the next
    language's) and ``ambiguous`` (margin below ``ambiguity``).
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def make():
        model = held.value

        def step(texts: pa.Array) -> list:
            words = texts.to_pylist()
            known = np.array([bool(t) and LETTER.search(t) is not None for t in words], bool)
            if model is None or not known.any():
                return [pa.array([UND] * len(words)), np.zeros(len(words)), np.zeros(len(words)), np.ones(len(words), bool)]
            p = softmax(-model.scale * model.losses(model.margins(texts))).astype(np.float64)
            best = p.argmax(1)
            top = p[np.arange(len(p)), best]
            rest = p.copy()
            rest[np.arange(len(p)), best] = 0
            margin = np.where(known, top - rest.max(1), 0)
            return [pa.array([model.langs[b] if k else UND for b, k in zip(best, known, strict=True)]), np.where(known, top, 0), margin, margin < ambiguity]

        return step

    return shared.map_texts(docs, text_col, keep if keep is not None else docs.columns, OUTPUTS, make)


def with_letter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter, as ``identify`` sees it."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    seen = T.StructField("seen_", T.BooleanType())
    marked = shared.map_texts(docs.toDF(*names), text, names, [seen], lambda: lambda texts: [[bool(t) and LETTER.search(t) is not None for t in texts.to_pylist()]])
    return marked.where("seen_").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; learned where crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~shared.is_remainder("doc_id", 4, 2) & F.col("doc_id").isNotNull()))
    scored = identify(docs, model, keep=["doc_id"])
    return scored.select("doc_id", shared.is_remainder("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "margin", "ambiguous")
