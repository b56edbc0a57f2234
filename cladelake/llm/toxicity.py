"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of its hashed byte n-grams (3, 5
and 7 bytes, word boundaries included), a window's vector the mean over its words;
embeddings and the softmax are trained jointly in numpy. Labels belong to whole
documents while insults are a few words among many, so windows of ``window``
words are what is averaged. A first round learns from single words, each
counted once a document: what only one toxic document has stays near the
prior, what many have stands out. A second round learns from windows, of toxic
documents those whose best word stands above nearly all windows of clean ones.
Over all windows of the whole text, the highest logit and the mean softmax
output give the document's score by a logistic curve, fitted on the sample's
documents as the model of all sees them and as one sees them from which their
half of the sample was held aside.

Nulls, blanks and texts without a word score as the model's bias does alone, a
low value. Repeated rows give repeated results; an empty table gives an empty
result; without labels of both kinds every score is the share of toxic labels
(0 if there are none). Input columns that clash with an output give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladelake.llm import grams, shared

SIZES = (3, 5, 7)
OUTPUTS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
#: Bytes of words: digits, letters (A-Z as a-z) and all beyond ASCII; the rest is a blank.
WORD_BYTES = np.full(256, 32, np.uint8)
for _lo, _hi in ((48, 58), (97, 123), (128, 256)):
    WORD_BYTES[_lo:_hi] = np.arange(_lo, _hi)
WORD_BYTES[65:91] = np.arange(97, 123)


def subwords(buffer: np.ndarray, bits: int) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Words in a normalised buffer that starts and ends with a blank, and for each
    n-gram size the owning word and the hash of every n-gram whose inner bytes lie in one word."""
    inside = buffer != 32
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    word = np.cumsum(starts, dtype=np.int32) - 1
    found, run, deep = [], inside[1:].copy(), 1
    for k, n in enumerate(SIZES):
        m = len(buffer) - n + 1
        if m <= 0:
            break
        run = run[:m]
        while deep < n - 2:  # the n - 2 inner bytes
            deep += 1
            run = run & inside[deep : deep + m]
        at = np.flatnonzero(run)
        found.append((word[at + 1], grams.hashes(buffer, n, bits)[at] + np.uint32(k << bits)))
    return int(starts.sum()), found


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blank-separated word bytes of all rows, and where each row starts."""
    at = offsets + np.arange(len(offsets)) + 1
    out = np.full(len(data) + len(offsets), 32, np.uint8)
    data = WORD_BYTES[data]
    for i in range(len(offsets) - 1):
        out[at[i] : at[i] + offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
    return out, at


FLAT = np.array([1.0, 0.0, 0.0])


@dataclass
class SubwordModel:
    """weight: each subword's share of the logit; bias; curve: from a text's window summary to the score's logit."""

    weight: np.ndarray
    bias: float
    curve: np.ndarray
    bits: int
    window: int
    constant: float | None = None

    def word_logits(self, buffer: np.ndarray) -> np.ndarray:
        """Each word's vector times the softmax's difference of weights."""
        parts, at, piece = [], 0, shared.CHUNK_BYTES
        while at < len(buffer) - 1:
            end = min(at + piece, len(buffer))
            if end < len(buffer):  # pieces end at a blank, which the next one starts with
                blank = np.flatnonzero(buffer[at + 1 : end] == 32)
                if len(blank):
                    end = at + 2 + int(blank[-1])
                else:
                    later = np.flatnonzero(buffer[end:] == 32)
                    end = end + 1 + int(later[0])
            words, found = subwords(buffer[at:end], self.bits)
            total, count = np.zeros(words), np.zeros(words)
            for owner, h in found:
                total += np.bincount(owner, weights=self.weight[h], minlength=words)
                count += np.bincount(owner, minlength=words)
            parts.append(total / np.maximum(count, 1))
            at = end - 1
        return np.concatenate(parts) if parts else np.zeros(0)

    def summary(self, texts: pa.Array) -> np.ndarray:
        """For each text the highest window logit, the log of the mean window probability, and 1."""
        data, offsets = shared.buffers(texts)
        buffer, at = normalised(data, offsets)
        inside = buffer != 32
        inside[1:] &= buffer[:-1] == 32
        first = np.concatenate(([0], np.cumsum(inside)))[at]  # words before each row
        s = np.concatenate(([0.0], np.cumsum(self.word_logits(buffer))))
        n, w = np.diff(first), self.window
        top, mean = np.full(len(n), self.bias), np.zeros(len(n))
        short = (n > 0) & (n <= w)
        top[short] += (s[first[1:]] - s[first[:-1]])[short] / n[short]
        mean[short] = sigmoid(top[short])
        if (long := n > w).any():
            z = (s[w:] - s[:-w]) / w + self.bias
            inside = np.arange(len(z)) + w <= np.repeat(first[1:], n)[: len(z)]  # windows that do not run into the next row
            z[~inside] = -np.inf
            heads = first[:-1][long]
            top[long] = np.maximum.reduceat(z, heads)
            sums = np.concatenate(([0.0], np.cumsum(sigmoid(z))))
            ends = first[1:][long] - w + 1
            mean[long] = (sums[ends] - sums[heads]) / (ends - heads)
        return np.stack((top, np.log(mean + 1e-3), np.ones(len(n))), 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return sigmoid(self.summary(texts) @ self.curve)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic_curve(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Weights of P(y | x), the last column of ``x`` being 1, by Newton's method with a small ridge.

    Rows count so that a share ``prior`` of them is positive, as among all labels.
    """
    each = np.where(y > 0, prior / max(1, (y > 0).sum()), (1 - prior) / max(1, (y <= 0).sum())) * len(y)
    mean, sd = x[:, :-1].mean(0), x[:, :-1].std(0) + 1e-9
    z, p, ridge = np.column_stack(((x[:, :-1] - mean) / sd, np.ones(len(x)))), np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2)
    ridge[-1] = 1e-6
    for _ in range(50):
        q = sigmoid(z @ p)
        h = (z * (each * q * (1 - q))[:, None]).T @ z + np.diag(ridge)
        p = p - np.linalg.solve(h, z.T @ (each * (q - y)) + ridge * p)
    a = p[:-1] / sd
    return np.append(a, p[-1] - a @ mean)


def rising_curve(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """The curve of ``logistic_curve`` without the columns that would lower the score as they rise."""
    use, end = list(range(x.shape[1] - 1)), x.shape[1] - 1
    while True:
        curve = logistic_curve(x[:, [*use, end]], y, prior)
        if len(use) < 2 or curve[:-1].min() >= 0:
            break
        use.pop(int(curve[:-1].argmin()))
    out = np.zeros(end + 1)
    out[[*use, end]] = curve
    return out


def summed(place: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows that go to each of ``n`` places."""
    dim = rows.shape[1]
    flat = (place[:, None] * dim + np.arange(dim)).ravel()
    return np.bincount(flat, weights=rows.ravel(), minlength=n * dim).reshape(n, dim).astype(np.float32)


def embed(bags: list[list[bytes]], weight: np.ndarray, bits: int, dim: int, epochs: int, rate: float, batch: int = 512, seed: int = 3) -> tuple[np.ndarray, float]:
    """Train embeddings and softmax jointly; returns each subword's logit weight and the bias.

    ``weight`` has, for each bag of words, how much it counts as clean and as
    toxic. The step of a row shrinks with its own past gradients (Adagrad).
    """
    vocab = {w: i for i, w in enumerate(dict.fromkeys(x for ws in bags for x in ws))}
    buffer = np.frombuffer(b" " + b" ".join(vocab) + b" ", np.uint8)
    n_words, found = subwords(buffer, bits)
    owner, gram = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(owner, kind="stable")
    gram, per = gram[order], np.bincount(owner, minlength=n_words)
    begin = np.concatenate(([0], np.cumsum(per)))
    size = np.fromiter(map(len, bags), np.int64, len(bags))
    flat_ids, bag_at = np.fromiter((vocab[x] for ws in bags for x in ws), np.int64, int(size.sum())), np.concatenate(([0], np.cumsum(size)))
    rng = np.random.default_rng(seed)
    rows = len(SIZES) << bits
    e = (rng.standard_normal((rows, dim)) * 0.1).astype(np.float32)
    seen = np.full(rows, 1e-4, np.float32)
    u, u_seen = (rng.standard_normal((dim, 2)) * 0.1).astype(np.float32), 1e-4
    b, b_seen = np.zeros(2, np.float32), 1e-4
    weight = (weight / weight.sum(1).mean()).astype(np.float32)
    for _ in range(epochs):
        turn = rng.permutation(len(bags))
        for at in range(0, len(turn), batch):
            pick = turn[at : at + batch]
            n = size[pick]
            edges = np.cumsum(n) - n
            used, place = np.unique(flat_ids[np.repeat(bag_at[pick] - edges, n) + np.arange(n.sum())], return_inverse=True)
            count = per[used]
            heads = np.cumsum(count) - count
            g = gram[np.repeat(begin[used] - heads, count) + np.arange(count.sum())]
            vec = np.add.reduceat(e[g], heads, axis=0) / count[:, None]
            mean = np.add.reduceat(vec[place], edges, axis=0) / n[:, None]
            z = mean @ u + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w = weight[pick]
            p = (p * w.sum(1, keepdims=True) - w) / len(pick)
            du, db, dm = mean.T @ p, p.sum(0), p @ u.T
            dv = summed(place, np.repeat(dm / n[:, None], n, axis=0), len(used))
            rows_g, where = np.unique(g, return_inverse=True)
            de = summed(where, np.repeat(dv / count[:, None], count, axis=0), len(rows_g))
            seen[rows_g] += (de * de).mean(1)
            e[rows_g] -= rate * de / np.sqrt(seen[rows_g])[:, None]
            u_seen, b_seen = u_seen + (du * du).mean(), b_seen + (db * db).mean()
            u -= rate * du / np.sqrt(u_seen)
            b -= rate * db / np.sqrt(b_seen)
    logit = (e @ (u[:, 1] - u[:, 0])).astype(np.float32)
    known = np.zeros(rows, bool)
    known[gram] = True
    return np.where(known, logit, np.float32(0)), float(b[1] - b[0])  # a subword never seen says nothing


def summaries(model: SubwordModel, texts: list[bytes]) -> np.ndarray:
    return np.concatenate([model.summary(pa.array(texts[i : i + 256], pa.binary())) for i in range(0, len(texts), 256)])


def fit(texts: list[bytes], y: np.ndarray, window: int, bits: int, dim: int, clean: float = 0.999) -> SubwordModel | None:
    """Both rounds over whole documents, the curve left out; None without words of both kinds."""
    words = [WORD_BYTES[np.frombuffer(t, np.uint8)].tobytes().split() for t in texts]
    seen: dict[bytes, list[int]] = {}
    for ws, k in zip(words, y, strict=True):
        for w in dict.fromkeys(ws):
            seen.setdefault(w, [0, 0])[k] += 1
    weight = np.array(list(seen.values()), float).reshape(-1, 2)
    if not (weight.sum(0) > 0).all():
        return None
    model = SubwordModel(*embed([[w] for w in seen], weight, bits, dim, epochs=30, rate=0.2), FLAT, bits, 1)
    kinds = np.array([k for ws, k in zip(words, y, strict=True) for _ in range(0, len(ws), window)])
    bags = [ws[j : j + window] for ws in words for j in range(0, len(ws), window)]
    logit = dict(zip(seen, model.word_logits(np.frombuffer(b" " + b" ".join(seen) + b" ", np.uint8)).tolist(), strict=True))
    best = np.array([max(logit[w] for w in bag) for bag in bags])
    keep = (kinds == 0) | (best > np.quantile(best[kinds == 0], clean))
    if (kinds[keep] == 1).sum() < 10:  # too few to learn windows from
        return model
    bags, kinds = [b for b, k in zip(bags, keep, strict=True) if k], kinds[keep]
    share = np.array([len(kinds) / (2 * max(1, (kinds == k).sum())) for k in (0, 1)])  # both classes weigh the same
    return SubwordModel(*embed(bags, np.eye(2)[kinds] * share, bits, dim, epochs=5, rate=0.5), FLAT, bits, window)


def train(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", key_col: str = "doc_id", label_col: str = "toxic",
    per_class: int = 1000, window: int = 2, bits: int = 16, dim: int = 8,
) -> SubwordModel:
    """Fit on at most about ``per_class`` labelled documents of each kind, all of their text.

    Three tasks on the executors train: without either half of the sample,
    whose summaries fit the curve, and on all of it. Rows that repeat an id
    and a text count once.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(key_col).isNotNull()).select(key_col, F.col(label_col).cast("int").alias("y_")).distinct()
    few = F.broadcast(shared.stratified(known, "y_", key_col, per_class).select(F.col(key_col).alias("key_"), "y_"))
    found = docs.select(F.col(key_col).alias("key_"), F.col(text_col).cast("string").alias("text_")).where("text_ is not null").join(few, "key_")
    found = shared.materialize(found.distinct(), "toxic-rows")
    sample = shared.stratified(found, "y_", ["key_", "text_"], per_class, seed=2).select(F.col("key_").cast("string").alias("key_"), "text_", "y_", (shared.unit_hash("key_", "text_", seed=3) * 2).cast("int").alias("fold_"))

    def work(table: pa.Table) -> tuple:
        table = table.sort_by([("key_", "ascending"), ("y_", "ascending"), ("text_", "ascending")])
        texts, y, fold, turn = [t.encode() for t in table["text_"].to_pylist()], table["y_"].to_numpy(), table["fold_"].to_numpy(), table["turn_"][0].as_py()
        mine = fold != turn
        model = fit([t for t, m in zip(texts, mine, strict=True) if m], y[mine], window, bits, dim)
        judged = ~mine if turn < 2 else mine
        aside = [t for t, m in zip(texts, judged, strict=True) if m]
        return model, y[judged], summaries(model, aside) if model and aside else np.zeros((0, 3)), set(y.tolist())

    made = shared.fit_on_executor(sample.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("turn_")), work, "turn_", 3)
    if not made or made[-1][0] is None:
        kinds = made[-1][3] if made else set()
        return SubwordModel(np.zeros(len(SIZES) << bits, np.float32), 0.0, FLAT, bits, window, float(sum(kinds)) if len(kinds) == 1 else float(known.agg(F.avg("y_")).first()[0] or 0))
    # each row counts twice: as one held aside, whose windows look too tame, and as one learned from, whose windows look too wild
    y, x = (np.concatenate(z) for z in zip(*[m[1:3] for m in made if m[0] is not None], strict=True))
    model = made[-1][0]
    model.curve = rising_curve(x, y.astype(float), known.agg(F.avg("y_")).first()[0])
    return model


def score(docs: DataFrame, model: SubwordModel, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if the score is ``threshold`` or more)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def step(texts: pa.Array) -> list:
            s = model.scores(texts)
            return [s, (s >= threshold).astype(np.int32)]

        return step

    return shared.map_texts(docs, text_col, keep if keep is not None else docs.columns, OUTPUTS, make)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels learned where crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~shared.is_remainder("doc_id", 4, 2)))
    return score(docs, model, keep=["doc_id"]).select("doc_id", shared.is_remainder("doc_id", 4, 2).alias("held_out"), "score", "predicted")
