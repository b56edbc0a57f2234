"""Variational abundance inference: parameters on the driver, data passes on the cluster.

The prior of the latent log-abundances is a random walk over times by strain;
their posterior is Gaussian with a scale of its own for each time and strain and
no covariance, with a Gumbel-softmax switch for strains that are absent. Each
step needs, of the data, the value and gradient of

    sum over reads of log sum_s exp(log y_s + ll[s, r])

which one Arrow pass over the likelihood rows returns as a sum by time point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# ---- fragment lengths

def length_weights(reads: DataFrame, longest_marker: int, length: str = "len") -> DataFrame:
    """(len, weight): each read of length L counts (M - L + 1) times at L and twice at each L - b, b from 1 below L/2."""
    lens = reads.groupBy(F.col(length).cast("int").alias("l")).agg(F.count("*").alias("n"))
    whole = lens.select(F.col("l").alias("len"), (F.col("n") * (longest_marker - F.col("l") + 1)).alias("weight"))
    last = F.floor(F.col("l") / 2) - 1
    part = lens.where(last >= 1).select(F.explode(F.transform(F.sequence(F.lit(1), last.cast("int")), lambda b: F.col("l") - b)).alias("len"), (F.col("n") * 2).alias("weight"))
    return whole.unionByName(part).groupBy("len").agg(F.sum("weight").alias("weight"))


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), 0.0
    out = np.zeros_like(x)
    for _ in range(6):
        out -= 1 / x
        x = x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def fit_negative_binomial(values: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(n, p) of most likelihood; the mean fixes p, and n is the root of the score by bisection.

    Data no wider than Poisson get a large n.
    """
    w = weights / weights.sum()
    mean = float((w * values).sum())
    var = float((w * (values - mean) ** 2).sum())
    slope = lambda n: float((w * (digamma(values + n) - digamma(np.full_like(values, n, float)))).sum() + math.log(n / (n + mean)))
    low, high = 1e-3, 1e6
    n = high
    if var > mean:
        for _ in range(200):
            mid = math.sqrt(low * high)
            low, high = (mid, high) if slope(mid) > 0 else (low, mid)
        n = math.sqrt(low * high)
    return n, n / (n + mean)


# ---- data term

def data_blocks(marginal: DataFrame, times: dict, strains: dict) -> DataFrame:
    """``patterns`` of (t, read_id, strain_id, ll) with numbered times; rows of other times and strains are left out."""
    of_t = F.create_map([F.lit(x) for kv in times.items() for x in kv])
    return patterns(marginal.withColumn("t", of_t[F.col("t")]), strains).where(F.size("s") > 0)


def patterns(marginal: DataFrame, strains: dict) -> DataFrame:
    """(t, s array<int>, ll array<double>, n, more): reads of one pattern of likelihoods in one row, numbered strains.

    A pattern is a read's likelihoods less the greatest; ``n`` reads have it,
    and their greatest sum to ``more``. Reads of one pattern have the same
    gradient, and values that differ by their greatest alone. Reads of other
    strains only have the empty pattern.
    """
    of_s = F.create_map([F.lit(x) for kv in strains.items() for x in kv])
    rows = marginal.where("t is not null").select("t", "read_id", of_s[F.col("strain_id")].alias("s"), "ll")
    known = F.col("s").isNotNull()
    reads = rows.groupBy("t", "read_id").agg(F.array_sort(F.collect_list(F.when(known, F.struct("s", "ll")))).alias("x"), F.max(F.when(known, F.col("ll"))).alias("most"))
    less = F.transform("x", lambda x: F.when(x["ll"] == F.col("most"), 0.0).otherwise(x["ll"] - F.col("most")))  # two of -inf are equal, too
    reads = reads.select("t", F.transform("x", lambda x: x["s"]).alias("s"), less.alias("ll"), "most")
    return reads.groupBy("t", "s", "ll").agg(F.count("*").alias("n"), F.coalesce(F.sum("most"), F.lit(0.0)).alias("more"))


@dataclass
class Packed:
    """Patterns of one time, end to end: strain and likelihood of each entry, and of each pattern its first entry, reads and sum of the greatest."""

    s: np.ndarray
    ll: np.ndarray
    heads: np.ndarray
    n: np.ndarray
    more: float

    def value_and_gradient(self, log_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By sample (N), and by sample and strain (N x S)."""
        row = np.repeat(np.arange(len(self.n)), np.diff(np.append(self.heads, len(self.s))))
        value, grad = np.zeros(len(log_y)), np.zeros(log_y.shape)
        for i, y in enumerate(log_y):
            z = y[self.s] + self.ll
            top = np.maximum.reduceat(z, self.heads)
            e = np.exp(z - top[row])
            total = np.add.reduceat(e, self.heads)
            value[i] = ((top + np.log(total)) * self.n).sum() + self.more
            grad[i] = np.bincount(self.s, weights=e * (self.n / total)[row], minlength=log_y.shape[1])
        return value, grad


def _pack(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, Packed]]:
    """(t, patterns) of each time in rows of data blocks."""
    t = batch.column(0).to_numpy()
    size = pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
    n, more = batch.column(3).to_numpy().astype(float), batch.column(4).to_numpy()
    row = np.repeat(np.arange(len(t)), size)
    s, ll = (pc.list_flatten(batch.column(i)).to_numpy() for i in (1, 2))
    for k in np.unique(t):
        mine = t == k
        pick = mine[row]
        yield int(k), Packed(s[pick], ll[pick], np.cumsum(size[mine]) - size[mine], n[mine], float(more[mine].sum()))


def packed_blocks(blocks: DataFrame) -> DataFrame:
    """(t, s, ll, heads, n, more): data blocks as whole arrays, one row for each time and some 100000 patterns."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in _with_end(batches):
            if b is not None and b.num_rows:
                held.append(b)
                rows += b.num_rows
            if held and (b is None or rows >= 100_000):
                for k, p in _pack(pa.Table.from_batches(held).combine_chunks()):
                    arrays = [p.s.astype(np.int32), p.ll, p.heads.astype(np.int64), p.n]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays], pa.array([p.more])], names=["t", "s", "ll", "heads", "n", "more"])
                held, rows = [], 0

    return blocks.mapInArrow(pack, "t int, s binary, ll binary, heads binary, n binary, more double")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def data_pass(packed: DataFrame, log_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value by time and sample (T x N), and gradient by log y (T x N x S), of the read likelihood over packed blocks."""
    packed = packed if "heads" in packed.columns else packed_blocks(packed)
    held = packed.sparkSession.sparkContext.broadcast(log_y)
    n_t, n_n, n_s = log_y.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, some = held.value, False
        value, grad = np.zeros((n_t, n_n)), np.zeros((n_t, n_n, n_s))
        for b in batches:
            for i in range(b.num_rows):
                t = b.column(0)[i].as_py()
                arrays = [np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in ((1, np.int32), (2, float), (3, np.int64), (4, float))]
                v, g = Packed(*arrays, b.column(5)[i].as_py()).value_and_gradient(y[t])
                value[t] += v
                grad[t] += g
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([value.tobytes()], pa.binary()), pa.array([grad.tobytes()], pa.binary())], names=["value", "grad"])

    value, grad = np.zeros((n_t, n_n)), np.zeros((n_t, n_n, n_s))
    for r in packed.mapInArrow(part, "value binary, grad binary").collect():
        value += np.frombuffer(bytes(r["value"])).reshape(value.shape)
        grad += np.frombuffer(bytes(r["grad"])).reshape(grad.shape)
    held.unpersist()
    return value, grad


# ---- optimisation

@dataclass
class Adam:
    rate: float = 5e-3
    beta1: float = 0.9
    beta2: float = 0.999
    state: dict = field(default_factory=dict)
    step: int = 0

    def ascend(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            m, v = self.state.get(k, (np.zeros_like(g), np.zeros_like(g)))
            m, v = self.beta1 * m + (1 - self.beta1) * g, self.beta2 * v + (1 - self.beta2) * g * g
            self.state[k] = m, v
            params[k] = params[k] + self.rate * (m / (1 - self.beta1**self.step)) / (np.sqrt(v / (1 - self.beta2**self.step)) + 1e-8)


@dataclass
class Plateau:
    """Shrinks a learning rate when the objective stops to grow.

    An improvement must beat the best by ``threshold``, relative or absolute;
    after ``patience`` epochs without one the rate shrinks, then rests for
    ``cooldown`` epochs.
    """

    factor: float = 0.5
    patience: int = 5
    threshold: float = 1e-4
    relative: bool = True
    cooldown: int = 0
    min_rate: float = 1e-5
    best: float = -math.inf
    bad: int = 0
    rest: int = 0

    def update(self, value: float, rate: float) -> float:
        bar = self.best + (abs(self.best) * self.threshold if self.relative and math.isfinite(self.best) else self.threshold if not self.relative else 0.0)
        if value > bar:
            self.best, self.bad = value, 0
        else:
            self.bad += 1
        if self.rest:
            self.rest, self.bad = self.rest - 1, 0
        if self.bad > self.patience:
            self.bad, self.rest = 0, self.cooldown
            return max(rate * self.factor, self.min_rate)
        return rate


@dataclass
class Posterior:
    """Mean and scale of the latent (T x S), and the logit of each strain's presence (S)."""

    times: list
    strains: list
    mean: np.ndarray
    log_scale: np.ndarray
    presence: np.ndarray
    trace: list[float]

    def save(self, spark: SparkSession, path: str) -> None:
        """One row for each (time, strain), which ``load`` reads back."""
        kind = "bigint" if isinstance(self.strains[0], (int, np.integer)) else "string"
        rows = [(i, float(t), j, s, float(self.mean[i, j]), float(self.log_scale[i, j]), float(self.presence[j])) for i, t in enumerate(self.times) for j, s in enumerate(self.strains)]
        spark.createDataFrame(rows, f"i int, t double, j int, strain {kind}, mean double, log_scale double, presence double").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Posterior:
        rows = spark.read.parquet(path).orderBy("i", "j").collect()
        times, strains = [r.t for r in rows if r.j == 0], [r.strain for r in rows if r.i == 0]
        grid = lambda name: np.array([r[name] for r in rows]).reshape(len(times), len(strains))
        return cls(times, strains, grid("mean"), grid("log_scale"), grid("presence")[0], [])

    def inclusion(self) -> np.ndarray:
        return 1 / (1 + np.exp(-self.presence))

    def samples(self, n: int, seed: int = 314159) -> np.ndarray:
        """Abundances, T x n x S, each (t, n) summing to 1."""
        rng = np.random.Generator(np.random.PCG64(seed))
        x = self.mean[:, None] + np.exp(self.log_scale)[:, None] * rng.standard_normal((len(self.times), n, len(self.strains)))
        on = rng.random((n, len(self.strains))) < self.inclusion()
        on[~on.any(1)] = True
        x = np.where(on, x, -np.inf)
        e = np.exp(x - x.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True)


def elbo(params: dict, eps: np.ndarray, gumbel: np.ndarray, dt: np.ndarray, temperature: float, data, marker_len: np.ndarray, reads: np.ndarray, prior: float) -> tuple[float, dict]:
    """One Monte-Carlo estimate of the ELBO and its gradient, by the chain rule written out.

    Latent x = mean + scale eps; presence z relaxed by the logistic trick at
    ``temperature``; log y = log softmax(x + log z). The prior of x is the
    scale-free random walk; ``data(log_y)`` gives the read term; reads are
    normalised by the mean marker length under y.
    """
    mean, ls, pres = params["mean"], params["log_scale"], params["presence"]
    n_t, n_n, n_s = eps.shape
    scale = np.exp(ls)
    x = mean[:, None] + scale[:, None] * eps
    u = (pres + gumbel) / temperature  # n x s
    log_z = -np.logaddexp(0, -u)
    a = x + log_z
    top = a.max(2, keepdims=True)
    log_y = a - top - np.log(np.exp(a - top).sum(2, keepdims=True))
    y = np.exp(log_y)
    value, g = data(log_y)
    length = y @ marker_len  # mean marker length by t, n
    total = value.sum() / n_n - (reads[:, None] * np.log(length)).sum() / n_n
    g = g / n_n - reads[:, None, None] * (y * marker_len / length[:, :, None]) / n_n
    ga = g - y * g.sum(2, keepdims=True)
    gx = ga.copy()
    first = (x[0] ** 2).sum(1) + 1e-6
    total += -0.5 * n_s * np.log(first).mean()
    gx[0] -= n_s * x[0] / first[:, None] / n_n
    if n_t > 1:
        dx = np.diff(x, axis=0)
        walk = ((dx**2).sum(2) / dt[:, None]).sum(0) + 1e-6
        total += -0.5 * (n_t - 1) * n_s * np.log(walk).mean()
        pull = (n_t - 1) * n_s * dx / dt[:, None, None] / walk[:, None] / n_n
        gx[1:] -= pull
        gx[:-1] += pull
    total += ls.sum()
    p = 1 / (1 + np.exp(-pres))
    entropy = np.logaddexp(0, pres) - pres * p
    total += entropy.sum() + (p * math.log(prior) + (1 - p) * math.log1p(-prior)).sum()
    gu = ga.sum(0) * np.exp(-np.logaddexp(0, u))
    grads = {"mean": gx.sum(1), "log_scale": (gx * eps).sum(1) * scale + 1.0, "presence": gu.sum(0) / temperature + p * (1 - p) * (math.log(prior) - math.log1p(-prior) - pres)}
    return float(total), grads


def infer(marginal: DataFrame, marker_lengths: dict, epochs: int = 50, iterations: int = 5, samples: int = 4, rate: float = 0.05, prior: float = 0.5, seed: int = 314159, tolerance: float = 1e-5, max_local_rows: int = 1_000_000) -> Posterior:
    """Fit the posterior to (t, read_id, strain_id, ll).

    The input is read once. Its distinct patterns of likelihoods are cached on
    the cluster as whole arrays and each iteration is one job; with at most
    ``max_local_rows`` likelihoods in them they are fetched once, since a job's
    latency would then outweigh its work.
    """
    strains = sorted(marker_lengths)
    blocks = patterns(marginal, {s: i for i, s in enumerate(strains)}).persist()
    by_time = {r["t"]: r for r in blocks.groupBy("t").agg(F.sum(F.when(F.size("s") > 0, F.col("n")).otherwise(0)).alias("n"), F.sum(F.size("s")).alias("entries")).collect()}
    times = sorted(by_time)
    reads = np.array([by_time[t]["n"] for t in times], float)
    numbered = F.create_map([F.lit(x) for i, t in enumerate(times) for x in (t, i)])[F.col("t")] if times else F.lit(0)
    held = blocks.where(F.size("s") > 0).withColumn("t", numbered)
    if sum(r["entries"] for r in by_time.values()) <= max_local_rows:
        data = _local_data(held.toPandas(), len(times), len(strains))
    else:
        packed = packed_blocks(held).persist()
        packed.count()
        blocks.unpersist()
        blocks = packed
        data = lambda log_y: data_pass(packed, log_y)
    rng = np.random.Generator(np.random.PCG64(seed))
    shape = (len(times), len(strains))
    params = {"mean": rng.standard_normal(shape) * 0.01, "log_scale": np.full(shape, -2.0), "presence": np.zeros(shape[1])}
    dt = np.maximum(np.diff(np.array(times, float)), 1e-9) if len(times) > 1 else np.ones(0)
    lengths = np.array([float(marker_lengths[s]) for s in strains])
    adam, plateau, trace = Adam(rate), Plateau(), []
    for epoch in range(epochs):
        temperature, values = max(10 * 0.95**epoch, 0.01), []
        for _ in range(iterations):
            eps = rng.standard_normal((shape[0], samples, shape[1]))
            q = rng.random((samples, shape[1]))
            value, grads = elbo(params, eps, np.log(q) - np.log1p(-q), dt, temperature, data, lengths, reads, prior)
            adam.ascend(params, grads)
            values.append(value)
        trace.append(float(np.mean(values)))
        adam.rate = plateau.update(trace[-1], adam.rate)
        if adam.rate <= plateau.min_rate or epoch > 10 and abs(trace[-1] - trace[-2]) < tolerance * abs(trace[-2]):
            break
    blocks.unpersist()
    return Posterior(times, strains, params["mean"], params["log_scale"], params["presence"], trace)


def _local_data(pdf, n_t: int, n_s: int):
    parts = {}
    for t, g in pdf.groupby("t"):
        size = g["s"].map(len).to_numpy()
        parts[t] = Packed(np.concatenate(g["s"].to_list()).astype(int), np.concatenate(g["ll"].to_list()), np.cumsum(size) - size, g["n"].to_numpy(float), float(g["more"].sum()))

    def data(log_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, grad = np.zeros(log_y.shape[:2]), np.zeros(log_y.shape)
        for t, part in parts.items():
            value[t], grad[t] = part.value_and_gradient(log_y[t])
        return value, grad

    return data


# ---- importance-weight diagnostic

def fit_generalised_pareto(x: np.ndarray) -> tuple[float, float]:
    """(shape k, scale sigma) of exceedances by a profile-posterior mean over a grid of the one free parameter.

    The shape is drawn towards one half as by ten more observations.
    """
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = 20 + int(math.sqrt(n))
    quart = x[max(int(n / 4 + 0.5) - 1, 0)]
    theta = 1 / x[-1] + (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * quart)
    k = np.log1p(-theta[:, None] * x).mean(1)
    score = n * (np.log(-theta / k) - k - 1)
    w = np.exp(score - score.max())
    best = (theta * w).sum() / w.sum()
    shape = np.log1p(-best * x).mean()
    return float((n * shape + 5) / (n + 10)), float(-shape / best)


def tail_size(n: int) -> int:
    """How many of n weights are the tail, ties with the largest outside it apart."""
    return math.ceil(min(0.2 * n, 3 * math.sqrt(n)))


def psis_shape(weights: DataFrame, log_weight: str) -> tuple[int, float]:
    """(number of log weights, shape of their tail), as ``psis`` has it; nulls are no weights.

    All rows are counted and ranked on the executors; the tail, three times the
    root of their number, comes to the driver.
    """
    lw = weights.select(F.col(log_weight).cast("double").alias("v")).where("v is not null")
    n = lw.count()
    tail = tail_size(n)
    most = np.array([r[0] for r in lw.orderBy(F.desc("v")).limit(tail + 1).collect()])[::-1]
    if n <= tail or not n:
        return n, math.inf
    most -= most[-1]
    top = np.exp(most[most > most[0]]) - math.exp(most[0])
    return n, fit_generalised_pareto(top)[0] if len(top) >= 5 else math.inf


def psis(log_weights: np.ndarray, least: float = 1 / 3) -> tuple[np.ndarray, float]:
    """Smoothed, normalised log weights and the tail's shape.

    The weights above the tail's cut give way to quantiles of a fitted Pareto
    tail if its shape is ``least`` or more. With fewer than five of them the
    shape is infinite and nothing is smoothed.
    """
    lw = np.asarray(log_weights, float) - np.max(log_weights)
    n = len(lw)
    tail = tail_size(n)
    order = np.argsort(lw, kind="stable")
    shape = math.inf
    if n > tail:
        cut = lw[order[-tail - 1]]
        above = order[lw[order] > cut]
        if len(above) >= 5:
            shape, scale = fit_generalised_pareto(np.exp(lw[above]) - math.exp(cut))
            if shape >= least:
                q = (np.arange(1, len(above) + 1) - 0.5) / len(above)
                lw[above] = np.minimum(np.log(scale * np.expm1(-shape * np.log1p(-q)) / shape + math.exp(cut)), 0)
    return lw - (np.max(lw) + math.log(np.exp(lw - np.max(lw)).sum())), shape
