"""Base qualities: decoding, expected errors, read-against-fragment likelihood."""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ASCII offsets of the quality encodings.
OFFSETS = {"fastq": 33, "fastq-sanger": 33, "fastq-illumina": 64, "fastq-solexa": 64}


def decode(quality: Column, encoding: str = "fastq") -> Column:
    """Phred scores of a quality string; Solexa scores are converted."""
    if encoding not in OFFSETS:
        raise ValueError(f"unknown quality format: {encoding}")
    offset = OFFSETS[encoding]
    scores = F.transform(F.split(quality, ""), lambda c: (F.ascii(c) - offset).cast("double"))
    if encoding == "fastq-solexa":
        scores = F.transform(scores, lambda q: 10 * F.log10(F.pow(F.lit(10.0), q / 10) + 1))
    return F.when(F.length(quality) > 0, scores).otherwise(F.array().cast("array<double>"))


def encode(scores: Column) -> Column:
    """Sanger quality string of Phred scores."""
    return F.array_join(F.transform(scores, lambda q: F.char(F.round(q).cast("int") + 33)), "")


def expected_errors(scores: Column) -> Column:
    """Sum of 10^(-q/10)."""
    return F.aggregate(scores, F.lit(0.0), lambda s, q: s + F.pow(F.lit(10.0), -q / 10))


def _error_terms(read: np.ndarray, fragment: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Each base's term; see ``error_log_likelihood``."""
    same = read == fragment
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = np.where(scores > 0, np.log1p(-(10.0 ** (-scores / 10))), 0.0)
    return np.where(same, hit, np.where(read != ord("N"), -math.log(3) - scores * (math.log(10) / 10), 0.0))


@F.pandas_udf(T.DoubleType())
def error_log_likelihood(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Log-likelihood of aligned bases (read, fragment, scores): a match at q > 0 is log(1 - 10^(-q/10)), a
    mismatch with a read base other than N is -log 3 - q log(10)/10, anything else 0.

    Null where an argument is; lengths that differ raise. All bases of an
    Arrow batch are one array, as an expression a base would be interpreted.
    """
    for read, fragment, scores in batches:
        ok = ~(read.isna() | fragment.isna() | scores.isna())
        r, f, q = (x[ok].tolist() for x in (read, fragment, scores))
        size = np.array([len(x) for x in r], np.int64)
        if any(len(x) != n or len(y) != n for x, y, n in zip(f, q, size, strict=True)):
            raise ValueError("read, fragment and scores differ in length")
        out = np.full(len(read), np.nan)
        total = np.zeros(len(size))
        if size.sum():
            flat = [np.frombuffer("".join(x).encode("ascii"), np.uint8) for x in (r, f)]
            terms = _error_terms(*flat, np.concatenate([np.asarray(x, float) for x in q]))
            total[size > 0] = np.add.reduceat(terms, (np.cumsum(size) - size)[size > 0])
        out[ok.to_numpy()] = total
        yield pd.Series(out)


def indel_log_likelihood(insertions: Column, deletions: Column, log_insert: float, log_delete: float, paired: bool = False) -> Column:
    """Indel term; single-end reads also pay for the inserted base, paired ones do not."""
    base = 0.0 if paired else math.log(4)
    return insertions * (log_insert - base) + deletions * log_delete


def noiseless_log_likelihood(read: Column, fragment: Column, gaps: Column, mismatch: float = 1e-20) -> Column:
    """log(1 - mismatch) where read and fragment are equal without gaps, log mismatch elsewhere (-inf for 0)."""
    other = math.log(mismatch) if mismatch else -math.inf
    return F.when((gaps == 0) & (read == fragment), math.log1p(-mismatch)).otherwise(other)
