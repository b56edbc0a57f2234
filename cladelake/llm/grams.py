"""Hashed byte n-gram profiles of whole texts, in numpy over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cladelake.llm.shared import buffers

_rng = np.random.default_rng(20240611)
#: One random table for each place in an n-gram; XOR of the looked-up values is the hash.
TABLES = _rng.integers(0, 1 << 32, size=(8, 256), dtype=np.uint32)
#: Bytes of one text that are hashed at a time.
PIECE = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def hashes(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n-gram at each position; shorter than n: none."""
    if len(data) < n:
        return np.zeros(0, np.uint32)
    m = len(data) - n + 1
    h = TABLES[0][data[:m]]
    for j in range(1, n):
        h ^= TABLES[j][data[j : m + j]]
    return h & np.uint32((1 << bits) - 1)


def profiles(texts: pa.Array, n: int, bits: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed byte n-grams: a row for each text, and each row's sum.

    Each text is padded by one blank at either end, so that one-letter texts
    have n-grams too; an empty text's row is zero.
    """
    data, offsets = buffers(texts)
    rows = len(offsets) - 1
    counts = np.zeros((rows, 1 << bits), np.float32)
    if lower:
        data = LOWER[data]
    pad = np.full(1, 32, np.uint8)
    for i in range(rows):
        a, b = offsets[i], offsets[i + 1]
        if b > a:
            padded = np.concatenate((pad, data[a:b], pad))
            for at in range(0, len(padded), PIECE):  # pieces overlap by n - 1 bytes
                counts[i] += np.bincount(hashes(padded[at : at + PIECE + n - 1], n, bits), minlength=1 << bits)
    return counts, counts.sum(axis=1)


def hellinger(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies: rows of unit length."""
    return np.sqrt(counts / np.maximum(total, 1)[:, None], dtype=np.float32)
