"""Nucleotide strings as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nucleotide alphabet and its codes.
ALPHABET = "ACGTN-"
CODES = "012345"


def encode(seq: Column) -> Column:
    """Digits 0 to 5 for A, C, G, T, N and gap, in either case; any other letter raises."""
    upper = F.upper(seq)
    return F.when(seq.isNull() | upper.rlike("^[ACGTN-]*$"), F.translate(upper, ALPHABET, CODES)).otherwise(F.raise_error(F.concat(F.lit("unknown nucleotide in "), seq)))


def decode(codes: Column) -> Column:
    return F.translate(codes, CODES, ALPHABET)


def reverse_complement(seq: Column) -> Column:
    """N and gap stay as they are."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def count_letter(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def subsequence(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """1-based inclusive cut, reverse-complemented on strand '-'."""
    cut = F.substring(seq, start, end - start + 1)
    return F.when(strand == "-", reverse_complement(cut)).otherwise(cut)


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; none when the sequence is shorter."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of equal length; raises when lengths differ."""
    same = F.length(a) == F.length(b)
    return F.when(same, F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, d: s + d)).otherwise(F.raise_error(F.lit("lengths differ")))
