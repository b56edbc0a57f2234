import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cladelake.functions import alignment as al
from cladelake.functions import numeric as nm
from cladelake.functions import quality as ql
from cladelake.functions import sequences as sq


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_sequences(spark):
    assert one(spark, sq.reverse_complement(F.col("s")), s="ACGTN-") == "-NACGT"
    assert one(spark, sq.encode(F.col("s")), s="ACGTn-") == "012345"
    assert one(spark, sq.decode(F.col("s")), s="012345") == "ACGTN-"
    assert one(spark, sq.count_letter(F.col("s"), "N"), s="ANNA") == 2
    assert one(spark, sq.subsequence(F.col("s"), F.lit(2), F.lit(4), F.lit("-")), s="AACGT") == "CGT"
    assert one(spark, sq.kmers(F.col("s"), 3), s="ACGT") == ["ACG", "CGT"]
    assert one(spark, sq.kmers(F.col("s"), 5), s="ACGT") == []
    assert one(spark, sq.hamming(F.col("a"), F.col("b")), a="ACGT", b="AGGA") == 2
    for column, values in ((sq.encode(F.col("s")), {"s": "ACX"}), (sq.hamming(F.col("a"), F.col("b")), {"a": "A", "b": "AC"})):
        with pytest.raises(PySparkException):
            one(spark, column, **values)


def test_reverse_complement_is_its_own_inverse(spark):
    seqs = ["".join(np.random.default_rng(i).choice(list("ACGTN-acgt"), i)) for i in range(1, 30)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    assert df.where(sq.reverse_complement(sq.reverse_complement(F.col("s"))) != F.col("s")).count() == 0


def test_quality(spark):
    assert one(spark, ql.decode(F.col("q")), q="!I") == [0, 40]
    assert one(spark, ql.decode(F.col("q"), "fastq-illumina"), q="@h") == [0, 40]
    assert one(spark, ql.decode(F.col("q"), "fastq-solexa"), q=";")[0] == pytest.approx(10 * math.log10(10 ** (-0.5) + 1))
    assert one(spark, ql.encode(ql.decode(F.col("q"))), q="!5I") == "!5I"
    assert one(spark, ql.decode(F.col("q")), q="") == []
    assert one(spark, ql.expected_errors(ql.decode(F.col("q"))), q="+5") == pytest.approx(0.11)
    with pytest.raises(ValueError):
        ql.decode(F.col("q"), "other")


def test_error_log_likelihood(spark):
    got = one(spark, ql.error_log_likelihood(F.lit("AC"), F.lit("AG"), F.array(F.lit(10.0), F.lit(20.0))))
    assert got == pytest.approx(math.log(0.9) - math.log(3) - 2 * math.log(10))
    assert one(spark, ql.error_log_likelihood(F.lit("N"), F.lit("G"), F.array(F.lit(10.0)))) == 0
    assert one(spark, ql.indel_log_likelihood(F.lit(2), F.lit(3), -5.0, -6.0)) == pytest.approx(2 * (-5 - math.log(4)) - 18)
    assert one(spark, ql.indel_log_likelihood(F.lit(2), F.lit(3), -5.0, -6.0, paired=True)) == -28


def test_alignment(spark):
    c = F.lit("5S10M2I3D")
    assert [(x.n, x.op) for x in one(spark, al.cigar_ops(c))] == [(5, "S"), (10, "M"), (2, "I"), (3, "D")]
    assert [one(spark, al.cigar_total(c, k)) for k in ("I", "D", "SH")] == [2, 3, 5]
    assert one(spark, al.cigar_ops(F.lit("*"))) == []
    with pytest.raises(PySparkException):
        one(spark, al.cigar_ops(F.lit("5Z")))
    assert one(spark, al.matches(F.lit("AC-T"), F.lit("AG-T"))) == 2
    assert one(spark, al.edge_mapped(F.lit(3), F.lit(9), F.lit(9))) and not one(spark, al.edge_mapped(F.lit(3), F.lit(9), F.lit(9), legacy=True))


def test_log_domain(spark):
    df = spark.createDataFrame([("a", -1000.0), ("a", -1000.0), ("b", 3.0)], "k string, v double")
    got = {r["k"]: r["x"] for r in nm.logsumexp(df, ["k"], "v", "x").collect()}
    assert got == {"a": pytest.approx(-1000 + math.log(2)), "b": pytest.approx(3)}
    assert sum(r[0] for r in df.select(nm.softmax(F.col("v"), ["k"])).collect()) == pytest.approx(2)
    assert one(spark, nm.expit(F.lit(0.0))) == 0.5
    assert one(spark, nm.logaddexp(F.lit(-800.0), F.lit(-800.0))) == pytest.approx(-800 + math.log(2))
    assert one(spark, nm.bernoulli_entropy(F.lit(0.0))) == pytest.approx(math.log(2))


@given(st.floats(0.5, 50), st.floats(0.05, 0.95))
@settings(max_examples=30, deadline=None)
def test_negative_binomial_sums_to_one(n, p):
    total = sum(math.exp(lp) for _, lp in nm.nbinom_logpmf(n, p, range(0, 20000)))
    assert total == pytest.approx(1, abs=1e-6) or n * (1 - p) / p > 500


def test_window_lengths_cover_the_longest():
    got = nm.window_lengths(20, 0.5, 10, 100)
    assert got[0][0] == 10 and got[-1][0] == 100


def test_reconstruct(spark):
    got = one(spark, al.reconstruct(F.lit("2H3S4M1I2D2M4S"), F.lit(2), F.lit("ACGTACGTACG"), F.lit("NNTAAGTACTGTCCCC")))
    assert got.marker_aln == "AC" + "GTAC" + "-" + "GT" + "AC" + "G" and got.read_aln == "AA" + "GTAC" + "T" + "--" + "GT" + "C"
    assert (got.marker_start, got.marker_end, got.read_start, got.read_end) == (0, 11, 3, 13)
    for bad in ("4M3N4M", "4M2S4M"):
        with pytest.raises(PySparkException):
            one(spark, al.reconstruct(F.lit(bad), F.lit(0), F.lit("ACGTACGTACG"), F.lit("ACGTACGTACG")))
