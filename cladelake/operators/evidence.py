"""Reads, mates and fragments: joins and filters of the evidence model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladelake.functions.sequences import reverse_complement
from cladelake.sources.readers import require


def passes_filter(ungapped: Column, length: Column, matches: Column, aligned: Column, errors: Column, edge: Column, min_length: int = 35, identity: float = 0.975, error_rate: float = 1.0, min_ungapped: float = 0.5) -> Column:
    """Read filter, all bounds strict: enough of the read is ungapped and long, few errors are expected, and
    matches are many of the aligned part where the hit touches a marker's edge, of the whole read elsewhere."""
    over = F.when(edge, aligned).otherwise(length)
    return (ungapped / length > min_ungapped) & (length > min_length) & (matches / over > identity) & (errors < error_rate * length)


def until_first_pass(df: DataFrame, read: str, order: str, passed: str) -> DataFrame:
    """Rows of each read up to and including the first that passed."""
    first = F.min(F.when(F.col(passed), F.col(order))).over(Window.partitionBy(read))
    return df.withColumn("first_", first).where(F.col("first_").isNull() | (F.col(order) <= F.col("first_"))).drop("first_")


def mate_pairs(forward: DataFrame, reverse: DataFrame, pair: str, strain: str, value: str) -> DataFrame:
    """Inner join of mates on pair and strain; log-likelihoods add, repeats multiply."""
    f = forward.select(F.col(pair), F.col(strain), F.col(value).alias("f_"))
    r = reverse.select(F.col(pair), F.col(strain), F.col(value).alias("r_"))
    return f.join(r, [pair, strain]).select(pair, strain, (F.col("f_") + F.col("r_")).alias(value))


def unpaired(forward: DataFrame, reverse: DataFrame, paired: DataFrame, pair: str) -> DataFrame:
    """Single evidence: reads of either side whose pair was not resolved, for any strain."""
    done = paired.select(pair).distinct()
    return forward.join(done, pair, "left_anti").unionByName(reverse.join(done, pair, "left_anti"))


def containment_join(fragments: DataFrame, markers: DataFrame, k: int, fragment: str = "frag", seq: str = "marker_seq", both_strands: bool = True) -> DataFrame:
    """Exact occurrences of fragments in markers: (all columns but the markers' sequence), pos (1-based), strand.

    A fragment's first k-mer is an equi-join key against all k-mers of the
    markers; fragments are at least k long. A row of the index has the marker's
    text from its k-mer on, as far as the longest fragment reaches, so what is
    shuffled grows with the markers' length, not with its square.
    """
    longest = fragments.agg(F.coalesce(F.max(F.length(fragment)), F.lit(0))).first()[0]
    probe = fragments.withColumn("probe_", F.col(fragment)).withColumn("strand", F.lit("+"))
    if both_strands:
        turned = reverse_complement(F.col(fragment))
        probe = probe.unionByName(fragments.withColumn("probe_", turned).withColumn("strand", F.lit("-")))
    probe = probe.where(F.length("probe_") >= k).withColumn("seed_", F.substring("probe_", 1, k))
    windows = F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(F.col(seq), i, F.lit(max(longest, k))))
    others = [c for c in markers.columns if c != seq]
    index = markers.where(F.length(seq) >= k).select(*others, F.posexplode(windows).alias("at_", "text_")).withColumn("seed_", F.substring("text_", 1, k))
    hit = index.join(probe, "seed_").where(F.startswith("text_", "probe_"))
    return hit.withColumn("pos", F.col("at_") + 1).drop("seed_", "at_", "probe_", "text_")


def fragment_frequencies(matches: DataFrame, windows: list[tuple[int, float]]) -> DataFrame:
    """(frag_id, strain_id, logfreq) from exact matches (frag_id, strain_id, frag_len, marker_len, pos).

    Over window lengths w the frequency is the sum of P(w) n(w), where n(w) is
    the number of hits for w = length, of hits at a marker's edge for longer
    windows, and 0 below. All windows are longer than a fragment shorter than
    the shortest of them.
    """
    spark = matches.sparkSession
    edge = (F.col("pos") == 1) | (F.col("pos") + F.col("frag_len") - 1 == F.col("marker_len"))
    hits = matches.groupBy("frag_id", "strain_id", "frag_len").agg(F.count("*").alias("hits"), F.count_if(edge).alias("edge_hits"))
    low, tail = [], -math.inf  # a table by length instead of a join with all windows: P(len), and P(> len)
    for w, lp in reversed(windows):
        low.append((w, lp, tail))
        tail = lp if tail == -math.inf else max(tail, lp) + math.log1p(math.exp(-abs(tail - lp)))
    table = spark.createDataFrame(low, "frag_len int, log_at double, log_over double")
    joined = hits.join(F.broadcast(table), "frag_len", "left")
    beyond = F.when(F.col("frag_len") < min(w for w, _ in windows), math.exp(tail)).otherwise(0.0) if windows else F.lit(0.0)
    total = F.col("hits") * F.coalesce(F.exp("log_at"), F.lit(0.0)) + F.col("edge_hits") * F.coalesce(F.exp("log_over"), beyond)
    return joined.where(total > 0).select("frag_id", "strain_id", F.log(total).alias("logfreq"))


def pair_frequencies(pairs: DataFrame, freqs: DataFrame) -> DataFrame:
    """log f1 + log f2 for strains that have both fragments of a pair (frag1, frag2)."""
    one = freqs.select(F.col("frag_id").alias("frag1"), "strain_id", F.col("logfreq").alias("a_"))
    two = freqs.select(F.col("frag_id").alias("frag2"), "strain_id", F.col("logfreq").alias("b_"))
    return pairs.join(one, "frag1").join(two, ["frag2", "strain_id"]).select("frag1", "frag2", "strain_id", (F.col("a_") + F.col("b_")).alias("logfreq"))


def best_match(markers: DataFrame, query: DataFrame, marker: str, strain: str) -> DataFrame:
    """The strain with most of the queried markers, the smaller id on ties."""
    hits = markers.join(query.select(marker).distinct(), marker, "left_semi").groupBy(strain).agg(F.countDistinct(marker).alias("hits"))
    return hits.orderBy(F.desc("hits"), strain).limit(1)


def first_owner(markers: DataFrame, marker: str, strain: str, order: str) -> DataFrame:
    """The first strain of each marker."""
    return markers.groupBy(marker).agg(F.min_by(strain, F.struct(order, strain)).alias(strain))


def hits_with_strains(hits: DataFrame, contigs: DataFrame, contig: str, strain: str) -> DataFrame:
    """Hits with the strain whose contig they lie on; a contig of no strain raises."""
    joined = hits.join(contigs.select(contig, strain), contig, "left")
    return joined.where(require(F.col(strain).isNotNull(), F.concat(F.lit("no strain has the sequence "), F.col(contig).cast("string"))))


def long_enough(fragments: DataFrame, fragment: str = "frag", least: int = 15) -> DataFrame:
    """Fragments of at least ``least`` letters."""
    return fragments.where(F.length(fragment) >= least)
