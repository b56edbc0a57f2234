"""Sequence similarity and clustering."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladelake.functions.sequences import hamming, kmers
from cladelake.sources.spool import spool


def kmer_sets(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """Distinct (key, kmer)."""
    return df.select(key, F.explode(F.array_distinct(kmers(F.col(seq), k))).alias("kmer")).distinct()


def classes(df: DataFrame, key: str, *values: str) -> DataFrame:
    """(key, class_id): the smallest key among the rows with the same values; copies are compared once, by their class."""
    least = df.groupBy(*values).agg(F.min(key).alias("class_id"))
    return df.select(key, *values).join(least, list(values)).select(key, "class_id")


def jaccard(sets: DataFrame, key: str, item: str = "kmer", least: float = 0.0) -> DataFrame:
    """(a, b, jaccard) of pairs with an item in common, a < b, and at least ``least``; other pairs are left out.

    With a bound, sets meet only by the items of their prefixes: in the order
    from the rarest item of all to the most common, two sets of sizes n and m
    that are alike enough share one of the first n - ceil(least n) + 1 and
    m - ceil(least m) + 1. So a common item does not bring all its sets together.
    """
    if least > 0:
        sets = spool(sets.select(key, item), "sets")  # it is read five times
    size = sets.groupBy(key).agg(F.count("*").alias("n"))
    left, right = size.select(F.col(key).alias("a"), F.col("n").alias("na")), size.select(F.col(key).alias("b"), F.col("n").alias("nb"))
    one, other = sets.select(F.col(key).alias("a"), item), sets.select(F.col(key).alias("b"), item)
    if least > 0:
        rarity = sets.groupBy(item).agg(F.count("*").alias("f"))
        place = F.row_number().over(Window.partitionBy(key).orderBy("f", item))
        prefix = sets.join(rarity, item).withColumn("at", place).join(size, key).where(F.col("at") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
        first = prefix.select(F.col(key).alias("a"), item, F.col("n").alias("na"), F.col("at").alias("at_a"))
        met = first.join(prefix.select(F.col(key).alias("b"), item, F.col("n").alias("nb"), F.col("at").alias("at_b")), item)
        after = 1 + F.least(F.col("na") - F.col("at_a"), F.col("nb") - F.col("at_b"))  # all they can share from their first common item on
        met = met.where((F.col("a") < F.col("b")) & (after >= F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - 1e-6)).select("a", "b").distinct()
        both = met.join(one, "a").join(other, ["b", item])
    else:
        both = one.join(other, item).where("a < b")
    common = both.groupBy("a", "b").agg(F.count("*").alias("common")).join(left, "a").join(right, "b")
    found = common.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))
    return found.where(F.col("jaccard") >= least) if least > 0 else found


def minhash(sets: DataFrame, key: str, hashes: int, item: str = "kmer") -> DataFrame:
    """(key, h, sig): the least md5-based hash of each of ``hashes`` families.

    One aggregate with map-side minima, so its shuffle is ``hashes`` rows a key and task.
    """
    fam = sets.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda h: F.struct(h.alias("h"), F.md5(F.concat(h.cast("string"), F.lit(":"), F.col(item))).alias("v")))).alias("x"))
    return fam.groupBy(key, F.col("x.h").alias("h")).agg(F.min("x.v").alias("sig"))


def minhash_similarity(signatures: DataFrame, key: str, hashes: int, agree: int = 1) -> DataFrame:
    """(a, b, estimate) of pairs, a < b, that agree in at least ``agree`` hashes, of (key, h, sig)."""
    whole = signatures.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "sig"))), lambda x: x["sig"]).alias("sigs"))
    return signature_pairs(whole, key, hashes, agree)


def signature_pairs(whole: DataFrame, key: str, hashes: int, agree: int = 1) -> DataFrame:
    """(a, b, estimate) of pairs, a < b, that agree in at least ``agree`` hashes, of (key, sigs) with all hashes in order.

    Signatures meet by bands: with hashes - agree + 1 of them, two that agree
    so often agree in the whole of one band. Bands are shuffled by a hash of
    theirs; those that meet are compared in whole.
    """
    bands = hashes - agree + 1
    whole = spool(whole.select(key, "sigs"), "signatures")  # it is read four times
    edges = [hashes * i // bands for i in range(bands + 1)]
    parts = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("sigs", edges[i] + 1, edges[i + 1] - edges[i])).alias("part")) for i in range(bands)])
    cut = whole.select(key, F.explode(parts).alias("p")).select(key, "p.band", "p.part")
    met = cut.select(F.col(key).alias("a"), "band", "part").join(cut.select(F.col(key).alias("b"), "band", "part"), ["band", "part"]).where("a < b").select("a", "b").distinct()
    pairs = met.join(whole.select(F.col(key).alias("a"), F.col("sigs").alias("x")), "a").join(whole.select(F.col(key).alias("b"), F.col("sigs").alias("y")), "b")
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return pairs.select("a", "b", same.alias("same")).where(F.col("same") >= agree).select("a", "b", (F.col("same") / hashes).alias("estimate"))


def hamming_pairs(seqs: DataFrame, key: str, seq: str, radius: int) -> DataFrame:
    """(a, b, d) of pairs, a < b, of sequences of one length that differ in at most ``radius`` places.

    Two such sequences are equal in one of radius + 1 segments, by which they meet.
    """
    n, parts = F.length(seq), radius + 1
    cut = lambda i: F.substring(F.col(seq), F.floor(n * i / parts).cast("int") + 1, (F.floor(n * (i + 1) / parts) - F.floor(n * i / parts)).cast("int"))
    cuts = seqs.select(F.col(key), F.col(seq), n.alias("n"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(cut(i)).alias("h")) for i in range(parts)])).alias("p")).select(key, "n", "p.i", "p.h")
    met = cuts.select(F.col(key).alias("a"), "n", "i", "h").join(cuts.select(F.col(key).alias("b"), "n", "i", "h"), ["n", "i", "h"]).where("a < b").select("a", "b").distinct()
    pairs = met.join(seqs.select(F.col(key).alias("a"), F.col(seq).alias("x")), "a").join(seqs.select(F.col(key).alias("b"), F.col(seq).alias("y")), "b")
    return pairs.select("a", "b", hamming(F.col("x"), F.col("y")).alias("d")).where(F.col("d") <= radius)


def symmetrize(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """An upper triangle as a full matrix without its diagonal."""
    return pairs.select(a, b, value).unionAll(pairs.select(F.col(b).alias(a), F.col(a).alias(b), value))


def linkage_labels(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, threshold: float, method: str = "complete") -> np.ndarray:
    """Agglomerative clustering of n points up to a distance; pairs not given are farther than any.

    ``complete``: a merge needs all pairs within the threshold; ``average``:
    their mean. Of equal merges the one with smallest members goes first. A
    heap holds the pairs that are given or made of given ones, so work and
    memory go with their number, not with the square of n.
    """
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, x in zip(i.tolist(), j.tolist(), d.tolist(), strict=True):
        near[a][b] = near[b][a] = x
    size, label = [1] * n, np.arange(n)
    members: list[list[int]] = [[k] for k in range(n)]
    heap = [(x, a, b) for a in range(n) for b, x in near[a].items() if a < b and x <= threshold]
    heapq.heapify(heap)
    while heap:
        x, a, b = heapq.heappop(heap)
        if near[a].get(b) != x:
            continue  # one of them has been merged since
        del near[a][b], near[b][a]
        both = {}
        for k in near[a].keys() & near[b].keys():  # with one missing, the merged pair is farther than any
            both[k] = max(near[a][k], near[b][k]) if method == "complete" else (size[a] * near[a][k] + size[b] * near[b][k]) / (size[a] + size[b])
        for old in (a, b):
            for k in near[old]:
                del near[k][old]
        near[a], near[b] = both, {}
        for k, y in both.items():
            near[k][a] = y
            if y <= threshold:
                heapq.heappush(heap, (y, min(a, k), max(a, k)))
        size[a] += size[b]
        members[a] += members[b]
        label[members[b]] = a
        members[b] = []
    return label


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): smallest node of each connected component of the pairs.

    Each round a node joins the first of its neighbours and itself in an order
    drawn anew by hash, and the graph shrinks to the nodes that were joined.
    Rounds are written to the shared folder.
    """
    left = spool(pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")
    joins: list[DataFrame] = []
    while not left.isEmpty():
        turn = F.lit(len(joins))
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select("b", "a"))
        first = both.groupBy("u").agg(F.min_by("v", F.xxhash64("v", turn)).alias("v"))
        joins.append(spool(first.select("u", F.when(F.xxhash64("v", turn) < F.xxhash64("u", turn), F.col("v")).otherwise(F.col("u")).alias("to")), "joins"))
        ends = left.join(joins[-1].select(F.col("u").alias("a"), F.col("to").alias("to_a")), "a").join(joins[-1].select(F.col("u").alias("b"), F.col("to").alias("to_b")), "b")
        left = spool(ends.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    if not joins:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = joins.pop()
    while joins:
        found = joins.pop().join(found.select(F.col("u").alias("to"), F.col("to").alias("last")), "to", "left").select("u", F.coalesce("last", "to").alias("to"))
    found = spool(found, "leaders")
    return found.join(found.groupBy("to").agg(F.min("u").alias("root")), "to").select(F.col("u").alias("node"), "root")


def complete_linkage(pairs: DataFrame, threshold: float, a: str = "a", b: str = "b", distance: str = "d") -> DataFrame:
    """(node, cluster) of all nodes in pairs within the threshold; cluster is its smallest node.

    A cluster whose diameter is within the threshold lies inside one component
    of the graph of such pairs, so components are clustered independently,
    each in memory that goes with its pairs within the threshold.
    """
    near = spool(pairs.where(F.col(distance) <= threshold).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(distance).alias("d")), "near")
    rooted = near.join(components(near).withColumnRenamed("node", "a"), "a")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate((pdf["a"].to_numpy(), pdf["b"].to_numpy())))
        label = linkage_labels(len(nodes), np.searchsorted(nodes, pdf["a"]), np.searchsorted(nodes, pdf["b"]), pdf["d"].to_numpy(), threshold)
        return pd.DataFrame({"node": nodes, "cluster": nodes[label]})

    kind = near.schema["a"].dataType.simpleString()
    return rooted.groupBy("root").applyInPandas(solve, f"node {kind}, cluster {kind}")


def medoids(distances: DataFrame, clusters: DataFrame, node: str = "node", cluster: str = "cluster") -> DataFrame:
    """Each cluster's node whose mean distances to all clusters are nearest (L1) to the cluster's own means, smaller id on ties.

    ``distances``: (a, b, d) both ways.
    """
    of = clusters.select(F.col(node).alias("b"), F.col(cluster).alias("to"))
    mine = clusters.select(F.col(node).alias("a"), F.col(cluster).alias("c"))
    size = clusters.groupBy(F.col(cluster).alias("to")).agg(F.count("*").alias("n"))
    by_node = distances.join(of, "b").groupBy("a", "to").agg(F.sum("d").alias("s")).join(size, "to").select("a", "to", (F.col("s") / F.col("n")).alias("m"))
    by_node = by_node.join(mine, "a")
    by_cluster = by_node.groupBy("c", "to").agg(F.avg("m").alias("cm"))
    off = by_node.join(by_cluster, ["c", "to"]).groupBy("c", "a").agg(F.round(F.sum(F.abs(F.col("m") - F.col("cm"))), 9).alias("off"))
    first = F.row_number().over(Window.partitionBy("c").orderBy("off", "a"))
    return off.withColumn("r_", first).where("r_ = 1").select(F.col("c").alias(cluster), F.col("a").alias("medoid"), "off")


def copy_signature(genes: DataFrame, strain: str, gene: str) -> DataFrame:
    """(strain, signature): gene:count of each gene in order, joined by '|'."""
    counts = genes.groupBy(strain, gene).agg(F.count("*").alias("n"))
    item = F.struct(F.col(gene), F.concat(F.col(gene), F.lit(":"), F.col("n").cast("string")).alias("t"))
    return counts.groupBy(strain).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "|").alias("signature"))


