"""Command line: filter, cluster, infer, interpret."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cladelake.functions import alignment as al
from cladelake.functions import quality as ql
from cladelake.operators import abundance as ab
from cladelake.operators import cluster as cl
from cladelake.operators import evidence as ev
from cladelake.operators import inference as inf
from cladelake.sources import readers, writers


def filter_reads(spark: SparkSession, args: argparse.Namespace) -> None:
    """Alignments and markers to passing reads and a report of all that was judged."""
    sam = readers.read_sam(spark, args.sam)
    markers = readers.read_fasta(spark, args.markers).select(F.col("id").alias("marker"), F.col("seq").alias("marker_seq"))
    x = sam.join(markers, "marker").withColumn("a", al.reconstruct(F.col("cigar"), F.col("start").cast("int"), F.col("marker_seq"), F.col("seq"))).select("*", "a.*")
    q = ql.decode(F.col("qual"), args.quality_format)
    length, aligned = F.length("seq"), F.length("marker_aln")
    on_marker = F.filter(F.arrays_zip(F.split("marker_aln", "").alias("m"), F.split("read_aln", "").alias("r")), lambda p: p["r"] != "-")
    kept = F.filter(F.arrays_zip(on_marker.alias("p"), F.slice(q, F.col("read_start") + 1, F.col("read_end") - F.col("read_start")).alias("q")), lambda z: z["p"]["m"] != "-")
    x = x.withColumns({
        "matches_": al.matches(F.col("marker_aln"), F.col("read_aln")),
        "EXP_ERRORS": ql.expected_errors(F.transform(kept, lambda z: z["q"])),
        "IS_EDGE_MAPPED": al.edge_mapped(F.col("marker_start"), F.col("marker_end"), F.length("marker_seq")),
        "ungapped_": F.length(F.replace("read_aln", F.lit("-"), F.lit(""))),
    })
    ok = ev.passes_filter(F.col("ungapped_"), length, F.col("matches_"), aligned, F.col("EXP_ERRORS"), F.col("IS_EDGE_MAPPED"), args.min_length, args.identity, args.error_rate)
    judged = ev.until_first_pass(x.withColumn("ok", ok), "read_id", "ord", "ok").persist()
    mismatch = F.aggregate(F.zip_with(F.split("marker_aln", ""), F.split("read_aln", ""), lambda a, b: ((a != b) & (a != "-") & (b != "-")).cast("int")), F.lit(0), lambda s, v: s + v)
    report = judged.select(
        F.col("read_id").alias("READ"), F.col("marker").alias("MARKER"), F.col("marker_start").alias("MARKER_START"), F.col("marker_end").alias("MARKER_END"), F.col("ok").cast("int").alias("PASSED_FILTER"),
        al.has_flag(F.col("flag"), "reverse").cast("int").alias("REVCOMP"), F.col("IS_EDGE_MAPPED").cast("int").alias("IS_EDGE_MAPPED"), length.alias("READ_LEN"), mismatch.alias("N_MISMATCHES"), (100.0 * F.col("matches_") / length).alias("PCT_ID"), "EXP_ERRORS",
    )
    writers.write_filter_report(report, f"{args.out}/metadata")
    meta = F.concat(F.col("marker"), F.lit("_"), F.col("marker_start").cast("string"), F.lit(":"), F.col("marker_end").cast("string"))
    writers.write_fastq(judged.where("ok").select("read_id", "seq", q.alias("qual"), meta.alias("meta")), f"{args.out}/reads")
    judged.unpersist()


def cluster_strains(spark: SparkSession, args: argparse.Namespace) -> None:
    """Marker sequences by strain to clusters of like strains, by k-mer Jaccard distance and complete linkage.

    A strain with an N in any marker is compared with none and stays alone.
    """
    every = spark.read.parquet(args.markers)
    seqs = every.join(every.where("contains(seq, 'N')").select("strain_id").distinct(), "strain_id", "left_anti")
    d = cl.jaccard(cl.kmer_sets(seqs, "strain_id", "seq", args.k), "strain_id").select("a", "b", (1 - F.col("jaccard")).alias("d"))
    found = cl.complete_linkage(d, 1 - args.identity)
    alone = every.select(F.col("strain_id").alias("node")).distinct().join(found, "node", "left").select(F.coalesce("cluster", "node").alias("rep"), F.col("node").alias("strain_id"))
    writers.write_clusters(alone, args.out)


def infer(spark: SparkSession, args: argparse.Namespace) -> None:
    """Marginal likelihoods (t, read_id, strain_id, ll) to posterior samples and inclusion probabilities."""
    lengths = {r["strain_id"]: r["marker_len"] for r in spark.read.parquet(args.lengths).collect()}
    post = inf.infer(spark.read.parquet(args.marginal), lengths, args.epochs, seed=args.seed)
    y = post.samples(args.samples, args.seed)
    rows = ((float(t), n, s, float(y[i, n, j])) for i, t in enumerate(post.times) for n in range(y.shape[1]) for j, s in enumerate(post.strains))
    kind = "bigint" if isinstance(post.strains[0], int) else "string"
    spark.createDataFrame(rows, f"t double, n int, strain_id {kind}, abundance double").write.parquet(f"{args.out}/samples")
    spark.createDataFrame([(s, float(p)) for s, p in zip(post.strains, post.inclusion(), strict=True)], f"rep {kind}, prob double").write.parquet(f"{args.out}/inclusion")


def interpret(spark: SparkSession, args: argparse.Namespace) -> None:
    """Posterior samples, inclusion and clusters to the abundance profile and its quantiles."""
    samples = spark.read.parquet(f"{args.posterior}/samples").select("t", "n", F.col("strain_id").alias("rep"), F.log("abundance").alias("x")).where("x > -1e300")
    inclusion = spark.read.parquet(f"{args.posterior}/inclusion")
    members = readers.read_clusters(spark, args.clusters, "\t") if args.clusters else inclusion.select("rep", F.col("rep").alias("strain_id"))
    profile = ab.interpret(samples, inclusion, members, args.threshold)
    profile.write.parquet(f"{args.out}/profile")
    ab.quantiles(profile, ["t", "strain_id"], "abundance").write.parquet(f"{args.out}/quantiles")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladelake", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    f = sub.add_parser("filter")
    f.add_argument("sam")
    f.add_argument("markers")
    f.add_argument("out")
    f.add_argument("--min-length", type=int, default=35)
    f.add_argument("--identity", type=float, default=0.975)
    f.add_argument("--error-rate", type=float, default=1.0)
    f.add_argument("--quality-format", default="fastq")
    f.set_defaults(run=filter_reads)
    c = sub.add_parser("cluster")
    c.add_argument("markers")
    c.add_argument("out")
    c.add_argument("--k", type=int, default=15)
    c.add_argument("--identity", type=float, default=0.99)
    c.set_defaults(run=cluster_strains)
    i = sub.add_parser("infer")
    i.add_argument("marginal")
    i.add_argument("lengths")
    i.add_argument("out")
    i.add_argument("--epochs", type=int, default=200)
    i.add_argument("--samples", type=int, default=5000)
    i.add_argument("--seed", type=int, default=314159)
    i.set_defaults(run=infer)
    p = sub.add_parser("interpret")
    p.add_argument("posterior")
    p.add_argument("out")
    p.add_argument("--clusters")
    p.add_argument("--threshold", type=float, default=0.95)
    p.set_defaults(run=interpret)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName(f"cladelake {args.command}").getOrCreate(), args)


if __name__ == "__main__":
    main()
