"""Writers of the domain's file formats; Spark's commit protocol makes them atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladelake.functions import quality as ql

# Columns of the filter's report.
METADATA = ["READ", "MARKER", "MARKER_START", "MARKER_END", "PASSED_FILTER", "REVCOMP", "IS_EDGE_MAPPED", "READ_LEN", "N_MISMATCHES", "PCT_ID", "EXP_ERRORS"]


def write_filter_report(df: DataFrame, path: str) -> None:
    df.select(*METADATA).write.option("sep", "\t").option("header", True).csv(path)


def write_fastq(reads: DataFrame, path: str, compression: str = "gzip") -> None:
    """Reads (read_id, seq, qual, meta) as four-line records."""
    head = F.concat(F.lit("@"), F.concat_ws(" ", "read_id", "meta"))
    reads.select(F.concat_ws("\n", head, F.col("seq"), F.lit("+"), ql.encode(F.col("qual"))).alias("value")).write.option("compression", compression).text(path)


def write_fasta(df: DataFrame, path: str, id_col: str = "id", seq_col: str = "seq", by: str | None = None) -> None:
    """Records '>id' and sequence; ``by`` writes one folder for each value of a column."""
    out = df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(seq_col)).alias("value"), *([by] if by else []))
    (out.write.partitionBy(by) if by else out.write).text(path)


def write_catalog(catalog: DataFrame, path: str, mode: str = "append") -> None:
    catalog.write.mode(mode).option("quoteAll", True).csv(path)


def write_database(entries: DataFrame, path: str) -> None:
    """One JSON object for each strain entry."""
    entries.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def cluster_lines(clusters: DataFrame, rep: str = "rep", member: str = "strain_id") -> DataFrame:
    """(rep, members): members sorted, joined by commas."""
    return clusters.groupBy(rep).agg(F.array_join(F.array_sort(F.collect_list(F.col(member).cast("string"))), ",").alias("members"))


def write_clusters(clusters: DataFrame, path: str) -> None:
    cluster_lines(clusters).select(F.concat_ws("\t", "rep", "members").alias("value")).write.text(path)


def write_abundances(profile: DataFrame, path: str) -> None:
    """Wide, quoted: T and one column for each strain."""
    wide = profile.groupBy(F.col("t").alias("T")).pivot("strain_id").agg(F.first("abundance")).orderBy("T")
    wide.coalesce(1).write.option("header", True).option("quoteAll", True).csv(path)


def write_matrix(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """A sparse matrix as a long Parquet table."""
    (df.write.partitionBy(*partition) if partition else df.write).parquet(path)
