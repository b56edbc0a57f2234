"""Readers of the domain's file formats. Schemas are always explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladelake.functions import quality as ql

# File layouts.
CATALOG_SCHEMA = "t float, sample string, depth bigint, path string, read_type string, qual_fmt string"
READ_TYPES = ("single", "paired_1", "paired_2")
BLAST_SCHEMA = "saccver string, sstart bigint, send bigint, slen bigint, qstart bigint, qend bigint, evalue double, pident double, gaps bigint, qcovhsp double"
GFF_SCHEMA = "seqid string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attributes string"
INDEX_SCHEMA = "Genus string, Species string, Strain string, Accession string, Assembly string, SeqPath string, ChromosomeLen bigint, GFF string"
DATABASE_SCHEMA = (
    "id string, genus string, species string, name string, genome_length bigint, cluster array<string>, seqs array<struct<id: string, seq_path: string>>, "
    "markers array<struct<id: string, name: string, type: string, source: string, source_i: string, start: bigint, end: bigint, strand: string, canonical: boolean, merged_members: array<string>>>"
)


def separator(path: str) -> str:
    """Comma for .csv, tab for .tsv; another suffix raises."""
    if path.endswith(".csv"):
        return ","
    if path.endswith(".tsv"):
        return "\t"
    raise ValueError(f"neither .csv nor .tsv: {path}")


def require(cond: Column, message: Column | str) -> Column:
    """A boolean column that is true or raises."""
    return F.when(cond, F.lit(True)).otherwise(F.raise_error(F.lit(message) if isinstance(message, str) else message).cast("boolean"))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A headerless sample catalogue; an unknown read type raises, relative read paths are taken from the catalogue's folder."""
    df = spark.read.schema(CATALOG_SCHEMA).option("sep", separator(path)).csv(path)
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    known = require(F.col("read_type").isin(*READ_TYPES), F.concat(F.lit("unknown read type "), F.col("read_type")))
    return df.where(known).withColumn("path", F.when(F.col("path").rlike("^(/|[a-z0-9]+://)"), F.col("path")).otherwise(F.concat(F.lit(folder + "/"), "path")))


def sample_sources(catalog: DataFrame) -> DataFrame:
    """One row for each (t, sample): its single file, or both files of its pair; anything else raises."""
    by = catalog.groupBy("t", "sample").agg(
        F.count("*").alias("n"), F.max("depth").alias("depth"), F.max("qual_fmt").alias("qual_fmt"),
        *[F.max(F.when(F.col("read_type") == k, F.col("path"))).alias(k) for k in READ_TYPES],
    )
    ok = (F.col("n") == 1) & F.col("single").isNotNull() | (F.col("n") == 2) & F.col("paired_1").isNotNull() & F.col("paired_2").isNotNull()
    return by.where(require(ok, F.concat(F.lit("sample is neither single nor a pair: "), F.col("sample")))).withColumn("paired", F.col("n") == 2).drop("n")


def read_fastq(spark: SparkSession, path: str, quality_format: str = "fastq") -> DataFrame:
    """(read_id, seq, qual, meta) of four-line records; lengths that differ raise.

    Lines are numbered within each file by their position, so a record is
    found whatever the split; compressed files come by suffix.
    """
    lines = spark.read.text(path, wholetext=False).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    rec = lines.withColumn("n", place).groupBy("file", F.floor(F.col("n") / 4).alias("rec")).agg(*[F.max(F.when(F.col("n") % 4 == i, F.col("value"))).alias(f"l{i}") for i in (0, 1, 3)])
    rec = rec.where(F.col("l0").isNotNull() & (F.col("l0") != ""))
    head = F.split(F.substring("l0", 2, 1 << 20), r"\s+", 2)
    same = require(F.length("l1") == F.length("l3"), F.concat(F.lit("sequence and quality differ in length: "), F.col("l0")))
    return rec.where(same).select(head[0].alias("read_id"), F.col("l1").alias("seq"), ql.decode(F.col("l3"), quality_format).alias("qual"), F.get(head, 1).alias("meta"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq), sequence lines joined."""
    blocks = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    head = F.split(lines[0], r"\s+", 2)
    return blocks.select(head[0].alias("id"), F.get(head, 1).alias("description"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("seq"))


def tag_orientation(reads: DataFrame, read_type: str) -> DataFrame:
    """Adds is_forward and the mate prefix; forward ids must end /1, reverse ones /2."""
    if read_type not in READ_TYPES:
        raise ValueError(f"unknown read type {read_type}")
    reads = reads.withColumn("is_forward", F.lit(read_type != "paired_2"))
    if read_type == "single":
        return reads.withColumn("mate_prefix", F.lit(None).cast("string"))
    suffix = "/1" if read_type == "paired_1" else "/2"
    return reads.where(require(F.col("read_id").endswith(suffix), F.concat(F.lit("no mate suffix: "), F.col("read_id")))).withColumn("mate_prefix", F.regexp_replace("read_id", "/[12]$", ""))


def read_database(spark: SparkSession, path: str) -> DataFrame:
    """Strain entries of a JSON database; a missing required key raises, cluster defaults to an empty list."""
    df = spark.read.schema(DATABASE_SCHEMA).option("multiLine", True).json(path)
    full = None
    for k in ("id", "genus", "species", "name", "genome_length", "seqs", "markers"):
        ok = require(F.col(k).isNotNull(), f"missing key {k}")
        full = ok if full is None else full & ok
    return df.where(full).withColumn("cluster", F.coalesce("cluster", F.array().cast("array<string>")))


def strain_table(database: DataFrame) -> DataFrame:
    return database.select(F.col("id").alias("strain_id"), "name", "genus", "species", F.col("genome_length").alias("genome_len"), "cluster")


def marker_table(database: DataFrame) -> DataFrame:
    """One row for each marker; strand and type are checked."""
    m = database.select(F.col("id").alias("strain_id"), F.explode("markers").alias("m")).select("strain_id", "m.*").withColumnRenamed("id", "marker_id")
    return m.where(require(F.col("strand").isin("+", "-") & (F.col("type") == "subseq"), F.concat(F.lit("bad strand or type: "), F.col("marker_id"))))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM text with their line order; headers go, unmapped lines go."""
    lines = spark.read.text(path).where("value <> '' and not startswith(value, '@')").withColumn("ord", F.monotonically_increasing_id())
    f = F.split("value", "\t")
    df = lines.select("ord", f[0].alias("read_id"), f[1].cast("int").alias("flag"), f[2].alias("marker"), (f[3].cast("bigint") - 1).alias("start"), f[5].alias("cigar"), F.nullif(f[9], F.lit("*")).alias("seq"), F.nullif(f[10], F.lit("*")).alias("qual"))
    return inherit_sequence(df.where((F.col("flag").bitwiseAND(F.lit(4))) == 0), "read_id", "ord")


def inherit_sequence(df: DataFrame, read: str, order: str, columns: tuple[str, ...] = ("seq", "qual")) -> DataFrame:
    """Secondary lines without sequence take that of the read's previous line."""
    w = Window.partitionBy(read).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns if c in df.columns})


def read_blast(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    return normalise_blast(spark.read.schema(BLAST_SCHEMA).option("sep", "\t").csv(path), min_length)


def normalise_blast(hits: DataFrame, min_length: int = 0) -> DataFrame:
    """Hits with start <= end and a strand; shorter ones go."""
    strand = F.when(F.col("sstart") > F.col("send"), "-").otherwise("+")
    hits = hits.withColumn("strand", strand).withColumns({"sstart": F.least("sstart", "send"), "send": F.greatest("sstart", "send")})
    return hits.where(F.col("send") - F.col("sstart") + 1 >= min_length)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Annotation lines, attributes as a map."""
    df = spark.read.schema(GFF_SCHEMA).option("sep", "\t").option("comment", "#").csv(path)
    return df.withColumn("attr", attributes(F.col("attributes")))


def attributes(column: Column) -> Column:
    """'k=v;...' as a map; of a repeated key the last stays."""
    pairs = F.transform(F.filter(F.split(column, ";"), lambda x: F.instr(x, "=") > 0), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))


def genes(gff: DataFrame) -> DataFrame:
    """Gene annotations with a name: attribute gene, else Name."""
    return gff.where(F.col("attr")["gbkey"] == "Gene").withColumn("name", F.coalesce(F.col("attr")["gene"], F.col("attr")["Name"]))


def read_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Reference index tables, concatenated; a table without the needed columns raises."""
    out = None
    for p in paths:
        df = require_columns(spark.read.option("sep", "\t").option("header", True).csv(p), ["Genus", "Species", "Strain", "Accession", "SeqPath"])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """First tab column of lines that are not comments."""
    return spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')").select(F.trim(F.split("value", "\t")[0]).alias("strain_id"))


def read_clusters(spark: SparkSession, path: str, sep: str = ":") -> DataFrame:
    """(rep, strain_id) of lines 'rep<sep>m1,m2,...'."""
    return explode_clusters(spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')"), "value", sep)


def explode_clusters(df: DataFrame, column: str, sep: str = ":") -> DataFrame:
    parts = F.split(F.col(column), sep, 2)
    return df.select(F.trim(parts[0]).alias("rep"), F.explode(F.split(parts[1], ",")).alias("strain_id")).withColumn("strain_id", F.trim("strain_id"))


def read_abundances(spark: SparkSession, path: str) -> DataFrame:
    """(t, strain_id, abundance) of a wide, quoted table whose first column is T."""
    wide = spark.read.option("header", True).csv(path)
    long = wide.unpivot(["T"], [c for c in wide.columns if c != "T"], "strain_id", "abundance")
    return long.select(F.col("T").cast("double").alias("t"), "strain_id", F.col("abundance").cast("double").alias("abundance"))


def read_triangle(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(i, j, d) from a binary upper triangle of float32; a size other than n(n-1)/2 raises."""
    import numpy as np

    def cells(batches):
        import pyarrow as pa

        for b in batches:
            for blob in b.column(0).to_pylist():
                d = np.frombuffer(blob, np.float32)
                if len(d) != n * (n - 1) // 2:
                    raise ValueError(f"{len(d)} distances for {n} items")
                i, j = np.triu_indices(n, 1)
                for at in range(0, len(d), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(i[part]), pa.array(j[part]), pa.array(d[part].astype(np.float64))], names=["i", "j", "d"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(cells, T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("d", T.DoubleType())]))


def qualified(spark: SparkSession, path: str, folder: str | None = None) -> str:
    """The path with its file system, relative ones under ``folder``; one that is not there raises."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = jvm.Path(path) if folder is None or jvm.Path(path).isAbsolute() else jvm.Path(folder, path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        raise FileNotFoundError(f"no file {at.toString()}")
    return system.makeQualified(at).toString()


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(name, path) of lines 'name<tab>fasta', paths under the table's folder unless absolute; a file that is not there raises."""
    own = qualified(spark, path)
    cells = [r.value.split("\t") for r in spark.read.text(own).where("trim(value) <> ''").collect()]  # a table of files, one row a gene
    return spark.createDataFrame([(c[0].strip(), qualified(spark, c[1].strip(), own.rsplit("/", 1)[0])) for c in cells], "name string, path string")


def read_isolates(spark: SparkSession, path: str) -> DataFrame:
    """One strain for each row of a table of assemblies (Accession, FastaPath, Genus, Species); each contig is a marker.

    (strain_id, name, genus, species, marker_id, marker_name, seq): '|' in a
    contig's id becomes ':', contigs are numbered from 0 in file order. An
    empty table, and one without the needed columns, raise.
    """
    spec = require_columns(spark.read.option("sep", "\t").option("header", True).csv(path), ["Accession", "FastaPath", "Genus", "Species"])
    rows = spec.select("Accession", "FastaPath", "Genus", "Species").collect()
    if not rows:
        raise ValueError(f"no assemblies in {path}")
    listed = spark.createDataFrame([(r.Accession, r.Genus, r.Species, qualified(spark, r.FastaPath)) for r in rows], "strain_id string, genus string, species string, path string")
    text = spark.read.option("lineSep", "\n>").text([r.path for r in listed.select("path").distinct().collect()])
    text = text.select(F.regexp_replace("_metadata.file_path", "^([a-z]+):/+", "$1:/").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    contigs = text.select("path", F.row_number().over(Window.partitionBy("path").orderBy("block", "at")).alias("n"), F.split(lines[0], r"\s+")[0].alias("id"), F.array_join(F.slice(lines, 2, F.size(lines)), "").alias("seq"))
    listed = listed.withColumn("path", F.regexp_replace("path", "^([a-z]+):/+", "$1:/"))
    return contigs.join(listed, "path").select(
        "strain_id", F.concat("genus", "species", F.lit("_"), "strain_id").alias("name"), "genus", "species", F.translate("id", "|", ":").alias("marker_id"),
        F.concat(F.lit("Contig-"), (F.col("n") - 1).cast("string"), F.lit(":"), "strain_id").alias("marker_name"), "seq",
    )
