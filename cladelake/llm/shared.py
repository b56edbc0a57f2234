"""Plumbing that the text operators share: shared tables, Arrow text buffers."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on; a longer single text is a step of its own.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    Where that setting is absent, a session whose executors are threads of this
    process gets a temporary folder; a cluster's raises ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cladelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that survive a lost executor. The table is
    removed when the driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cladelake-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id has remainder null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % mod


def is_remainder(doc_id: str | Column, mod: int, value: int) -> Column:
    """Whether the remainder is ``value``; a null id counts as no."""
    return F.coalesce(remainder(doc_id, mod) == value, F.lit(False))


def unit_hash(*cols: str | Column, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) for each row."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11).cast("double") / float(1 << 53)


def lower_ascii(c: str | Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array, without copying where Arrow allows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 2048) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ``rows`` rows, one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), at + rows, n)
        yield at, end
        at = end


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: Sequence[str],
    outputs: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.Array], list]],
) -> DataFrame:
    """Add columns computed from whole texts, in Arrow batches.

    ``make`` runs once in each task and returns a function from a string array
    (a few MB of text, nulls kept) to one array or list per output. Columns in
    ``keep`` pass through untouched; one whose name is also an output's gives
    way to the output.
    """
    names = {f.name for f in outputs}
    keep = [c for c in keep if c not in names]
    source = df.select(*[df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)], df[f"`{text_col}`"].cast("string").alias("t"))
    fields = [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField(f"o{i}", f.dataType) for i, f in enumerate(outputs)]
    n_keep, n_out = len(keep), len(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            texts = batch.column(n_keep)
            _, offsets = buffers(texts)
            for a, b in slices(offsets):
                out = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in step(texts.slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(n_keep)] + out, names=[f"k{i}" for i in range(n_keep)] + [f"o{i}" for i in range(n_out)])

    done = source.mapInArrow(run, T.StructType(fields))
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"o{i}").alias(f.name) for i, f in enumerate(outputs)])


def stratified(df: DataFrame, label: str, key: str | Sequence[str], per_class: int, seed: int = 1) -> DataFrame:
    """A repeatable sample of about ``per_class`` rows of each label value.

    Labels are counted over all rows; each class gets its own sampling rate, so
    rare classes stay whole. ``key`` decides which rows are taken.
    """
    counts = df.groupBy(label).count().collect()
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col(label) == F.lit(r[0]), F.lit(min(1.0, per_class / r["count"]))).otherwise(rate)
    return df.where(unit_hash(*([key] if isinstance(key, str) else key), seed=seed) < rate)


def fit_on_executor(sample: DataFrame, fit: Callable[[pa.Table], object], by: str | None = None, tasks: int = 1) -> list:
    """What ``fit`` makes of a bounded sample, in one task away from the driver.

    With ``by``, a column of a few numbers, there is a result for each number,
    in their order, made by ``tasks`` tasks. Without a row, none.
    """
    spread = sample.repartition(1) if by is None else sample.repartitionByRange(tasks, by)
    shape = sample.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).rename_columns(shape)
        kinds = np.unique(table[by].to_numpy()).tolist() if by else [0]
        for k in kinds:
            part = table.filter(pa.compute.equal(table[by], k)) if by else table
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(fit(part))], pa.binary())], names=["k", "made"])

    got = spread.mapInArrow(run, "k bigint, made binary").toArrow().sort_by("k")
    return [pickle.loads(x.as_py()) for x in got["made"]]
