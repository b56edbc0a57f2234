"""Tables written to the shared folder and read back, which cuts their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def spool(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; removed when the driver's file system closes.

    Files of at most ``file_rows`` spread little data with much work over all cores.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cladelake-{label}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
