"""Results kept as Parquet under a key made of their inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(**attributes: object) -> str:
    """sha256 of named attributes, order of names not mattering; lists are taken in order."""
    return hashlib.sha256(json.dumps(attributes, sort_keys=True, default=str).encode()).hexdigest()


def table_signature(df: DataFrame) -> str:
    """Content signature of a table, whatever its order: sum and xor of row hashes and the count."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 16)).alias("s")).first()
    return cache_key(n=r["n"], x=r["x"], s=r["s"], columns=df.columns)


def load_or_compute(spark: SparkSession, folder: str, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table under ``folder``/``key``, computed and written if it is not there whole."""
    path = f"{folder.rstrip('/')}/{key}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
