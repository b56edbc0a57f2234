"""Sample catalogues that arrive over time: new slices are appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cladelake.sources.readers import CATALOG_SCHEMA


def stream_catalog(spark: SparkSession, folder: str, process: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``process`` over catalogue files that appear in ``folder`` and write each batch under its number.

    A batch that is run again overwrites its own folder, so results are
    written once whatever fails.
    """
    source = spark.readStream.schema(CATALOG_SCHEMA).csv(folder)

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
