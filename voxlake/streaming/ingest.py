"""Streaming ingestion of image files, an extra beside the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, path: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """New files of a folder as rows, at most max_files a batch; the file source remembers what it has read."""
    return (
        spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
    )


def once_each(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Files that arrive twice with the same path and length pass once; state older than the delay goes."""
    return files.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["path", "length"])


def ingest(files: DataFrame, prepare: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Prepare what is there, write it as Parquet, and end; a batch that is repeated overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
