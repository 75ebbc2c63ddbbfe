"""File sources: binary scans, path lists, inodes, table files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.paths import is_dicom, is_tiff

TRACES = "sop_instance_uid string, trace_hash long, x_min long, x_max long, y_min long, y_max long"
SERIES = "series_instance_uid string, sop_instance_uid string, instance_number int"


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, modificationTime, length, content) of all files below; content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def find_dicoms(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files with a DICOM extension, and files without extension that start like one."""
    return scan(spark, path).where(is_dicom(F.col("path"), F.col("content")))


def find_tiffs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return scan(spark, path).where(is_tiff(F.col("path")))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(n, path): one path a line, blank lines left out, n in the order of the list."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("n"), F.trim("value").alias("path"))


def read_files(paths: DataFrame) -> DataFrame:
    """(n, path, length, content) of the paths of read_paths(), read by Arrow's file systems where the rows are."""

    def run(it):
        import re

        import pyarrow as pa
        from pyarrow import fs

        for b in it:
            for n, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
                with store.open_input_file(at) as f:
                    content = f.readall()
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([path]), pa.array([len(content)]), pa.array([content], pa.binary())], names=["n", "path", "length", "content"])

    parts = paths.sparkSession.sparkContext.defaultParallelism * 4
    return paths.select("n", "path").repartition(parts, "path").mapInArrow(run, "n long, path string, length long, content binary")


def load_source(spark: SparkSession, path: str, kind: str = "dicom") -> DataFrame:
    """A folder, a .txt list of paths, or one file. Files of a list have its order as n."""
    if not path.endswith(".txt"):
        return {"dicom": find_dicoms, "tiff": find_tiffs}[kind](spark, path)
    paths = read_paths(spark, path)
    if not paths.limit(1).count():
        raise ValueError(f"{path} lists no files")
    if kind == "tiff":
        return read_files(paths.where(is_tiff(F.col("path"))))
    return read_files(paths).where(is_dicom(F.col("path"), F.col("content")))


def with_inode(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds inode where a file system has them, else 0; sorting by it is an option of disks, not of object stores."""
    @F.pandas_udf("long")
    def inode(p: pd.Series) -> pd.Series:
        import os
        import re

        def one(x):
            try:
                return os.stat(re.sub(r"^file:/*", "/", x)).st_ino
            except OSError:
                return 0

        return p.map(one)

    return files.withColumn("inode", inode(path))


def relative_to(files: DataFrame, root: str, path: str = "path") -> Column:
    """The path from `root`, with .. where it isn't below."""
    @F.pandas_udf("string")
    def relative(p: pd.Series) -> pd.Series:
        import os
        import re

        return p.map(lambda x: os.path.relpath(re.sub(r"^file:/*", "/", x), root))

    return relative(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header or Parquet, by extension; columns are cast to the schema and bad values fail."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(schema)
    if path.lower().endswith(".csv"):
        return spark.read.option("header", "true").option("mode", "FAILFAST").schema(want).csv(path)
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])
    raise ValueError(f"{path} is neither .csv nor .parquet")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, TRACES)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, SERIES)
