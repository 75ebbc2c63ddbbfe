"""Sinks: table files and encoded images."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType

from .ranges import opened


def write_table(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV or Parquet by extension; single: one file of that name, for results that a person opens."""
    kind = path.lower().rpartition(".")[2]
    if kind not in ("csv", "parquet"):
        raise ValueError(f"{path} is neither .csv nor .parquet")
    target = f"{path}.{uuid.uuid4().hex}" if single else path
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", "true").format(kind).save(target)
    if single:
        _only_part(df.sparkSession, target, path)


def _only_part(spark: SparkSession, folder: str, path: str) -> None:
    """Move the one part of a folder to `path`, by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    source, goal = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    store = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (part,) = [s.getPath() for s in store.listStatus(source) if s.getPath().getName().startswith("part-")]
    store.delete(goal, True)
    store.rename(part, goal)
    store.delete(source, True)


@dataclass
class TaskFiles(WriterCommitMessage):
    """Where a task left its files, and how many."""

    folder: str
    files: int


class FileWriter(DataSourceArrowWriter):
    """Files by a two-step commit.

    A task writes its files under a folder of its own below `_staging-...` in the root, with a table of what they are to be; the
    job's commit moves the files of the tasks that count to their names and their tables to the report, then removes the rest.
    A task that fails, or an attempt that isn't counted, leaves no file; a job that fails leaves none at all.
    """

    def __init__(self, root: str, report: str, columns: list[str]) -> None:
        self.root, self.report, self.columns = root.rstrip("/"), report, columns
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"

    def contents(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[bytes] | None]]:
        """What is reported of each row, and its bytes in parts; None for rows that write nothing."""
        kept = [c for c in self.columns if c != "content"]
        for b in iterator:
            for i in range(b.num_rows):
                row = {c: b.column(self.columns.index(c))[i].as_py() for c in kept}
                content = b.column(self.columns.index("content"))[i]
                yield row, iter([content.as_buffer()]) if row["path"] is not None and content.is_valid else None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskFiles:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        store, at = opened(folder)
        store.create_dir(at, recursive=True)
        rows, files = [], 0
        for row, parts in self.contents(iterator):
            if parts is None:
                rows.append(row | {"bytes": None, "__file": None})
                continue
            if not row["path"].startswith(f"{self.root}/") or ".." in row["path"].split("/"):
                raise ValueError(f"{row['path']} isn't below {self.root}")
            size = 0
            with store.open_output_stream(f"{at}/{files}") as f:
                for part in parts:
                    f.write(part)
                    size += len(part)
            rows.append(row | {"bytes": size, "__file": str(files)})
            files += 1
        if rows:
            kinds = {"bytes": pa.int64()}  # all else in a report is text
            table = pa.table({c: pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in rows[0]})
            with store.open_output_stream(f"{at}/table.parquet") as f:
                pq.write_table(table, f)
        return TaskFiles(folder if rows else "", files)

    def commit(self, messages: list[TaskFiles | None]) -> None:
        store, _ = opened(self.staging)
        goal = opened(self.report)[1]
        store.create_dir(goal, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            for n, m in enumerate(messages):
                if m is None or not m.folder:
                    continue
                at = opened(m.folder)[1]
                with store.open_input_file(f"{at}/table.parquet") as f:
                    table = pq.read_table(f)
                moves = [(f"{at}/{f}", opened(t)[1]) for f, t in zip(table.column("__file").to_pylist(), table.column("path").to_pylist()) if f is not None]
                for d in {t.rpartition("/")[0] for _, t in moves}:
                    store.create_dir(d, recursive=True)
                list(pool.map(lambda x: moved(store, *x), moves))
                with store.open_output_stream(f"{goal}/part-{n:05d}.parquet") as f:
                    pq.write_table(table.drop_columns(["__file"]), f)
        self._clear()

    def abort(self, messages: list[TaskFiles | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, at = opened(self.staging)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


def moved(store: fs.FileSystem, source: str, target: str) -> None:
    """Rename; a file that stands there goes first where the store doesn't replace it."""
    try:
        store.move(source, target)
    except OSError:
        if store.get_file_info(target).type != fs.FileType.File:
            raise
        store.delete_file(target)
        store.move(source, target)


class Files(DataSource):
    """Rows of path, content and whatever is to stand in the report: df.write.format("voxlake_files").mode("append")."""

    @classmethod
    def name(cls) -> str:
        return "voxlake_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are added to a folder: use mode append")
        return FileWriter(self.options["path"], self.options["report"], schema.names)


def write_files(df: DataFrame, root: str, path: str = "path", content: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """Writes every row's bytes under its path, once; returns (path, bytes) and the kept columns of all rows.

    Rows without a path or content write nothing and are reported with null bytes. Of two rows with one path, one's content
    stays. All paths lie below `root`. The report is a table under the root's `_reports`.
    """
    spark = df.sparkSession
    spark.dataSource.register(Files)
    rows = df.select(F.col(path).alias("path"), F.col(content).alias("content"), *(F.col(c).cast("string").alias(f"keep_{c}") for c in keep))
    report = f"{root.rstrip('/')}/_reports/{uuid.uuid4().hex}"
    rows.write.format("voxlake_files").option("report", report).mode("append").save(root)
    names = [("path", "path"), ("bytes", "bytes"), *((f"keep_{c}", c) for c in keep)]
    schema = StructType([*(f for f in rows.schema if f.name != "content"), StructField("bytes", LongType())])
    return spark.read.schema(schema).parquet(report).select(*(F.col(a).alias(b) for a, b in names))
