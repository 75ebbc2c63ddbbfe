"""Header scans: a data source that reads what stands before the samples.

    spark.dataSource.register(Headers)
    spark.read.format("voxlake_headers").option("kind", "dicom").load(folder)

The driver lists files and deals them out by the bytes a task is to open; tasks read ranges. Of a DICOM file the elements
up to the pixel data are read, and of fragments their lengths; of a TIFF file its first page's tags. Names decide
at listing where they can: other extensions are never opened, names without extension are opened for their magic
and skipped if they lack it. Filters on `path` (equality, in, prefix, suffix, contained text) are pushed to the listing where
the session allows it.

Defined results: a file that can't be read or parsed is a row with error_code and error_message, whatever else is null, and
ends nothing; a path that isn't a folder is an error when the scan is planned; an empty folder has no rows; files
of 0 bytes are errors by extension, else skipped; the option `files` (one path a line) takes the place of a folder.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from voxlake.codec import dicom, tiff
from voxlake.errors import ImageError, typed
from voxlake.functions.paths import DICOM_EXTENSIONS, TIFF_EXTENSIONS

from .ranges import BLOCK, RangeFile, check_folder, listed, opened

NAMES = [n for n, (_, _, vr) in dicom.ATTRIBUTES.items() if vr not in ("SQ", "OW", "AT") and n != "PixelSpacing"]
LISTS = ["PixelSpacing array<double>", "PixelDataLength long", "VOILUTSequenceItems int", "present array<string>"]
ENDING = ["error_code string", "error_message string", "length long", "bytes_read long"]
DICOM_DDL = ", ".join(["path string", *(f"{n} string" for n in NAMES), *LISTS, *ENDING])
TIFF_FIELDS = ["width long", "height long", "channels long", "num_frames long", "crop array<int>", "scale array<float>", "padding array<int>", "flip array<int>", "resolution array<float>"]
TIFF_DDL = ", ".join(["path string", *TIFF_FIELDS, *ENDING])
#: What opening a file counts for when files are dealt out, and what a task opens.
OPEN_COST, TASK_COST = 1 << 18, 128 << 20


def extension_of(path: str) -> str:
    name = path.rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    return ext if dot and stem else ""


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


def dicom_row(f: RangeFile) -> list:
    h = dicom.header_row(dicom.parse(f, spans=True))
    return [*(h[n] for n in NAMES), h["PixelSpacing"], h["PixelDataLength"], h["VOILUTSequenceItems"], h["present"]]


def tiff_row(f: RangeFile) -> list:
    t = tiff.Tiff(f)
    p, page = t.preparation(), t.page(0)
    whole = lambda v: list(map(int, v)) if v else None
    return [*map(int, page.size), int(page.channels), int(p.num_frames), whole(p.crop), [float(v) for v in p.resize] if p.resize else None, whole(p.padding), whole(p.flip), [float(v) for v in p.resolution[:2]] if p.resolution else None]


KINDS = {"dicom": (DICOM_EXTENSIONS, dicom_row, "INVALID_DICOM", len(NAMES) + len(LISTS)), "tiff": (TIFF_EXTENSIONS, tiff_row, "INVALID_TIFF", len(TIFF_FIELDS))}


class HeaderReader(DataSourceReader):
    def __init__(self, kind: str, root: str | None, files: list[str] | None, block: int, task_cost: int) -> None:
        self.kind, self.root, self.files, self.block, self.task_cost = kind, root, files, block, task_cost
        self.tests: list[tuple[str, object]] = []

    def wanted(self, path: str) -> bool:
        for how, v in self.tests:
            ok = {"is": lambda: path == v, "in": lambda: path in v, "starts": lambda: path.startswith(v), "ends": lambda: path.endswith(v), "holds": lambda: v in path}[how]()  # noqa: B023
            if not ok:
                return False
        ext = extension_of(path)
        return ext in KINDS[self.kind][0] or not ext and self.kind == "dicom"

    def partitions(self) -> list[InputPartition]:
        found = listed(self.root) if self.files is None else ((p, 0) for p in self.files)
        out, held, cost = [], [], 0
        for path, size in found:
            if self.wanted(path):
                held.append((path, size))
                cost += OPEN_COST + min(size, self.block)
                if cost >= self.task_cost:
                    out.append(Files(held))
                    held, cost = [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        _, row, code, columns = KINDS[self.kind]
        for path, size in partition.files:
            f = None
            try:
                store, at = opened(path)
                with store.open_input_file(at) as file, typed(code):
                    f = RangeFile(file, self.block)
                    if self.kind == "dicom" and not extension_of(path) and f[128:132] != b"DICM":
                        continue
                    yield (path, *row(f), None, None, len(f), f.read)
            except ImageError as e:
                yield (path, *[None] * columns, e.code, e.message, len(f) if f else size, f.read if f else 0)
            except OSError as e:
                yield (path, *[None] * columns, "UNREADABLE", str(e), size, f.read if f else 0)


class PushingReader(HeaderReader):
    """The same, where the session lets sources take filters (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "holds"}
        for f in filters:
            if type(f) in known and f.attribute == ("path",):
                self.tests.append((known[type(f)], f.value))
            else:
                yield f


class Headers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxlake_headers"

    def _kind(self) -> str:
        kind = self.options.get("kind", "dicom")
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        return kind

    def schema(self) -> str:
        return {"dicom": DICOM_DDL, "tiff": TIFF_DDL}[self._kind()]

    def reader(self, schema) -> HeaderReader:
        root, files = self.options.get("path"), self.options.get("files")
        if (root is None) == (files is None):
            raise ValueError("either a folder or the option files")
        made = PushingReader if self.options.get("pushdown") == "true" else HeaderReader
        return made(self._kind(), root, None if files is None else json.loads(files), int(self.options.get("block", BLOCK)), int(self.options.get("taskcost", TASK_COST)))


def scan_headers(spark: SparkSession, folder: str, kind: str = "dicom", **options) -> DataFrame:
    """Header rows of the files below a folder; fails at once if it isn't one."""
    spark.dataSource.register(Headers)
    check_folder(folder)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("voxlake_headers").options(kind=kind, pushdown=push, **options).load(folder)


def read_headers(spark: SparkSession, paths: list[str], kind: str = "dicom") -> DataFrame:
    """Header rows of listed files."""
    spark.dataSource.register(Headers)
    return spark.read.format("voxlake_headers").options(kind=kind, files=json.dumps([re.sub(r"^file:/+", "file:/", p) for p in paths])).load()
