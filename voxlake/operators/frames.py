"""Random access to frames: an index of where each one lies, and reads of nothing but the frames asked for.

The index has one row a stored frame: its place in the file's resolved order and the ranges of its bytes, from the size
of a native frame, the offset table and the lengths of fragments, or the chain of TIFF pages. Headers are read for it, samples aren't. What a
handler shows is a join with it: a shown frame is a stored one, or derived from several and then has no bytes of its own.

Defined results: a file that can't be indexed is one row with error_code and error_message; files whose samples have no
place of their own (deflated datasets) have the error NOT_SEEKABLE; a request of a frame that isn't shown is answered with
FRAME_OUT_OF_RANGE, of a derived one with DERIVED_FRAME, of a file that isn't in the index with UNKNOWN_FILE; a request made twice is answered twice.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.codec import dicom, tiff
from voxlake.config import Handler
from voxlake.errors import ImageError, typed
from voxlake.functions.arrow import schema_of, to_batches
from voxlake.functions.geometry import f32
from voxlake.functions.paths import TIFF_EXTENSIONS
from voxlake.sources.headers import extension_of
from voxlake.sources.ranges import BLOCK, RangeFile, opened

from .prepare import order_frames

Parts = list[tuple[int, int]]


def dicom_parts(f: RangeFile, ds: dicom.Dataset) -> list[Parts]:
    """(offset, length) of the pieces of each stored frame, from a dataset parsed with spans."""
    n, spans = dicom.frame_count(ds), ds.get("PixelData")
    if not isinstance(spans, list):
        raise ImageError("NOT_SEEKABLE" if spans is not None else "NO_PIXEL_DATA", "no ranges of pixel data")
    if ds.text("TransferSyntaxUID") in (None, dicom.EXPLICIT, dicom.IMPLICIT):
        size, whole = dicom.frame_bytes(ds), spans[0]
        if not size or n * size > len(whole):
            raise ImageError("INVALID_HEADER", f"{n} frames of {size} bytes in {len(whole)}")
        return [[(whole.start + i * size, size)] for i in range(n)]
    table, own = spans[0] if spans else range(0), [(r.start, len(r)) for r in spans[1:]]
    if n == 1 or len(own) == n:
        return [own] if n == 1 else [[p] for p in own]
    starts = struct.unpack(f"<{len(table) // 4}I", f[table.start : table.start + len(table) // 4 * 4])
    if len(starts) != n or not own:
        raise ImageError("INVALID_FRAGMENTS", f"{len(own)} fragments for {n} frames without an offset table")
    first = own[0][0]
    ends = [*starts[1:], own[-1][0] - first + 1]
    return [[p for p in own if a <= p[0] - first < z] for a, z in zip(starts, ends)]


def tiff_parts(f: RangeFile) -> list[Parts]:
    t = tiff.Tiff(f)
    pages = (t.page(i).tags for i in range(t.count()))
    return [list(zip(p[tiff.OFFSETS], p[tiff.COUNTS], strict=True)) for p in pages]


def stored_frames(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, frame, position, n, strategy, parts, length, error_code, error_message) of the files of a column `path`; position is the place in the resolved order."""
    ddl = "path string, frame int, position int, n int, strategy string, parts array<struct<offset: long, length: long>>, length long, error_code string, error_message string"
    schema = schema_of(ddl)

    def index(path: str) -> Iterator[tuple]:
        store, at = opened(path)
        with store.open_input_file(at) as file, typed("INVALID_FILE"):
            f = RangeFile(file, block)
            if extension_of(path).lower() in TIFF_EXTENSIONS:
                parts = tiff_parts(f)
                strategy, order = "raw", range(len(parts))
            else:
                ds = dicom.parse(f, spans=True)
                parts = dicom_parts(f, ds)
                strategy, order, _ = order_frames(dicom.frame_rows(ds))
        for position, i in enumerate(order):
            pieces = [{"offset": a, "length": n} for a, n in parts[i]]
            yield path, i, position, len(parts), strategy, pieces, sum(p["length"] for p in pieces), None, None

    def run(it):
        def rows():
            for b in it:
                for path in b.column(0).to_pylist():
                    try:
                        yield from list(index(path))
                    except ImageError as e:
                        yield path, *[None] * 6, e.code, e.message
                    except OSError as e:
                        yield path, *[None] * 6, "UNREADABLE", str(e)

        yield from to_batches(rows(), schema, 4096)

    return files.select("path").mapInArrow(run, ddl)


def shown_frames(stored: DataFrame, h: Handler | None = None, file: str = "path", frame: str = "frame") -> DataFrame:
    """(file, shown, frame, derived, and the other columns of `stored`) of what a handler shows.

    stored: one row a frame with `position` and the file's number of frames `n`. The rows of a file's plan come from its first
    frame, so that nothing is aggregated; one equi-join finds the stored frames.
    """
    h = h or Handler()
    n, out = F.col("n"), F.col("shown")
    first = stored.where("position = 0").select(file, n.cast("int").alias("n"))
    if h.kind == "interpolate":
        t = h.target_frames
        many, place = F.when(n <= 1, n).otherwise(max(t, 1)), F.when((n <= 1) | F.lit(t <= 1), f32(F.lit(0.0))).otherwise(f32(f32(f32(out) / f32(F.lit(max(t - 1, 1)))) * f32(n - 1)))
    elif h.kind == "keep":
        many, place = n, f32(out)
    else:
        many, place = F.lit(1), F.when(n <= 1, f32(F.lit(0.0)))
        if h.kind == "central-slice":
            place = F.floor(n / 2).cast("float")
    plan = first.withColumn("shown", F.explode(F.sequence(F.lit(0), many.cast("int") - 1))).withColumn("__at", place)
    plan = plan.select(file, "shown", F.when(F.col("__at") == F.floor("__at"), F.col("__at").cast("int")).alias("__p"))
    held = stored.withColumn("__p", F.col("position").cast("int")).drop("position", "n")
    got = plan.join(held, [file, "__p"], "left")
    rest = [c for c in held.columns if c not in (file, "__p", frame)]
    return got.select(file, "shown", frame, F.col("__p").isNull().alias("derived"), *rest)


def byte_places(frames: DataFrame, file: str, order: str, length: str, start: int = 0) -> DataFrame:
    """Adds position, n and offset of frames that lie one behind the other in their file from byte `start` on."""
    w = Window.partitionBy(file).orderBy(order)
    before = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return frames.withColumns({"position": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(file)), "offset": F.coalesce(before, F.lit(0)) + start})


def fetch_frames(requests: DataFrame, stored: DataFrame, h: Handler | None = None) -> DataFrame:
    """(path, shown, frame, content, bytes_read, error_code, error_message): the stored bytes of every requested (path, shown).

    `stored` is read several times: for many files write stored_frames() to a table once, and give that.
    Requests are dealt out by file and offset, so that the requests of one file may go to many tasks, and are read in the order of the bytes.
    """
    ddl = "path string, shown int, frame int, content binary, bytes_read long, error_code string, error_message string"
    schema = schema_of(ddl)
    known = stored.groupBy("path").agg(F.max("error_code").alias("file_code"), F.max("error_message").alias("file_message"))
    plan = shown_frames(stored.where("error_code is null"), h).select("path", "shown", "frame", "derived", "parts")
    asked = requests.select("path", F.col("shown").cast("int").alias("shown")).join(plan, ["path", "shown"], "left").join(known.withColumn("__known", F.lit(True)), "path", "left")
    code = (
        F.when(F.col("__known").isNull(), "UNKNOWN_FILE").when(F.col("file_code").isNotNull(), F.col("file_code"))
        .when(F.col("derived").isNull(), "FRAME_OUT_OF_RANGE").when(F.col("derived"), "DERIVED_FRAME")
    )
    asked = asked.select("path", "shown", "frame", "parts", code.alias("code"), "file_message", F.get("parts", F.lit(0))["offset"].alias("at"))
    dealt = asked.repartitionByRange("path", "at").sortWithinPartitions("path", "at")

    def run(it):
        def rows():
            name, file = None, None
            for b in it:
                for path, shown, frame, parts, code, message in zip(*(c.to_pylist() for c in b.columns[:6])):
                    if code:
                        yield path, shown, frame, None, 0, code, message or f"frame {shown}"
                        continue
                    try:
                        if path != name:
                            if file:
                                file.close()
                            name, file = None, None
                            store, at = opened(path)
                            name, file = path, store.open_input_file(at)
                        content = b"".join(file.read_at(p["length"], p["offset"]) for p in parts)
                        yield path, shown, frame, content, len(content), None, None
                    except OSError as e:
                        yield path, shown, frame, None, 0, "UNREADABLE", str(e)
            if file:
                file.close()

        yield from to_batches(rows(), schema, 8)

    return dealt.mapInArrow(run, ddl)
