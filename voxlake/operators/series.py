"""Series of files prepared together, with a frame or two of each alive in a task.

1. Files are decoded where they lie, one row a frame, without a shuffle. Handlers other than keep need the frames of a series
   in order: these are shuffled by series, sorted, and go through the handler one by one.
2. What is common to a series comes from an aggregate over its frames: their number, the union of their boxes, whether they are
   alike, the first error. It is joined back by series.
3. Frames are cropped and resized row by row, shuffled by series, sorted, and written page by page into the series' file,
   which a job commit moves to its name. The first frame decides where padding goes.

Only step 3 moves frames through a shuffle (and step 1 for other handlers). The files are decoded three times: for what
the first file and the number of frames say, for boxes, for pages; a series of 500 MB took 207 MB of a Python worker.

Defined results: the first file of a series names its output and gives turn, resolution and recorded values; a file that can't be
decoded makes an error of its series which names the input by number ("input 3: ..."), the least one if there are several; frames of
different size or type, no frame left, or no study or instance identifier are errors of their series; files of equal
position follow each other by path; a null series is a series; a table without files gives no rows.
"""

from __future__ import annotations

import base64
import pickle
import uuid
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from voxlake.codec import dicom
from voxlake.codec.tiff import Pages, Preparation
from voxlake.config import Handler, Preprocessor
from voxlake.errors import ImageError, typed
from voxlake.functions.paths import output_path
from voxlake.kernels import images as K
from voxlake.kernels import volumes as V
from voxlake.sources.ranges import opened
from voxlake.sources.sinks import FileWriter

from .prepare import depth_target, handled, needs_flip, order_frames, resampled, resolution_of, size_plan
from .tiles import map_rows

FRAME = "position long, input long, k long, height int, width int, channels int, dtype string, data binary, error_code string, error_message string, path string, turned boolean, resolution array<float>, study string, uid string, sop string"


def image_of(height: int, width: int, channels: int, dtype: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype).reshape((height, width) if channels == 1 else (height, width, channels))


def fields_of(f: np.ndarray) -> tuple:
    return f.shape[0], f.shape[1], 1 if f.ndim == 2 else f.shape[2], f.dtype.str, np.ascontiguousarray(f).tobytes()


def decoded(order: DataFrame, cfg: Preprocessor) -> DataFrame:
    """One row a frame of the files (series, position, path, spacing), read where they are decoded; an error is a row without samples."""
    place = F.row_number().over(Window.partitionBy("series").orderBy("position", "path")) - 1
    rows = order.select("series", F.col("position").cast("long").alias("position"), place.cast("long").alias("input"), "path", F.col("spacing").cast("double").alias("stated"))
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * 4, "path")

    def each(it):
        for key, at, number, path, stated in it:
            about = (None, None, None, None, None)
            try:
                with typed("INVALID_DICOM"):
                    ds = dicom.parse(content_of(path))
                    _, order, own = order_frames(dicom.frame_rows(ds))
                    resolution = resolution_of(ds, stated if stated is not None else own)
                    about = (needs_flip(ds), list(resolution) if resolution else None, *(ds.text(n) or None for n in ("StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID")))
                for k, i in enumerate(order):
                    with typed("INVALID_DICOM"):
                        f = dicom.rendered_frame(ds, i, cfg.voi)
                    yield key, at, number, k, *fields_of(f), None, None, path, *about
            except ImageError as e:
                yield key, at, number, 0, None, None, None, None, None, e.code, f"input {number}: {e.message}", path, *about

    return map_rows(rows, each, T.StructType([T.StructField("series", rows.schema["series"].dataType), *T.StructType.fromDDL(FRAME).fields]))


def content_of(path: str) -> bytes:
    try:
        store, at = opened(path)
        with store.open_input_file(at) as f:
            return f.readall()
    except OSError as e:
        raise ImageError("UNREADABLE", str(e)) from e


def first_of(frames: DataFrame) -> DataFrame:
    """Per series: frames, the first error, and what its first file says."""
    first = lambda c: F.min_by(c, F.struct("input", "k")).alias(c)
    at_error = F.when(F.col("error_code").isNotNull(), F.struct("input", "k"))
    return frames.groupBy("series").agg(
        F.count("data").alias("n"),
        *(F.min_by(c, at_error).alias(c) for c in ("error_code", "error_message")),
        *map(first, ("path", "turned", "resolution", "study", "uid", "sop")),
    )


def handled_count(n: int, h: Handler) -> int:
    """Frames that a handler makes of n."""
    if n == 1 or h.kind == "keep":
        return n
    return h.target_frames if h.kind == "interpolate" else 1


def with_handler(frames: DataFrame, about: DataFrame, cfg: Preprocessor) -> DataFrame:
    """(series, k, samples, error) after the handler and the resampling in depth: a run of sorted rows a series, one frame at a time."""
    joined = frames.where("data is not null").alias("f").join(about.where("error_code is null").alias("a"), F.col("f.series").eqNullSafe(F.col("a.series")))
    rows = joined.select("f.series", "f.input", "f.k", "f.height", "f.width", "f.channels", "f.dtype", "f.data", "a.n", "a.turned", "a.resolution")
    plain = cfg.handler.kind == "keep" and not (cfg.spacing and cfg.spacing[2])

    def turn(f: np.ndarray, turned: bool) -> np.ndarray:
        return K.flip(f, True, True) if turned else f

    def row_by_row(it):
        for key, number, k, *image, _, turned, _ in it:
            yield key, number, k, *fields_of(turn(image_of(*image), turned)), None, None

    def runs(it) -> Iterator[tuple]:
        ahead = next(it, None)
        while ahead is not None:
            head = ahead

            def frames_of():
                nonlocal ahead
                while ahead is not None and ahead[0] == head[0]:  # noqa: B023
                    yield image_of(*ahead[3:8])
                    ahead = next(it, None)

            key, n, turned, resolution = head[0], head[8], head[9], head[10]
            own = frames_of()
            try:
                made, m = handled(V.alike(own), n, cfg.handler), handled_count(n, cfg.handler)
                if target := depth_target(m, cfg, resolution):
                    made = V.interpolated(made, m, target)
                for k, f in enumerate(made):
                    yield key, 0, k, *fields_of(turn(f, turned)), None, None
            except ImageError as e:
                yield key, 0, 0, None, None, None, None, None, e.code, e.message
            for _ in own:  # what a handler hasn't read
                pass

    schema = T.StructType([T.StructField("series", rows.schema["series"].dataType), *T.StructType.fromDDL("input long, k long, height int, width int, channels int, dtype string, data binary, error_code string, error_message string").fields])
    if plain:
        return map_rows(rows, row_by_row, schema)
    return map_rows(rows.repartition("series").sortWithinPartitions("series", "input", "k"), runs, schema)


def boxes(frames: DataFrame, cfg: Preprocessor) -> DataFrame:
    """Per series: frames, union of boxes, whether sizes and types are one, an error of the handler."""

    def each(it):
        for key, *image, code, message in it:
            if code is not None:
                yield key, None, None, None, None, None, code, message
                continue
            f = image_of(*image)
            b = K.common_box([f], components=cfg.components, check_max=cfg.crop_max, border=cfg.border) if cfg.crop else K.Box(0, 0, f.shape[1], f.shape[0])
            yield key, b.left, b.top, b.left + b.width, b.top + b.height, f"{f.shape} {f.dtype}", None, None

    schema = T.StructType([frames.schema["series"], *T.StructType.fromDDL("left int, top int, right int, bottom int, kind string, code string, message string").fields])
    found = map_rows(frames.select("series", "height", "width", "channels", "dtype", "data", "error_code", "error_message"), each, schema)
    return found.groupBy("series").agg(
        F.count("kind").alias("pages"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
        (F.min("kind") != F.max("kind")).alias("mixed"), F.min("code").alias("code"), F.min("message").alias("message"),
    )


def shaped(frames: DataFrame, plan: DataFrame, cfg: Preprocessor) -> DataFrame:
    """Cropped and resized frames with their series' plan, row by row."""
    p = plan.where("error is null").alias("p")
    joined = frames.alias("f").join(p, F.col("f.series").eqNullSafe(F.col("p.series")))
    about = ["target", "path", "pages", "left", "top", "right", "bottom", "turned", "resolution", "n"]
    rows = joined.select("f.series", "f.input", "f.k", "f.height", "f.width", "f.channels", "f.dtype", "f.data", *(f"p.{c}" for c in about))

    def each(it):
        for key, number, k, *rest in it:
            f, (name, path, pages, left, top, right, bottom, turned, resolution, n) = image_of(*rest[:5]), rest[5:]
            whole = [f.shape[1], f.shape[0]] if turned else None
            cut = f[top:bottom, left:right]
            m = handled_count(n, cfg.handler)
            if target := depth_target(m, cfg, resolution):
                resolution = resampled(resolution, m, target)
            scale, size, resolution = size_plan(right - left, bottom - top, cfg, resolution)
            if scale:
                cut = K.resize(cut, *size, cfg.filter)
            yield key, number, k, *fields_of(cut), name, path, pages, [left, top, right - left, bottom - top] if cfg.crop else None, whole, [float(s) for s in scale] if scale else None, list(resolution) if resolution else None

    ddl = "input long, k long, height int, width int, channels int, dtype string, data binary, target string, path string, pages long, crop array<int>, turned array<int>, scale array<float>, resolution array<float>"
    return map_rows(rows, each, T.StructType([frames.schema["series"], *T.StructType.fromDDL(ddl).fields]))


class StackWriter(FileWriter):
    """Sorted pages of series into one TIFF each, page by page; committed as single files are."""

    def __init__(self, root: str, report: str, columns: list[str], cfg: Preprocessor, compression: str) -> None:
        super().__init__(root, report, columns)
        self.cfg, self.compression = cfg, compression

    def rows_of(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in iterator:
            for i in range(b.num_rows):
                yield {c: b.column(n)[i].as_py() for n, c in enumerate(self.columns)}

    def contents(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[bytes] | None]]:
        for key, rows in groupby(self.rows_of(iterator), key=lambda r: r["target"]):
            first = next(rows)
            yield {"path": key, "keep_source": first["path"]}, self.pages(first, chain([first], rows))

    def pages(self, first: dict, rows: Iterator[dict]) -> Iterator[bytes]:
        padding = pages = None
        for r in rows:
            f = image_of(*(r[c] for c in ("height", "width", "channels", "dtype", "data")))
            if pages is None:
                if self.cfg.size and self.cfg.use_padding:
                    padding = K.padding_of(f, *self.cfg.size, self.cfg.padding)
                w, h = first["turned"] or (None, None)
                tuple_of = lambda v: tuple(v) if v else None
                done = Preparation((w, h, True, True) if w else None, tuple_of(first["crop"]), tuple_of(first["scale"]), padding, tuple_of(first["resolution"]), first["pages"])
                pages = Pages(first["pages"], done, self.compression)
            yield pages.add(K.pad(f, padding) if padding else f)


class Stacks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxlake_stacks"

    def writer(self, schema: T.StructType, overwrite: bool) -> StackWriter:
        if overwrite:
            raise ValueError("files are added to a folder: use mode append")
        cfg = pickle.loads(base64.b64decode(self.options["settings"]))
        return StackWriter(self.options["path"], self.options["report"], schema.names, cfg, self.options["compression"])


def write_series(order: DataFrame, root: str, cfg: Preprocessor | None = None, *, compression: str = "packbits") -> DataFrame:
    """(path, error, message) of the series of `order` (series, position, path, spacing), written as root/study/series/sop.tiff.

    A written series has the path of its file; one with an error that of its first input.
    """
    cfg = cfg or Preprocessor()
    spark = order.sparkSession
    spark.dataSource.register(Stacks)
    frames = decoded(order, cfg)
    about = first_of(frames).persist()  # a row a series, as the plan below
    made = with_handler(frames, about, cfg)
    b = boxes(made, cfg).withColumnRenamed("series", "__series")
    named = output_path(F.lit(root), F.col("study"), F.col("uid"), F.col("sop"))
    empty = F.coalesce("pages", F.lit(0)) == 0
    plan = about.join(b, F.col("series").eqNullSafe(F.col("__series")), "left").drop("__series").withColumn("target", named)
    error = F.coalesce("error_code", "code", F.when(F.col("mixed"), F.lit("INCOMPATIBLE_FRAMES")), F.when(empty, F.lit("EMPTY_VOLUME")), F.when(F.col("target").isNull(), F.lit("NO_OUTPUT_NAME")))
    said = F.coalesce("error_message", "message", F.when(F.col("mixed"), F.lit("frames differ in size or type")), F.when(empty, F.lit("no frame is left")))
    plan = plan.withColumn("message", said).withColumn("error", error).persist()
    pages = shaped(made.where("data is not null"), plan, cfg).repartition("series").sortWithinPartitions("series", "input", "k")
    settings = base64.b64encode(pickle.dumps(cfg)).decode()
    report = f"{root.rstrip('/')}/_reports/{uuid.uuid4().hex}"
    pages.write.format("voxlake_stacks").options(report=report, settings=settings, compression=compression).mode("append").save(root)
    written = spark.read.schema("path string, keep_source string, bytes long").parquet(report)
    done = written.select("path", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("message"))
    return done.unionByName(plan.where("error is not null").select("path", "error", "message"))
