"""Command line jobs: preprocess, series, manifest, validate, traces, combine, stats, voilut, order, resize."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.config import ALIASES, FILTERS, HANDLERS, PADDINGS, Handler, Preprocessor
from voxlake.errors import ImageError
from voxlake.functions import paths
from voxlake.functions.codes import numbers
from voxlake.functions.coords import CropMap, FlipMap, PadMap, ResizeMap
from voxlake.operators import ordering, prepare, relational, validation
from voxlake.operators.series import write_series
from voxlake.sources import files as S
from voxlake.sources import sinks
from voxlake.sources.headers import scan_headers


def session() -> SparkSession:
    """Files of hundreds of MB travel one by one: few rows a batch, and a bound on its bytes."""
    build = SparkSession.builder.appName("voxlake").config("spark.sql.execution.arrow.maxRecordsPerBatch", "4").config("spark.sql.python.filterPushdown.enabled", "true")
    return build.config("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20)).getOrCreate()


def plain_path(p: str) -> str:
    return p if "://" in p else f"file://{p}" if p.startswith("/") else p


def run_preprocess(spark: SparkSession, source: str, out: str, cfg: Preprocessor, compression: str = "packbits") -> DataFrame:
    """Prepared TIFF of every file under out/study/series/sop.tiff; files without a study or instance become errors."""
    return written(prepare.preprocess(S.load_source(spark, source), cfg, compression=compression), out)


def run_series(spark: SparkSession, source: str, out: str, cfg: Preprocessor, compression: str = "packbits") -> DataFrame:
    """The single-frame files of each series put in order, prepared together and written as one TIFF; rejected series become errors."""
    order = series_positions(header_rows(spark, source))
    made = write_series(order.where("error is null"), plain_path(out), cfg, compression=compression)
    return made.select("path", "error").unionByName(order.where("error is not null").select("path", "error"))


def written(made: DataFrame, out: str) -> DataFrame:
    """(path, error) of prepared files, whose TIFFs are written; files that failed and files without a name have an error."""
    target = paths.output_path(F.lit(plain_path(out)), F.col("study_instance_uid"), F.col("series_instance_uid"), F.col("sop_instance_uid"))
    failed = F.coalesce("error_code", F.when(target.isNull(), F.lit("NO_OUTPUT_NAME")))
    rows = made.select(F.col("path").alias("source"), failed.alias("error"), target.alias("target"), F.when(failed.isNull(), F.col("tiff")).alias("tiff"))
    return sinks.write_files(rows, plain_path(out), "target", "tiff", ["source", "error", "target"]).select(F.when(F.col("error").isNull(), F.col("target")).otherwise(F.col("source")).alias("path"), "error")


def run_manifest(spark: SparkSession, source: str, out: str | None = None) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    info = scan_headers(spark, source, "tiff").select("path", *map(zero, ("width", "height", "channels", "num_frames")))
    table = relational.manifest(S.with_inode(info))
    if out:
        sinks.write_table(table, out, single=True)
    return table


def run_validate(spark: SparkSession, source: str, decode: bool = True) -> DataFrame:
    """One row a file: findings, counts, a JSON report. Frame 0 is decoded only where the rules found no error."""
    checked = validation.validate(header_rows(spark, source))
    if decode:
        sound = S.read_files(checked.where("valid").select(F.lit(0).cast("long").alias("n"), "path"))
        checked = validation.with_decode(checked, prepare.decode_checks(sound))
    else:
        none = prepare.decode_checks(checked.where("false").select("path", F.lit(None).cast("binary").alias("content")))
        checked = validation.with_decode(checked, none, "not asked for")
    return validation.report_json(checked)


def run_traces(spark: SparkSession, source: str, traces: str, out: str | None = None, previews: str | None = None) -> DataFrame:
    """Annotation boxes in the coordinates of prepared TIFFs, whose names are instance identifiers; previews: a folder for pictures of them."""
    found = S.load_source(spark, source, "tiff")
    sop = paths.stem(F.col("path")).alias("sop_instance_uid")
    info = prepare.tiff_info(found).select("*", sop)
    j = relational.join_traces(info, S.read_traces(spark, traces))
    at = lambda c, i, d=0: F.coalesce(F.get(c, i), F.lit(d))
    big = F.lit(1 << 40)
    maps = [
        FlipMap(at("flip", 0, 1 << 40), at("flip", 1, 1 << 40), at("flip", 2) == 1, at("flip", 3) == 1),
        CropMap(at("crop", 0), at("crop", 1), F.coalesce(F.get("crop", 2), big), F.coalesce(F.get("crop", 3), big)),
        ResizeMap(at("scale", 0, 1.0), at("scale", 1, 1.0)), PadMap(at("padding", 0), at("padding", 1)),
    ]
    table = relational.remap_traces(j, maps, F.col("width"), F.col("height"), ["sop_instance_uid", "trace_hash"])
    if out:
        sinks.write_table(table, out, single=True)
    if previews:
        boxes = table.groupBy("sop_instance_uid").agg(F.collect_list(F.struct("x_min", "x_max", "y_min", "y_max")).alias("boxes"))
        drawn = found.select(sop, "content").join(boxes, "sop_instance_uid")
        target = F.concat(F.lit(plain_path(previews) + "/"), F.col("sop_instance_uid"), F.lit(".tiff"))
        sinks.write_files(prepare.previews(drawn.select(target.alias("path"), "content", "boxes")), plain_path(previews))
    return table


def run_combine(spark: SparkSession, source: str, meta: str, out: str) -> DataFrame:
    """Single-frame TIFFs of a series as one TIFF, in the order of their instance numbers."""
    from voxlake.codec import tiff

    found = S.load_source(spark, source, "tiff")
    ids = paths.path_ids(F.col("path"))
    named = found.select("path", "content", ids.alias("i")).where("i is not null").select("path", "content", "i.*")
    m = S.read_series(spark, meta).withColumn("row", F.monotonically_increasing_id())
    j = relational.combine_series(named, m, series="series_instance_uid", sop="sop_instance_uid", instance="instance_number", row="row", tie=["path"])

    def one(key, t):
        import pyarrow as pa

        t = t.sort_by("slot")
        images = [tiff.Tiff(c.as_py()) for c in t.column("content")]
        frames = [i.frame(0) for i in images]
        first = images[0].preparation()
        meta_ = tiff.Preparation(first.flip, first.crop, first.resize, first.padding, first.resolution, len(frames))
        target = "/".join((plain_path(out), t.column("study_instance_uid")[0].as_py(), key[0].as_py(), f"{t.column('stack_name')[0].as_py()}.tiff"))
        return pa.table({"path": [target], "content": pa.array([tiff.encode(frames, meta_)], pa.binary()), "files": pa.array([len(frames)], pa.int64())})

    stacks = j.select("series_instance_uid", "study_instance_uid", "stack_name", "slot", "content").groupBy("series_instance_uid").applyInArrow(one, "path string, content binary, files long")
    return sinks.write_files(stacks, plain_path(out))


def run_stats(spark: SparkSession, source: str, normalize: bool = False) -> DataFrame:
    """Mean and deviation of each channel over all files, which must have the same number of channels."""
    parts = prepare.tiff_stats(S.load_source(spark, source, "tiff"), normalize)
    merged = relational.merge_stats(parts.withColumn("files", F.lit(1)), ["channel"], also={"files": F.sum("files")})
    rows = merged.orderBy("channel").collect()  # one row a channel
    if len({r.files for r in rows}) > 1:
        held = ", ".join(f"channel {r.channel} in {r.files} files" for r in rows)
        raise ImageError("CHANNEL_MISMATCH", f"files differ in their number of channels: {held}")
    return spark.createDataFrame(rows, merged.schema).drop("files").orderBy("channel")


def run_voilut(spark: SparkSession, source: str) -> DataFrame:
    return header_rows(spark, source).select("path", "VOILUTFunction", "RescaleSlope", "RescaleIntercept", "WindowCenter", "WindowWidth")


def run_resize(spark: SparkSession, source: str, out: str, scale: float, kind: str = "nearest") -> DataFrame:
    found = S.load_source(spark, source, "tiff")
    target = F.concat(F.lit(plain_path(out) + "/"), S.relative_to(found, source))
    rows = found.select(target.alias("path"), "content")

    def run(it):
        import pyarrow as pa

        for b in it:
            made = [prepare.resize_tiff(c, scale, kind) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return sinks.write_files(rows.mapInArrow(run, "path string, content binary"), plain_path(out))


def run_order(spark: SparkSession, source: str) -> DataFrame:
    """Order of the files of each series by geometry, else by instance number."""
    return series_positions(header_rows(spark, source))


def header_rows(spark: SparkSession, source: str) -> DataFrame:
    """Header columns of a folder's or a list's files; what stands before the samples is all that is read of a folder."""
    if source.endswith(".txt"):
        return prepare.headers(S.load_source(spark, source))
    return scan_headers(spark, source)


def series_positions(h: DataFrame) -> DataFrame:
    """(series, path, position, strategy, spacing, error) of single-frame files, from their header rows."""
    text = {"frame_of_reference": "FrameOfReferenceUID", "rows": "Rows", "columns": "Columns", "samples": "SamplesPerPixel", "bits": "BitsAllocated", "photometric": "PhotometricInterpretation"}
    rows = h.select(
        F.col("SeriesInstanceUID").alias("series"), "path", *[F.col(c).alias(n) for n, c in text.items()], F.col("PixelSpacing").alias("pixel_spacing"),
        numbers(F.col("ImagePositionPatient")).alias("image_position"), numbers(F.col("ImageOrientationPatient")).alias("image_orientation"),
        F.col("InstanceNumber").try_cast("long").alias("instance_number"), F.col("SpacingBetweenSlices").try_cast("double").alias("spacing_between"),
        F.coalesce(F.col("NumberOfFrames").try_cast("long"), F.lit(1)).alias("n_frames"), (F.upper("VolumetricProperties") == "SAMPLED").alias("sampled"), "error_code",
    )
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("series").orderBy("path")) - 1)
    out = ordering.series_order(rows)
    return out.select("series", "path", "position", "strategy", "spacing", F.coalesce("error_code", "error").alias("error"))


def preparation_arguments(a: argparse.ArgumentParser) -> None:
    a.add_argument("source")
    a.add_argument("output")
    for flag in ("--crop", "--crop-max", "--components", "--no-padding", "--strict"):
        a.add_argument(flag, action="store_true")
    a.add_argument("--border", type=float)
    a.add_argument("--size", type=lambda v: tuple(map(int, v.split(","))))
    a.add_argument("--spacing", type=lambda v: (*map(float, v.split(",")), None)[:3])
    a.add_argument("--filter", default="triangle", choices=[*FILTERS, *ALIASES])
    a.add_argument("--padding", default="zero", choices=PADDINGS)
    a.add_argument("--handler", default="keep", choices=HANDLERS)
    a.add_argument("--skip-start", type=int, default=5)
    a.add_argument("--skip-end", type=int, default=5)
    a.add_argument("--target-frames", type=int)
    a.add_argument("--mip-weight", type=float, default=1.5)
    a.add_argument("--projection", default="central-slice", choices=("central-slice", "parallel-beam"))
    a.add_argument("--voi", default="default")
    a.add_argument("--compression", default="packbits", choices=("none", "packbits", "lzw", "deflate"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxlake")
    sub = p.add_subparsers(dest="job", required=True)
    for job in ("preprocess", "series"):
        preparation_arguments(sub.add_parser(job))
    wanted = {
        "manifest": ("source", "output"), "validate": ("source",), "traces": ("source", "traces", "output"), "combine": ("source", "metadata", "output"),
        "stats": ("source",), "voilut": ("source",), "order": ("source",), "resize": ("source", "output"),
    }
    jobs = {}
    for job, names in wanted.items():
        jobs[job] = sub.add_parser(job)
        for n in names:
            jobs[job].add_argument(n)
    jobs["validate"].add_argument("--decode", default="frame", type=str.lower, choices=("none", "frame"))
    jobs["validate"].add_argument("--format", default="json", choices=("json", "text"))
    jobs["validate"].add_argument("--quiet", action="store_true")
    jobs["validate"].add_argument("--verbose", action="store_true")
    jobs["traces"].add_argument("--previews")
    jobs["stats"].add_argument("--normalize", action="store_true")
    jobs["resize"].add_argument("scale", type=float)
    jobs["resize"].add_argument("--filter", default="nearest", choices=[*FILTERS, *ALIASES])
    return p


def settings(a: argparse.Namespace) -> Preprocessor:
    voi = a.voi if a.voi in ("default", "normalize") else tuple(map(float, a.voi.split(",")))
    h = Handler(a.handler, a.skip_start, a.skip_end, a.target_frames, a.mip_weight, a.projection)
    return Preprocessor(a.crop, a.crop_max, a.components, a.border, a.size, a.spacing, a.filter, a.padding, not a.no_padding, h, voi, a.strict)


def main(argv: list[str] | None = None) -> int:
    """0: done, 1: some file failed, 2: wrong arguments."""
    a = parser().parse_args(argv)
    try:
        cfg = settings(a) if a.job in ("preprocess", "series") else None
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = session()
    if a.job in ("preprocess", "series"):
        run = run_preprocess if a.job == "preprocess" else run_series
        done = run(spark, a.source, a.output, cfg, a.compression).groupBy(F.col("error").isNotNull().alias("failed")).count().collect()
        counts = {r.failed: r["count"] for r in done}
        print(f"{counts.get(False, 0)} written, {counts.get(True, 0)} failed")
        return int(bool(counts.get(True)))
    if a.job == "manifest":
        print(run_manifest(spark, a.source, a.output).count(), "files")
    elif a.job == "validate":
        bad = 0
        checked = validation.report_text(run_validate(spark, a.source, a.decode == "frame"), a.verbose)
        for r in checked.select("path", F.col("report" if a.format == "json" else "text").alias("said"), "valid").toLocalIterator():
            bad += not r.valid
            if not a.quiet or a.format == "text" and not r.valid:
                print(r.said)
        return int(bad > 0)
    elif a.job == "traces":
        print(run_traces(spark, a.source, a.traces, a.output, a.previews).count(), "traces")
    elif a.job == "combine":
        print(run_combine(spark, a.source, a.metadata, a.output).count(), "stacks")
    elif a.job == "stats":
        run_stats(spark, a.source, a.normalize).show(truncate=False)
    elif a.job == "voilut":
        run_voilut(spark, a.source).show(truncate=False)
    elif a.job == "order":
        run_order(spark, a.source).show(truncate=False)
    else:
        print(run_resize(spark, a.source, a.output, a.scale, a.filter).count(), "files")
    return 0


if __name__ == "__main__":
    sys.exit(main())
