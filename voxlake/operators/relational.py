"""Annotation remapping, series stacking, statistics, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions.paths import path_ids


def remap_traces(joined: DataFrame, maps: Sequence, width: Column, height: Column, keep: list) -> DataFrame:
    """Boxes (x_min..y_max) in prepared coordinates: both corners mapped, sorted again, the maxima clamped, empty ones dropped."""
    corners = (("__x0", "__y0"), ("__x1", "__y1"))
    joined = joined.withColumns({"__x0": F.col("x_min"), "__y0": F.col("y_min"), "__x1": F.col("x_max"), "__y1": F.col("y_max")})
    for m in maps:  # a projection a map, so that no map's input is written out twice in the next
        if m is not None:
            joined = joined.withColumns({n: c for x, y in corners for n, c in zip((x, y), m.apply(F.col(x), F.col(y)))})
    x0, y0, x1, y1 = (F.col(c) for pair in corners for c in pair)
    out = joined.select(
        *keep, F.least(x0, x1).alias("x_min"), F.least(F.greatest(x0, x1), width - 1).cast("long").alias("x_max"), F.least(y0, y1).alias("y_min"), F.least(F.greatest(y0, y1), height - 1).cast("long").alias("y_max")
    )
    return out.where((F.col("x_min") < F.col("x_max")) & (F.col("y_min") < F.col("y_max")))


def join_traces(files: DataFrame, traces: DataFrame, key: str = "sop_instance_uid") -> DataFrame:
    """Inner join; Spark broadcasts the traces only below its own size threshold."""
    return files.join(traces, key)


def last_metadata(meta: DataFrame, keys: list[str], value: str, row: str) -> DataFrame:
    """Of repeated keys the last row wins."""
    return meta.groupBy(*keys).agg(F.max_by(value, row).alias(value))


def combine_series(files: DataFrame, meta: DataFrame, *, series: str, sop: str, instance: str, row: str, tie: list[str]) -> DataFrame:
    """Files in the order of their instance numbers: adds slot and the first file of the stack."""
    joined = files.join(last_metadata(meta, [series, sop], instance, row), [series, sop])
    w = Window.partitionBy(series).orderBy(instance, *tie)
    return joined.withColumns({"slot": (F.row_number().over(w) - 1).cast("long"), "stack_name": F.first(sop).over(w)})


def channel_stats(samples: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """count, mean and sample deviation (0 for one sample); partial and final aggregation are Spark's."""
    return samples.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def partial_stats(samples: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Mergeable (n, mean, m2) of each part."""
    return samples.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merge_stats(parts: DataFrame, keys: list[str], also: dict | None = None) -> DataFrame:
    """n, mean and deviation of the union of parts; also: further aggregates by name."""
    also = also or {}
    n = F.sum("n")
    tot = parts.groupBy(*keys).agg(n.alias("n"), (F.sum(F.col("n") * F.col("mean")) / n).alias("mean"), F.sum("m2").alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("squares"), *[c.alias(n) for n, c in also.items()])
    m2 = F.col("within") + F.greatest(F.lit(0.0), F.col("squares") - F.col("n") * F.col("mean") * F.col("mean"))
    return tot.select(*keys, "n", "mean", F.when(F.col("n") < 2, 0.0).otherwise(F.sqrt(m2 / (F.col("n") - 1))).alias("std"), *also)


def manifest(files: DataFrame, path: str = "path") -> DataFrame:
    """study, series, sop, path, inode and sizes (0 where unreadable), in (study, sop) order."""
    ids = path_ids(F.col(path))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = files.withColumn("__ids", ids).where(F.col("__ids").isNotNull())
    return out.select("__ids.*", path, *[zero(c) for c in ("inode", "width", "height", "channels", "num_frames")]).orderBy("study_instance_uid", "sop_instance_uid")


def inode_order(files: DataFrame, inode: str = "inode") -> DataFrame:
    """Files in the order of their inodes, unknown ones (0) first."""
    return files.orderBy(F.coalesce(F.col(inode), F.lit(0)), "path")
