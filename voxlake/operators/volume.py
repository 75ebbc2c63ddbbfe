"""Volume handlers over a pixel relation (series, frame, x, y, px) or a frame relation.

`frame` is the frame's key inside its series in stored order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions.dtype import f32

BLUR = (1, 4, 6, 4, 1)


def numbered(frames: DataFrame, series: str, order: list[str]) -> DataFrame:
    """idx (from 0) and n of each frame in its series."""
    w = Window.partitionBy(series)
    return frames.withColumns({"idx": F.row_number().over(w.orderBy(*order)) - 1, "n": F.count(F.lit(1)).over(w)})


def keep_volume(frames: DataFrame, series: str, order: list[str]) -> DataFrame:
    return numbered(frames, series, order).drop("n")


def central_slice(frames: DataFrame, series: str, order: list[str]) -> DataFrame:
    """The frame n div 2 of the ordered series."""
    return numbered(frames, series, order).where(F.col("idx") == F.floor(F.col("n") / 2)).drop("n")


def trimmed(frames: DataFrame, series: str, order: list[str], skip_start: int = 0, skip_end: int = 0, *, empty: str = "drop") -> DataFrame:
    """Frames [min(n, start), max(0, n - end)) of each series; a series that is left empty goes, or is an error (empty="error")."""
    kept = (F.col("idx") >= skip_start) & (F.col("idx") < F.col("n") - skip_end)
    if empty == "error":
        said = F.concat(F.lit("EMPTY_VOLUME: no frame is left of series "), F.coalesce(F.col(series).cast("string"), F.lit("null")))
        kept = F.when(F.col("n") <= skip_start + skip_end, F.raise_error(said).cast("boolean")).otherwise(kept)
    elif empty != "drop":
        raise ValueError(f"unknown choice {empty!r}")
    return numbered(frames, series, order).where(kept)


def max_intensity(pixels: DataFrame, series: str) -> DataFrame:
    """The largest sample of each place; combined before the shuffle."""
    return pixels.groupBy(series, "x", "y").agg(F.max("px").alias("px"))


def depth_sum(pixels: DataFrame, series: str) -> DataFrame:
    """Sum over frames divided by its largest value (if above 0), the central image of the parallel-beam mode."""
    s = pixels.groupBy(series, "x", "y").agg(F.sum("px").alias("s"))
    top = s.groupBy(series).agg(F.max("s").alias("top"))
    v = F.when(F.col("top") > 0, F.col("s") / F.col("top")).otherwise(F.lit(0.0))
    return s.join(top, series).select(series, "x", "y", F.col("s").cast("long").alias("s"), v.alias("v"))


def interpolate(frames: DataFrame, series: str, order: list[str], target: int | Column, data: str = "data") -> DataFrame:
    """Linear resampling along the ordered frames to `target` frames, truncated, in f64 from an f32 position.

    Each source frame is read twice at most: the grid of targets joins its lower and upper neighbour by number.
    """
    src = numbered(frames, series, order).select(series, "idx", "n", F.col(data).alias("d"))
    t = F.lit(target) if isinstance(target, int) else target
    grid = src.groupBy(series).agg(F.first("n").alias("n")).withColumn("t", t.cast("int"))
    size = F.when(F.col("n") <= 1, F.col("n")).when(F.col("t") <= 1, F.lit(1)).otherwise(F.col("t"))
    grid = grid.withColumn("out", F.explode(F.sequence(F.lit(0), size.cast("int") - 1)))
    one = (F.col("n") <= 1) | (F.col("t") <= 1)
    pos = F.when(one, f32(F.lit(0.0))).otherwise(f32(f32(f32(F.col("out")) / f32(F.col("t") - 1)) * f32(F.col("n") - 1)))
    grid = grid.withColumn("pos", pos).withColumn("lo", F.floor("pos").cast("int")).withColumn("hi", F.ceil("pos").cast("int")).withColumn("a", f32(F.col("pos") - f32(F.col("lo"))).cast("double"))
    low = src.select(series, F.col("idx").alias("lo"), F.col("d").alias("dl"))
    high = src.select(series, F.col("idx").alias("hi"), F.col("d").alias("dh"))
    mixed = F.zip_with("dl", "dh", lambda x, y: F.floor(x * (1 - F.col("a")) + y * F.col("a")).cast("long"))
    return grid.join(low, [series, "lo"]).join(high, [series, "hi"]).select(series, F.col("out").alias("frame"), mixed.alias("data"))


def blur_weights(size: int) -> np.ndarray:
    """Edge-clamped 5-tap blur, then every second sample, as a weight table."""
    out = np.zeros(((size + 1) // 2, size))
    for o in range(len(out)):
        for d, w in enumerate(BLUR):
            out[o, min(max(2 * o + d - 2, 0), size - 1)] += w / 16
    return out


def corner_weights(size: int, target: int) -> np.ndarray:
    """Linear interpolation with the ends of both grids aligned, as a weight table."""
    out = np.zeros((target, size))
    for o in range(target):
        p = o * (size - 1) / (target - 1) if target > 1 else 0.0
        lo = int(np.floor(p))
        hi = min(lo + 1, size - 1)
        out[o, lo] += 1 - (p - lo)
        out[o, hi] += p - lo
    return out
