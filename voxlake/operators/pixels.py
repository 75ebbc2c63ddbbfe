"""Frame operators on relations.

Two forms: a pixel relation (keys..., x, y, px), for aggregates, and a frame
relation (keys..., data array, row-major), for gathers, which need no shuffle.
Real images stay binary and use the kernels; these forms serve small frames and
are the reference for the kernels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions.dtype import foreground
from voxlake.functions.geometry import border_window, padding


def explode_frames(frames: DataFrame, keys: list[str], width: int | Column, data: str = "data") -> DataFrame:
    w = F.lit(width) if isinstance(width, int) else width
    return frames.select(*keys, w.alias("__w"), F.posexplode(data).alias("pos", "px")).select(
        *keys, (F.col("pos") % F.col("__w")).cast("long").alias("x"), F.floor(F.col("pos") / F.col("__w")).cast("long").alias("y"), F.col("px").cast("long").alias("px")
    )


def crop_boxes(frames: DataFrame, keys: list[str], width: int, height: int, *, check_max: bool = False, border: float | None = None, dtype: str = "u16", data: str = "data") -> DataFrame:
    """The box around the foreground of each frame: (keys, left, top, width, height); row by row, from the places of its foreground samples."""
    x0, x1, gx = border_window(width, border)
    y0, y1, gy = border_window(height, border)
    column = lambda i: i % width
    line = lambda i: F.floor(i / width)
    inside = lambda i: (column(i) >= x0) & (column(i) < x1) & (line(i) >= y0) & (line(i) < y1)
    fg = F.filter(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: foreground(F.get(data, i), check_max=check_max, dtype=dtype) & inside(i))
    seen = frames.select(*keys, fg.alias("__fg")).select(*keys, F.transform("__fg", column).alias("__x"), line(F.array_min("__fg")).alias("t"), line(F.array_max("__fg")).alias("b"))
    seen = seen.select(*keys, F.array_min("__x").alias("l"), F.array_max("__x").alias("r"), "t", "b")
    left = F.greatest(F.lit(0), F.coalesce("l", F.lit(0)) - gx)
    top = F.greatest(F.lit(0), F.coalesce("t", F.lit(0)) - gy)
    right = F.least(F.lit(width - 1), F.coalesce("r", F.lit(width - 1)) + gx)
    bottom = F.least(F.lit(height - 1), F.coalesce("b", F.lit(height - 1)) + gy)
    return seen.select(*keys, left.cast("long").alias("left"), top.cast("long").alias("top"), (right - left + 1).cast("long").alias("width"), (bottom - top + 1).cast("long").alias("height"))


def union_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """One box around the boxes of each group."""
    right, bottom = F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height"))
    return boxes.groupBy(*keys).agg(F.min("left").alias("left"), F.min("top").alias("top"), (right - F.min("left")).alias("width"), (bottom - F.min("top")).alias("height"))


def gather(data: Column, width: Column, height: Column, index) -> Column:
    """A new row-major frame: index(x, y) gives the source position (0-based) or null for 0."""
    w = width.cast("int")
    n = w * height.cast("int")

    def at(p):
        x, y = (p % w).cast("int"), F.floor(p / w).cast("int")
        return F.coalesce(F.get(data, index(x, y).cast("int")), F.lit(0))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.slice(data, 1, 0))


def crop_frame(data: Column, w: Column, left: Column, top: Column, cw: Column, ch: Column) -> Column:
    return gather(data, cw, ch, lambda x, y: (y + top) * w + x + left)


def pad_frame(data: Column, w: Column, h: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    def index(x, y):
        sx, sy = x - left, y - top
        return F.when((sx >= 0) & (sy >= 0) & (sx < w) & (sy < h), sy * w + sx)

    return gather(data, w + left + right, h + top + bottom, index)


def flip_frame(data: Column, w: Column, h: Column, horizontal: bool, vertical: bool) -> Column:
    return gather(data, w, h, lambda x, y: (h - 1 - y if vertical else y) * w + (w - 1 - x if horizontal else x))


def nearest_frame(data: Column, w: Column, h: Column, tw: int, th: int) -> Column:
    """The sample at the centre of each target pixel."""
    return gather(data, F.lit(tw), F.lit(th), lambda x, y: F.least(F.floor((2 * y + 1) * h / (2 * th)), h - 1) * w + F.least(F.floor((2 * x + 1) * w / (2 * tw)), w - 1))


def prepared_index(width: int, box: tuple[Column, Column, Column, Column], size: tuple[int, int], pad: tuple[Column, Column]):
    """Source position of a sample of the cropped, resized (nearest) and padded frame: one gather instead of three frames."""
    left, top, w, h = box
    tw, th = size

    def index(x, y):
        u, v = x - pad[0], y - pad[1]
        sx = F.least(F.floor((2 * u + 1) * w / (2 * tw)), w - 1) + left
        sy = F.least(F.floor((2 * v + 1) * h / (2 * th)), h - 1) + top
        return F.when((u >= 0) & (v >= 0) & (u < tw) & (v < th), sy * width + sx)

    return index


def cells(size: int, target: int) -> list[tuple[int, int]]:
    """[start, end) of the source samples of each target sample; at least its start sample."""
    out = []
    for o in range(target):
        a = min(o * size // target, size - 1)
        out.append((a, max(a + 1, min((o + 1) * size // target, size))))
    return out


def maxpool_frame(data: Column, w: int, h: int, tw: int, th: int) -> Column:
    """The largest sample of each cell."""
    xs, ys = cells(w, tw), cells(h, th)
    return F.array(*[F.greatest(*c) if len(c := [F.get(data, y * w + x) for y in range(*ys[v]) for x in range(*xs[u])]) > 1 else c[0] for v in range(th) for u in range(tw)])


def edge_zeros(frames: DataFrame, keys: list[str], width: int, height: int, data: str = "data") -> DataFrame:
    """Zero samples of the left, top, right and bottom edges; row by row."""
    along = lambda n, at: F.size(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(data, at(i)) == 0)).cast("long")
    left, right = along(height, lambda y: y * width), along(height, lambda y: y * width + width - 1)
    top, bottom = along(width, lambda x: x), along(width, lambda x: x + (height - 1) * width)
    return frames.select(*keys, left.alias("zl"), top.alias("zt"), right.alias("zr"), bottom.alias("zb"))


def zero_padding(frames: DataFrame, keys: list[str], width: int, height: int, tw: int, th: int) -> DataFrame:
    e = edge_zeros(frames, keys, width, height)
    l, t, r, b = padding(F.lit(width), F.lit(height), tw, th, "zero", tuple(F.col(c) for c in ("zl", "zt", "zr", "zb")))
    return e.select(*keys, l.alias("pad_left"), t.alias("pad_top"), r.alias("pad_right"), b.alias("pad_bottom"))


def separable_frames(frames: DataFrame, keys: list[str], weights_x: np.ndarray, weights_y: np.ndarray, data: str = "data") -> DataFrame:
    """(keys, data array<double>): each frame times two weight tables (target x source), in Arrow batches without a shuffle."""
    df = frames.select(*keys, data)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("data", T.ArrayType(T.DoubleType()))])
    w, h = weights_x.shape[1], weights_y.shape[1]

    def run(it):
        for b in it:
            x = b.column(len(keys)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, h, w)
            out = weights_y @ x @ weights_x.T
            size = out.shape[1] * out.shape[2]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * size), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], lists], names=[*b.schema.names[: len(keys)], "data"])

    return df.mapInArrow(run, schema)


def as_samples(data: Column, top: int = 65535) -> Column:
    """Rounded and clamped to 0..top; rounded to 6 digits first, so that ties don't depend on the order of addition."""
    return F.transform(data, lambda v: F.greatest(F.lit(0).cast("long"), F.least(F.lit(top).cast("long"), F.floor(F.round(v, 6) + 0.5))))
