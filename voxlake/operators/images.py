"""Operators that need array kernels, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.kernels import images as K
from voxlake.kernels import volumes as V

#: Series of which a task holds two images at a time before it passes them on.
KEPT = 64


def component_boxes(frames: DataFrame, keys: list[str], width: int, height: int, *, check_max: bool = False, border: float | None = None, data: str = "data") -> DataFrame:
    """The largest component's box of each u16 frame; row by row, no shuffle."""
    df = frames.select(*keys, data)
    schema = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in ("left", "top", "width", "height")]])

    def run(it):
        for b in it:
            boxes = [K.component_box(np.array(d, np.uint16).reshape(height, width), check_max, border) for d in b.column(len(keys)).to_pylist()]
            cols = [pa.array([getattr(x, c) for x in boxes], pa.int64()) for c in ("left", "top", "width", "height")]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *cols], names=[*b.schema.names[: len(keys)], "left", "top", "width", "height"])

    return df.mapInArrow(run, schema)


def bilateral_frames(frames: DataFrame, keys: list[str], width: int, height: int, *, data: str = "data") -> DataFrame:
    """The bilateral filter of each u16 frame as values in 0..1; row by row, no shuffle."""
    df = frames.select(*keys, data)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(data, T.ArrayType(T.DoubleType()))])

    def run(it):
        for b in it:
            out = [V.bilateral(np.array(d, np.float32).reshape(height, width) / np.float32(65535)).ravel().tolist() for d in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(out, pa.list_(pa.float64()))], names=b.schema.names)

    return df.mapInArrow(run, schema)


def laplacian_mip(frames: DataFrame, series: str, frame: str, width: int, height: int, *, mip_weight: float = 1.5, data: str = "data") -> DataFrame:
    """Pyramid fusion with the parallel-beam centre.

    A task keeps the largest sample and the sum of each place for the series it sees, as two images; only these
    meet in the shuffle, a few a series and task, and are fused there.
    """
    df = frames.select(series, data)
    part = T.StructType([df.schema[series], T.StructField("m", T.ArrayType(T.LongType())), T.StructField("s", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])
    names = [series, "m", "s", "n"]
    lists = pa.list_(pa.int64())

    def rows_of(held: dict, kind: pa.DataType):
        images = list(held.values())
        return pa.RecordBatch.from_arrays([pa.array(list(held), kind), *(pa.array([x[i].tolist() for x in images], lists) for i in (0, 1)), pa.array([x[2] for x in images], pa.int64())], names=names)

    def partial(it):
        held: dict = {}
        kind = None
        for b in it:
            kind = b.column(0).type
            for key, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.array(d, np.int64)
                own = held.get(key)
                held[key] = (x, x, 1) if own is None else (np.maximum(own[0], x), own[1] + x, own[2] + 1)
            if len(held) > KEPT:
                yield rows_of(held, kind)
                held = {}
        if held:
            yield rows_of(held, kind)

    def one(key, t):
        m = np.max([np.array(v) for v in t.column("m").to_pylist()], 0)
        s = np.sum([np.array(v) for v in t.column("s").to_pylist()], 0)
        if sum(t.column("n").to_pylist()) == 1:
            out = m.tolist()
        else:
            total = s.astype(np.float32).reshape(height, width)
            centre = total / total.max() if total.max() > 0 else total
            out = V.fuse(m.astype(np.float32).reshape(height, width) / np.float32(65535), centre, mip_weight).ravel().astype(int).tolist()
        return pa.table({series: pa.array([key[0].as_py()], t.column(series).type), "data": pa.array([out], lists)})

    schema = T.StructType([df.schema[series], T.StructField("data", T.ArrayType(T.LongType()))])
    return df.mapInArrow(partial, part).groupBy(series).applyInArrow(one, schema)
