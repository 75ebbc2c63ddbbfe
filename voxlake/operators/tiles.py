"""Frames in tiles, for images that are too large to go through a kernel whole.

A frame is cut into tiles of equal size (smaller at the right and the bottom). Each step is a kernel over one tile and
a halo of its neighbours' samples: every tile sends itself, and each neighbour the strip that it needs, by the key of the tile
that reads them, in one shuffle a step. Kernels get the window clipped to the image, so an edge is
where the window ends at the image's own border, and results don't depend on the tile size.

Pyramid fusion in this form: tasks keep the maximum, the sum and the central frame of each tile they see; these parts are
folded tile by tile, then the bilateral filter (halo 6) and the expansion (halo 5) are two exchanges. The brightest place
of the depth sum is an aggregate of the folded tiles, whose shuffle both branches read.

Defined results: a series that trimming leaves empty is an error (or goes, with empty="drop"); one frame left comes back
unchanged; a null frame or one of another length than width x height is an error that names its series; rows of equal
keys are frames each, in an order among them that isn't defined; images with a side of 2 or less are refused; an empty table gives no tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.errors import ImageError
from voxlake.kernels import volumes as V

from .volume import trimmed

#: Bytes of tiles that a task keeps before it passes them on.
HELD = 64 << 20
BILATERAL_HALO, EXPAND_HALO = 6, 5


@dataclass(frozen=True)
class Grid:
    """The tiles of a frame."""

    width: int
    height: int
    tile: int

    def span(self, k: int, vertical: bool) -> tuple[int, int]:
        size = self.height if vertical else self.width
        return k * self.tile, min(size, (k + 1) * self.tile)

    def window(self, ty: int, tx: int, halo: int = 0) -> tuple[int, int, int, int]:
        """(top, bottom, left, right) of a tile and its halo, inside the image."""
        (y0, y1), (x0, x1) = self.span(ty, True), self.span(tx, False)
        return max(0, y0 - halo), min(self.height, y1 + halo), max(0, x0 - halo), min(self.width, x1 + halo)

    def tiles(self) -> Iterator[tuple[int, int]]:
        for ty in range(-(-self.height // self.tile)):
            for tx in range(-(-self.width // self.tile)):
                yield ty, tx

    def around(self, ty: int, tx: int, halo: int) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
        """Other tiles whose halo reaches into this one, and the box they need of it."""
        reach = -(-halo // self.tile)
        y0, y1, x0, x1 = self.window(ty, tx)
        for v in range(max(0, ty - reach), min(-(-self.height // self.tile), ty + reach + 1)):
            for u in range(max(0, tx - reach), min(-(-self.width // self.tile), tx + reach + 1)):
                if (v, u) != (ty, tx):
                    a, b, c, d = self.window(v, u, halo)
                    box = max(a, y0), min(b, y1), max(c, x0), min(d, x1)
                    if box[0] < box[1] and box[2] < box[3]:
                        yield v, u, box


def _table(rows: Iterator[tuple], schema: pa.Schema, most: int = HELD // 4) -> Iterator[pa.RecordBatch]:
    """Batches of rows, bounded by the bytes that their binary values hold."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r if isinstance(v, bytes)) + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Row by row: of a batch, one row's values are Python objects at a time."""
    for b in it:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


def map_rows(df: DataFrame, each: Callable[[Iterator[tuple]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda it: _table(each(_rows(it)), arrow), schema)


def _kept(df: DataFrame, names: Sequence[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[n] for n in names), *T.StructType.fromDDL(more).fields])


def cut_tiles(frames: DataFrame, keys: list[str], grid: Grid, *, dtype: str = "<u2", data: str = "data") -> DataFrame:
    """(keys, ty, tx, data): the tiles of each frame, little-endian samples row by row; no shuffle."""

    def each(rows):
        for *k, d in rows:
            image = samples(d, grid, dtype, k)
            for ty, tx in grid.tiles():
                y0, y1, x0, x1 = grid.window(ty, tx)
                yield *k, ty, tx, image[y0:y1, x0:x1].tobytes()

    return map_rows(frames.select(*keys, data), each, _kept(frames, keys, "ty int, tx int, data binary"))


def samples(data: bytes | list[int] | None, grid: Grid, dtype: str, of: object) -> np.ndarray:
    flat = np.empty(0, dtype) if data is None else np.frombuffer(data, dtype) if isinstance(data, bytes) else np.array(data, dtype)
    if flat.size != grid.width * grid.height:
        raise ImageError("INCOMPATIBLE_FRAMES", f"a frame of {of} has {flat.size} samples, not {grid.width} x {grid.height}")
    return flat.reshape(grid.height, grid.width)


def exchange(tiles: DataFrame, keys: list[str], grid: Grid, halo: int, planes: dict[str, str], kernel: Callable[[dict, list[np.ndarray]], tuple], more: str) -> DataFrame:
    """kernel(row, windows) for each tile, its planes with their halo; the result is (keys, ty, tx) and the columns `more`.

    planes: binary columns and their sample types. A tile sends itself, and each neighbour its strip, by the key of the
    tile that reads them; a task holds the windows of one tile.
    """
    names, at = list(planes), [*keys, "ty", "tx"]
    rest = [c for c in tiles.columns if c not in (*at, *names)]

    def send(rows):
        for r in rows:
            ty, tx = r[len(keys) : len(at)]
            y0, y1, x0, x1 = grid.window(ty, tx)
            images = [np.frombuffer(d, planes[n]).reshape(y1 - y0, x1 - x0) for n, d in zip(names, r[len(at) :])]
            yield *r[: len(at) + len(names)], [y0, y1, x0, x1], True, *r[len(at) + len(names) :]
            for v, u, box in grid.around(ty, tx, halo):
                a, b, c, d = box
                yield *r[: len(keys)], v, u, *(i[a - y0 : b - y0, c - x0 : d - x0].tobytes() for i in images), list(box), False, *(None for _ in rest)

    schema = _kept(tiles, [*at, *names], "box array<int>, own boolean")
    schema = T.StructType([*schema.fields, *(T.StructField(c, tiles.schema[c].dataType) for c in rest)])
    sent = map_rows(tiles.select(*at, *names, *rest), send, schema)

    def assemble(rows):
        last, row, images = None, None, []

        def done():
            return (*last, *kernel(row, images))

        for r in rows:
            if r[: len(at)] != last:
                if last is not None:
                    yield done()
                last, row = r[: len(at)], None
                top, bottom, left, right = grid.window(last[-2], last[-1], halo)
                images = [np.zeros((bottom - top, right - left), planes[n]) for n in names]
            a, b, c, d = r[len(at) + len(names)]
            for image, n, data in zip(images, names, r[len(at) :]):
                image[a - top : b - top, c - left : d - left] = np.frombuffer(data, planes[n]).reshape(b - a, d - c)
            if r[len(at) + len(names) + 1]:
                row = dict(zip(at, last)) | dict(zip(rest, r[len(at) + len(names) + 2 :]))
        if last is not None:
            yield done()

    return map_rows(sent.repartition(*at).sortWithinPartitions(*at), assemble, _kept(tiles, at, more))


def inner(image: np.ndarray, grid: Grid, ty: int, tx: int, halo: int) -> np.ndarray:
    """The tile's own part of a window."""
    y0, y1, x0, x1 = grid.window(ty, tx)
    top, _, left, _ = grid.window(ty, tx, halo)
    return image[y0 - top : y1 - top, x0 - left : x1 - left]


def expanded(image: np.ndarray, grid: Grid, ty: int, tx: int) -> np.ndarray:
    """blur, every second sample, and back by interpolation, for a tile from its window of EXPAND_HALO.

    Samples are counted over the whole image: of the window's halved samples, those whose blur is whole are used.
    """
    top, bottom, left, right = grid.window(ty, tx, EXPAND_HALO)
    halved = V.blur(image)[top % 2 :: 2, left % 2 :: 2]
    y0, y1, x0, x1 = grid.window(ty, tx)
    for axis, (first, s, e, size) in enumerate(((top, y0, y1, grid.height), (left, x0, x1, grid.width))):
        n = -(-size // 2)
        p = np.arange(s, e, dtype=image.dtype) * image.dtype.type((n - 1) / (size - 1))
        lo = np.minimum(np.floor(p).astype(int), n - 1)
        f = (p - lo)[:, None] if axis == 0 else (p - lo)[None]
        at = -(-first // 2)
        halved = np.take(halved, lo - at, axis) * (1 - f) + np.take(halved, np.minimum(lo + 1, n - 1) - at, axis) * f
    return halved


# ---------------------------------------------------------------- pyramid fusion


def projected(frames: DataFrame, series: str, order: list[str], grid: Grid, *, central: str, skip_start: int, skip_end: int, data: str, empty: str = "error") -> DataFrame:
    """(series, ty, tx, n, m, c, top): maximum and sum (or middle frame) of each tile over the trimmed frames."""
    keyed = trimmed(frames.select(series, *order), series, order, skip_start, skip_end, empty=empty)  # keys only
    first = F.least(F.col("n"), F.lit(skip_start))
    middle = F.col("idx") - first == F.floor((F.col("n") - skip_end - first) / 2)
    same = [F.col(f"__k.{c}").eqNullSafe(F.col(f"__f.{c}")) for c in (series, *order)]
    kept = frames.alias("__f").join(keyed.withColumn("middle", middle).alias("__k"), same).select(F.col(f"__f.{series}").alias(series), "middle", F.col(f"__f.{data}").alias(data))
    beam = central == "parallel-beam"

    def merged(a: tuple, b: tuple) -> tuple:
        """Parts of one tile: frames, maximum, and sum or middle frame."""
        c = a[2] + b[2] if beam else a[2] if a[2] is not None else b[2]
        return a[0] + b[0], np.maximum(a[1], b[1]), c

    def out(key: tuple, part: tuple) -> tuple:
        n, m, c = part
        return *key, n, m.tobytes(), None if c is None else c.tobytes(), int(c.max()) if beam else None

    def partial(rows):
        held, size = {}, 0
        for key, mid, d in rows:
            image = samples(d, grid, "<u2", key)
            for ty, tx in grid.tiles():
                y0, y1, x0, x1 = grid.window(ty, tx)
                tile = image[y0:y1, x0:x1]
                part = 1, tile, tile.astype("<u8") if beam else tile if mid else None
                at = key, ty, tx
                size += 0 if at in held else tile.size * 10
                held[at] = merged(held[at], part) if at in held else part
            if size > HELD:
                yield from (out(k, p) for k, p in held.items())
                held, size = {}, 0
        yield from (out(k, p) for k, p in held.items())

    def fold(rows):
        """Runs of equal tiles in sorted rows; one tile is held."""
        last, held = None, None
        for key, ty, tx, n, m, c, _ in rows:
            part = n, np.frombuffer(m, "<u2"), None if c is None else np.frombuffer(c, "<u8" if beam else "<u2")
            if held is not None and (key, ty, tx) == last:
                held = merged(held, part)
                continue
            if held is not None:
                yield out(last, held)
            last, held = (key, ty, tx), part
        if held is not None:
            yield out(last, held)

    schema = _kept(frames, [series], "ty int, tx int, n long, m binary, c binary, top long")
    parts = map_rows(kept, partial, schema)
    return map_rows(parts.repartition(series, "ty", "tx").sortWithinPartitions(series, "ty", "tx"), fold, schema)


def fuse_tiles(frames: DataFrame, series: str, order: list[str], grid: Grid, *, central: str = "parallel-beam", mip_weight: float = 1.5, skip_start: int = 0, skip_end: int = 0, data: str = "data", empty: str = "error") -> DataFrame:
    """(series, ty, tx, data): pyramid fusion of the trimmed frames of each series, as u16 tiles."""
    if min(grid.width, grid.height) <= 2:
        raise ImageError("TOO_SMALL", "a side of 2 or less has no pyramid")
    if central not in ("parallel-beam", "central-slice"):
        raise ValueError(f"unknown projection {central!r}")
    base = projected(frames, series, order, grid, central=central, skip_start=skip_start, skip_end=skip_end, data=data, empty=empty)
    beam = central == "parallel-beam"
    if beam:  # the brightest place of the whole sum
        top = base.groupBy(F.col(series).alias("__series")).agg(F.max("top").alias("__top"))
        base = base.join(top, F.col(series).eqNullSafe(F.col("__series"))).withColumn("top", F.col("__top")).drop("__series", "__top")

    def unit(rows):
        for key, ty, tx, n, m, c, most in rows:
            image = np.frombuffer(m, "<u2")
            centre = np.frombuffer(c, "<u8").astype(np.float32) if beam else np.frombuffer(c, "<u2").astype(np.float32) / np.float32(65535)
            if beam and most:
                centre = centre / np.float32(most)
            yield key, ty, tx, m if n == 1 else None, (image.astype(np.float32) / np.float32(65535)).tobytes(), centre.tobytes()

    schema = _kept(frames, [series], "ty int, tx int, only binary, m binary, c binary")
    tiles = map_rows(base.select(series, "ty", "tx", "n", "m", "c", "top"), unit, schema)

    def smooth(row, images):
        both = [inner(V.bilateral(w), grid, row["ty"], row["tx"], BILATERAL_HALO) for w in images]
        return row["only"], *(np.ascontiguousarray(x).tobytes() for x in both)

    def fuse(row, images):
        ty, tx = row["ty"], row["tx"]
        if row["only"] is not None:
            return (row["only"],)
        em, ec = (expanded(w, grid, ty, tx) for w in images)
        m, c = (inner(w, grid, ty, tx, EXPAND_HALO) for w in images)
        return (V.combine(m, c, em, ec, mip_weight).astype("<u2").tobytes(),)

    smoothed = exchange(tiles, [series], grid, BILATERAL_HALO, {"m": "<f4", "c": "<f4"}, smooth, "only binary, m binary, c binary")
    return exchange(smoothed, [series], grid, EXPAND_HALO, {"m": "<f8", "c": "<f8"}, fuse, "data binary")


def tile_samples(tiles: DataFrame, keys: list[str], grid: Grid, *, dtype: str = "<u2") -> DataFrame:
    """(keys, x, y, px): one row a sample, for small images and for queries."""

    def each(rows):
        for *k, ty, tx, d in rows:
            y0, y1, x0, x1 = grid.window(ty, tx)
            for i, v in enumerate(np.frombuffer(d, dtype).tolist()):
                yield *k, x0 + i % (x1 - x0), y0 + i // (x1 - x0), v

    return map_rows(tiles.select(*keys, "ty", "tx", "data"), each, _kept(tiles, keys, "x long, y long, px long"))
