"""Boxes, sizes, paddings, resolutions and orientation arithmetic as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dtype import f32


def border_window(size: int, border: float | None) -> tuple[int, int, int]:
    """(first, end, growth) of the searched part of a side, in 32-bit floats."""
    if border is None:
        return 0, size, 0
    b = np.float32(border)
    return int(np.float32(size) * b), int(np.float32(size) * (np.float32(1.0) - b)), int(np.float32(size) * b)


def box_union(boxes: list[tuple[Column, Column, Column, Column]]) -> tuple[Column, ...]:
    """(left, top, width, height) around boxes of the same form."""
    left = F.least(*[b[0] for b in boxes])
    top = F.least(*[b[1] for b in boxes])
    right = F.greatest(*[b[0] + b[2] for b in boxes])
    bottom = F.greatest(*[b[1] + b[3] for b in boxes])
    return left, top, right - left, bottom - top


def box_intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """Common box; sides of disjoint boxes are 0 instead of wrapping below zero."""
    left, top = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    right, bottom = F.least(a[0] + a[2], b[0] + b[2]), F.least(a[1] + a[3], b[1] + b[3])
    zero = F.lit(0).cast("long")
    return left, top, F.greatest(zero, right - left), F.greatest(zero, bottom - top)


def fit_scale(w: Column, h: Column, tw: int, th: int) -> Column:
    return F.least(f32(f32(F.lit(tw)) / f32(w)), f32(f32(F.lit(th)) / f32(h)))


def exact_scale(side: Column, target: int) -> Column:
    return f32(f32(F.lit(target)) / f32(side))


def scaled_side(side: Column, scale: Column) -> Column:
    """round(side * scale), half away from zero."""
    return F.floor((f32(side) * scale).cast("double") + 0.5).cast("long")


def padding(w: Column, h: Column, tw: int, th: int, direction: str, edges: tuple[Column, Column, Column, Column] | None = None) -> tuple[Column, Column, Column, Column]:
    """(left, top, right, bottom). direction: center, top-left, bottom-right or zero; zero looks at the zero samples of the four edges."""
    zero = F.lit(0).cast("long")
    px, py = F.greatest(zero, F.lit(tw) - w), F.greatest(zero, F.lit(th) - h)
    if direction == "center":
        left, top = F.floor(px / 2), F.floor(py / 2)
    elif direction == "top-left":
        left, top = px, py
    elif direction == "bottom-right":
        left, top = zero, zero
    elif direction == "zero":
        zl, zt, zr, zb = edges
        left, top = F.when(zl < zr, zero).otherwise(px), F.when(zt < zb, zero).otherwise(py)
    else:
        raise ValueError(f"unknown padding direction {direction!r}")
    return left.cast("long"), top.cast("long"), (px - left).cast("long"), (py - top).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def normal(o: Column) -> Column:
    """Unit normal of six direction cosines; null where it has no length."""
    g = [F.element_at(o, i + 1) for i in range(6)]
    n = [g[1] * g[5] - g[2] * g[4], g[2] * g[3] - g[0] * g[5], g[0] * g[4] - g[1] * g[3]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return F.when(size > 0, F.array(*[c / size for c in n]))


def resolution(spacing: Column, *z_spacings: Column) -> Column:
    """Pixels per mm from [row, column] spacing, frames per mm from the first z spacing known."""
    one = f32(F.lit(1.0))
    z = F.coalesce(*z_spacings) if z_spacings else F.lit(None).cast("double")
    return F.when(
        F.size(spacing) >= 2,
        F.struct(
            f32(one / f32(F.element_at(spacing, 2))).alias("ppmm_x"), f32(one / f32(F.element_at(spacing, 1))).alias("ppmm_y"), f32(one / f32(z)).alias("frames_per_mm")
        ),
    )


def scale_resolution(r: Column, sx: Column, sy: Column, sz: Column | None = None) -> Column:
    """Resize scales x and y; only a plain scale touches z."""
    z = r["frames_per_mm"] if sz is None else f32(r["frames_per_mm"] * f32(sz))
    return F.struct(f32(r["ppmm_x"] * f32(sx)).alias("ppmm_x"), f32(r["ppmm_y"] * f32(sy)).alias("ppmm_y"), z.alias("frames_per_mm"))


def unscale_resolution(r: Column, sx: Column, sy: Column) -> Column:
    """The resolution before a resize."""
    one = f32(F.lit(1.0))
    return scale_resolution(r, f32(one / f32(sx)), f32(one / f32(sy)))


def with_frames_per_mm(r: Column, z: Column) -> Column:
    return F.struct(r["ppmm_x"].alias("ppmm_x"), r["ppmm_y"].alias("ppmm_y"), f32(z).alias("frames_per_mm"))


def resampled_z(frames_per_mm: Column, n: Column, target: Column) -> Column:
    """Frames per mm once n frames have become `target` over the same depth; unchanged where nothing is resampled."""
    new = f32(f32(f32(frames_per_mm) * f32(target - 1)) / f32(n - 1))
    return F.when((n > 1) & (target > 1) & (n != target), new).otherwise(f32(frames_per_mm))


def dimensions(frames: Column, channels: Column, height: Column, width: Column, sample_bytes: Column) -> Column:
    """Shape (frames, channels, height, width), shape of a frame, samples and bytes of a volume."""
    n, c, h, w = (x.cast("long") for x in (frames, channels, height, width))
    return F.struct(
        F.array(n, c, h, w).alias("shape"), F.array(c, h, w).alias("frame_shape"), (n * c * h * w).alias("numel"), (n * c * h * w * sample_bytes.cast("long")).alias("n_bytes")
    )


def spacing_target(side: Column, ppmm: Column, spacing: float) -> Column:
    """The side whose pixels are `spacing` mm wide."""
    scale = f32(f32(f32(F.lit(1.0)) / f32(F.lit(spacing))) / f32(ppmm))
    return scaled_side(side, scale)


def z_target(n: Column, frames_per_mm: Column, spacing: float) -> Column:
    """Frames that cover the same depth at `spacing` mm."""
    depth = f32(f32(n - 1) / f32(frames_per_mm))
    return (F.floor(f32(depth / f32(F.lit(spacing))).cast("double") + 0.5) + 1).cast("long")


def tiff_resolution(ppmm: Column) -> Column:
    """Whole pixels per cm, as TIFF carries it."""
    return F.floor(f32(ppmm) * f32(F.lit(10.0))).cast("long")


def from_tiff_resolution(value: Column, unit: Column) -> Column:
    """unit 3: per cm, 2: per inch, else raw."""
    return F.when(unit == 3, f32(f32(value) / f32(F.lit(10.0)))).when(unit == 2, f32(f32(value) / f32(F.lit(25.4)))).otherwise(f32(value))
