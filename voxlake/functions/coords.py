"""Coordinate maps between source and prepared frames; pure projections.

Scales are 32-bit floats. Products of floats stay floats in Spark; quotients become
doubles and are cast back before they are truncated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dtype import f32, trunc_u32


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


@dataclass(frozen=True)
class FlipMap:
    width: object
    height: object
    horizontal: object
    vertical: object

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        def turn(v, size, on):
            top = F.greatest(_lit(size) - 1, F.lit(0))
            return F.when(_lit(on), top - F.least(v, top)).otherwise(v).cast("long")

        return turn(x, self.width, self.horizontal), turn(y, self.height, self.vertical)

    invert = apply


@dataclass(frozen=True)
class CropMap:
    left: object
    top: object
    width: object
    height: object

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        def cut(v, start, size):
            return F.greatest(F.lit(0), F.least(v - _lit(start), _lit(size) - 1)).cast("long")

        return cut(x, self.left, self.width), cut(y, self.top, self.height)

    def invert(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (x + _lit(self.left)).cast("long"), (y + _lit(self.top)).cast("long")


@dataclass(frozen=True)
class ResizeMap:
    scale_x: object
    scale_y: object

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        return trunc_u32(f32(x) * f32(_lit(self.scale_x))), trunc_u32(f32(y) * f32(_lit(self.scale_y)))

    def invert(self, x: Column, y: Column) -> tuple[Column, Column]:
        return trunc_u32(f32(f32(x) / f32(_lit(self.scale_x)))), trunc_u32(f32(f32(y) / f32(_lit(self.scale_y))))


@dataclass(frozen=True)
class PadMap:
    left: object
    top: object
    right: object = 0
    bottom: object = 0

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (x + _lit(self.left)).cast("long"), (y + _lit(self.top)).cast("long")

    def invert(self, x: Column, y: Column) -> tuple[Column, Column]:
        zero = F.lit(0).cast("long")
        return F.greatest(zero, x - _lit(self.left)).cast("long"), F.greatest(zero, y - _lit(self.top)).cast("long")


def apply_all(maps: Sequence, x: Column, y: Column) -> tuple[Column, Column]:
    """Flip, crop, resize, pad in the given order; None entries are left out."""
    for m in maps:
        if m is not None:
            x, y = m.apply(x, y)
    return x, y


def invert_all(maps: Sequence, x: Column, y: Column) -> tuple[Column, Column]:
    for m in reversed(maps):
        if m is not None:
            x, y = m.invert(x, y)
    return x, y


def clamp(x: Column, size: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(x, size - 1)).cast("long")


def in_bounds(x: Column, y: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (y >= 0) & (x < width) & (y < height)
