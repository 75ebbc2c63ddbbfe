"""Sample types: conversions between u8, u16 and f32, the foreground test, colour types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest sample of each type.
TYPE_MAX = {"u8": 255, "u16": 65535, "f32": 1.0}


def f32(c: Column) -> Column:
    return c.cast("float")


def u16_to_u8(c: Column) -> Column:
    """Rounded to the nearest of 256 levels, in integers."""
    return F.floor((c.cast("long") * 255 + 32767) / 65535).cast("long")


def u8_to_u16(c: Column) -> Column:
    return c.cast("long") * 257


def to_unit(c: Column, dtype: str) -> Column:
    """u8 or u16 as float in 0..1; float / float is double in Spark, so it is cast back."""
    return f32(f32(c) / f32(F.lit(TYPE_MAX[dtype])))


def trunc_u32(c: Column) -> Column:
    """A float as unsigned integer: truncated, negative and NaN give 0."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(F.when(~F.isnan(c), c.cast("long")), F.lit(0).cast("long")))


def foreground(c: Column, *, check_max: bool = False, dtype: str = "u16") -> Column:
    """Not zero; with check_max saturated samples aren't foreground either."""
    fg = c != 0
    return fg & (c != TYPE_MAX[dtype]) if check_max else fg


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Integer Rec. 709 weights, as image tools apply them to RGB samples."""
    return F.floor((r * 2126 + g * 7152 + b * 722) / 10000)


def color_type(bits: Column, photometric: Column) -> Column:
    """gray16, gray8, rgb8 or null where unsupported."""
    mono = photometric.isin("MONOCHROME1", "MONOCHROME2")
    return F.when((bits == 16) & mono, "gray16").when((bits == 8) & mono, "gray8").when((bits == 8) & (photometric == "RGB"), "rgb8")


def channels(color: Column) -> Column:
    return F.when(color.isin("gray8", "gray16"), 1).when(color == "rgb8", 3).cast("int")


def dtype_name(bits: Column, signed: Column) -> Column:
    return F.when(bits.isin(8, 16), F.concat(F.when(signed == 1, "int").otherwise("uint"), bits.cast("string")))
