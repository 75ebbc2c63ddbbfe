"""Coded strings of image headers: multi-values, numbers, patient orientation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x00]+|[\s\x00]+$", "")


def multi(c: Column) -> Column:
    """Parts of a backslash-separated value, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"\\"), clean), lambda p: p != "")


def code_values(c: Column) -> Column:
    return F.transform(multi(c), F.upper)


def numbers(c: Column) -> Column:
    """All parts as doubles, or null if one of them is no number."""
    parts = F.transform(multi(c), lambda p: p.try_cast("double"))
    return F.when((F.size(parts) > 0) & ~F.exists(parts, lambda v: v.isNull()), parts)


def tag(group: Column, element: Column) -> Column:
    return F.format_string("(%04X,%04X)", group, element)


def inverse_orientation(codes: Column) -> Column:
    return F.transform(codes, lambda c: F.translate(c, "APRLFH", "PALRHF"))


def expected_orientation(laterality: Column, view: Column) -> Column:
    """Patient orientation of breast views."""
    lv = F.concat_ws("-", laterality, view)
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return F.when(lv == "L-CC", pair("A", "R")).when(lv == "R-CC", pair("A", "L")).when(lv == "L-MLO", pair("A", "FR")).when(lv == "R-MLO", pair("A", "FL"))


#: Fixed value: the storage class of breast tomosynthesis.
TOMOSYNTHESIS = "1.2.840.10008.5.1.4.1.1.13.1.3"


def needs_flip(sop_class: Column, image_laterality: Column, laterality: Column, view: Column, orientation: Column) -> Column:
    """A tomosynthesis volume stored in the exact inverse of its expected orientation."""
    side = F.coalesce(F.when(clean(image_laterality) != "", F.upper(clean(image_laterality))), F.upper(clean(laterality)))
    want = expected_orientation(side, F.upper(clean(view)))
    return F.coalesce((clean(sop_class) == TOMOSYNTHESIS) & (code_values(orientation) == inverse_orientation(want)), F.lit(False))


def frame_count(text: Column) -> Column:
    """NumberOfFrames as a struct: n (1 where absent or empty), or the code of what is wrong with it."""
    plain = F.nullif(F.trim(text), F.lit(""))
    n = plain.try_cast("long")
    error = F.when(plain.isNotNull() & (n.isNull() | (n < 0)), "INVALID_NUMBER_OF_FRAMES").when(n > 65535, "TOO_MANY_FRAMES")
    return F.struct(F.when(error.isNull(), F.coalesce(n, F.lit(1).cast("long"))).alias("n"), error.alias("error"))


def sanitised(voi_function: Column) -> Column:
    """An empty VOI LUT function is as good as none."""
    return F.nullif(F.trim(voi_function), F.lit(""))
