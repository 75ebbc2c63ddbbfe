"""Paths: file kinds by name or magic, identifiers in directory names, output names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exactly these spellings count.
DICOM_EXTENSIONS = ("dcm", "dicom", "DCM", "DICOM")
TIFF_EXTENSIONS = ("tiff", "tif", "TIFF", "TIF")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name; empty without one, or if the dot is its first character."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    """The name without its last extension; identifiers hold dots themselves."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def has_magic(content: Column) -> Column:
    return F.coalesce(F.substring(content, 129, 4) == F.lit(b"DICM"), F.lit(False))


def is_dicom(path: Column, content: Column | None = None) -> Column:
    """By extension; files without one are read for their magic."""
    ext = extension(path)
    magic = has_magic(content) if content is not None else F.lit(False)
    return F.when(ext != "", ext.isin(*DICOM_EXTENSIONS)).otherwise(magic)


def is_tiff(path: Column) -> Column:
    return extension(path).isin(*TIFF_EXTENSIONS)


def path_ids(path: Column) -> Column:
    """struct(study, series, sop) from grandparent, parent and stem; null where one is missing."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    return F.when(
        n >= 3, F.struct(F.element_at(parts, n - 2).alias("study_instance_uid"), F.element_at(parts, n - 1).alias("series_instance_uid"), stem(path).alias("sop_instance_uid"))
    )


def output_path(root: Column, study: Column, series: Column, sop: Column) -> Column:
    """root/study/series/sop.tiff; series defaults to "series"; null without study or sop."""
    return F.when(study.isNotNull() & sop.isNotNull(), F.concat_ws("/", root, study, F.coalesce(series, F.lit("series")), F.concat(sop, F.lit(".tiff"))))
