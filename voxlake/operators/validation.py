"""Validation rules over a header relation, as one array of findings per file.

Header columns are the attribute names; each may be null (absent). A column
`present` (array of attribute names) tells empty from absent; without it null
means absent. Rules run in a fixed order, so reports list findings alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.dtype import color_type
from voxlake.functions.geometry import resolution

FINDING = "array<struct<level:string,code:string,name:string,tag:string,message:string,value:string>>"
#: Attributes that must be unsigned 16-bit, their codes when missing, their tags.
REQUIRED = (
    ("Rows", "missing_rows", "(0028,0010)"), ("Columns", "missing_columns", "(0028,0011)"), ("SamplesPerPixel", "missing_samples_per_pixel", "(0028,0002)"),
    ("PhotometricInterpretation", "missing_photometric_interpretation", "(0028,0004)"), ("BitsAllocated", "missing_bits_allocated", "(0028,0100)"),
    ("BitsStored", "missing_bits_stored", "(0028,0101)"), ("HighBit", "missing_high_bit", "(0028,0102)"), ("PixelRepresentation", "missing_pixel_representation", "(0028,0103)"),
)
OPTIONAL = (("RescaleSlope", "(0028,1053)"), ("RescaleIntercept", "(0028,1052)"), ("WindowCenter", "(0028,1050)"), ("WindowWidth", "(0028,1051)"))


def _finding(level: str, code: str, name: str, tag: str | None, message: str, value: Column | None = None) -> Column:
    v = value.cast("string") if value is not None else F.lit(None).cast("string")
    return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(name).alias("name"), F.lit(tag).cast("string").alias("tag"), F.lit(message).alias("message"), v.alias("value"))


def findings(have: set[str]) -> Column:
    """The findings of one header row."""

    def col(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind)

    def stated(name: str) -> Column:
        here = F.lit(False)
        if name in have:
            here = F.col(name).isNotNull()
        return here | F.coalesce(F.array_contains("present", name), F.lit(False)) if "present" in have else here

    rules = []
    for name, code, tag in REQUIRED:
        text = name == "PhotometricInterpretation"
        v = F.nullif(F.trim(col(name, "string")), F.lit(""))
        number = v.try_cast("int")
        good = v.isNotNull() if text else number.between(0, 65535)
        bad = _finding("error", "invalid_string_value" if text else "invalid_u16_value", name, tag, f"{name} can't be read", v)
        rules.append(
            F.when(v.isNull() & stated(name), _finding("error", "empty_required_tag", name, tag, f"{name} has no value")).when(v.isNull(), _finding("error", code, name, tag, f"{name} is required"))
            .when(good, _finding("pass", "present", name, tag, f"{name} has a value", v)).otherwise(bad)
        )
    blank = lambda name: F.nullif(F.trim(col(name, "string")), F.lit(""))

    def u16(name: str) -> Column:
        n = col(name, "string").try_cast("int")
        return F.when(n.between(0, 65535), n)

    def rule(name: str, tag: str | None, *cases: tuple, otherwise: tuple | None = None) -> None:
        """The finding (level, code, message, value) of the first case (condition, finding) that holds."""
        made = lambda level, code, message, value=None: _finding(level, code, name, tag, message, value)
        out = F.when(cases[0][0], made(*cases[0][1]))
        for when, what in cases[1:]:
            out = out.when(when, made(*what))
        rules.append(out.otherwise(made(*otherwise)) if otherwise else out)

    size = col("PixelDataLength", "long")
    rule(
        "PixelData", "(7FE0,0010)",
        (size.isNull(), ("error", "missing_pixel_data", "PixelData is required")),
        (size == 0, ("error", "empty_pixel_data", "PixelData has no bytes")),
        otherwise=("pass", "present", "PixelData has bytes", size),
    )
    nf = blank("NumberOfFrames")
    rule(
        "NumberOfFrames", "(0028,0008)",
        (nf.isNull(), ("info", "default_number_of_frames", "one frame is assumed", F.lit(1))),
        (nf.try_cast("int") > 0, ("pass", "present", "NumberOfFrames is positive", nf)),
        otherwise=("error", "invalid_number_of_frames", "NumberOfFrames must be a positive integer", nf),
    )
    pc = blank("PlanarConfiguration")
    rule(
        "PlanarConfiguration", "(0028,0006)",
        (pc.isNull(), ("info", "default_planar_configuration", "0 is assumed", F.lit(0))),
        (pc.try_cast("int").isin(0, 1), ("pass", "present", "PlanarConfiguration is valid", pc)),
        otherwise=("error", "invalid_planar_configuration", "PlanarConfiguration must be 0 or 1", pc),
    )
    pr, ba, bs, hb = u16("PixelRepresentation"), u16("BitsAllocated"), u16("BitsStored"), u16("HighBit")
    right_high = (bs > 0) & (hb == F.greatest(bs - 1, F.lit(0))) & (hb < ba)
    rule("PixelRepresentation", "(0028,0103)", (pr > 1, ("error", "invalid_pixel_representation", "PixelRepresentation must be 0 or 1", pr)))
    rule("BitsAllocated", "(0028,0100)", (~ba.isin(8, 16), ("error", "unsupported_bits_allocated", "BitsAllocated must be 8 or 16", ba)))
    rule("BitsStored", "(0028,0101)", (~bs.between(F.lit(1), ba), ("error", "invalid_bits_stored", "BitsStored must lie in 1..BitsAllocated", bs)))
    rule("HighBit", "(0028,0102)", (~right_high, ("error", "invalid_high_bit", "HighBit must be BitsStored - 1 and below BitsAllocated", hb)))
    kind = color_type(ba, F.trim(col("PhotometricInterpretation", "string")))
    rule(
        "Output color type", None,
        (kind.isNull(), ("error", "unsupported_output_color_type", "no output colour type fits")),
        otherwise=("pass", "present", "an output colour type fits", kind),
    )
    for name, tag in OPTIONAL:
        v = blank(name)
        rule(name, tag, (v.isNull(), ("warning", "optional_tag_absent", f"{name} is absent")), otherwise=("info", "optional_tag_present", f"{name} has a value", v))
    voi = col("VOILUTFunction", "string")
    rule(
        "VOILUTFunction", "(0028,1056)",
        (F.trim(voi) == "", ("warning", "empty_voi_lut_function", "VOILUTFunction is empty")),
        (voi.isNull(), ("info", "voi_lut_function_absent", "LINEAR is assumed")),
        otherwise=("info", "voi_lut_function_present", "VOILUTFunction has a value", voi),
    )
    items = col("VOILUTSequenceItems", "int")
    rule(
        "VOILUTSequence", "(0028,3010)",
        (items.isNull(), ("info", "voi_lut_sequence_absent", "VOILUTSequence is absent")),
        otherwise=("info", "voi_lut_sequence_present", "VOILUTSequence is there", items),
    )
    rule(
        "Pixel spacing", "(0028,0030)",
        (resolution(col("PixelSpacing", "array<double>")).isNull(), ("warning", "resolution_unavailable", "no pixel spacing")),
        otherwise=("info", "resolution_available", "pixel spacing is known"),
    )
    ready = (F.trim(col("StudyInstanceUID", "string")) != "") & (F.trim(col("SOPInstanceUID", "string")) != "")
    rule(
        "Directory output naming", None,
        (F.coalesce(ready, F.lit(False)), ("info", "directory_output_ready", "identifiers name an output")),
        otherwise=("warning", "directory_output_not_ready", "identifiers are missing"),
    )
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def validate(headers: DataFrame) -> DataFrame:
    """headers plus findings, n_errors, n_warnings, n_infos and valid."""
    return counted(headers.withColumn("findings", findings(set(headers.columns))))


DECODE = "Frame decode"


def with_decode(validated: DataFrame, tried: DataFrame, skipped: str = "skipped because of errors") -> DataFrame:
    """The decode outcome as a finding. tried: (path, decoded, code, error, expected_bytes) of the files whose frame 0 was decoded."""
    out = validated.join(tried, "path", "left")
    finding = (
        F.when(F.col("decoded").isNull(), _finding("info", "frame_decode_skipped", DECODE, "(7FE0,0010)", skipped))
        .when(F.col("decoded"), _finding("pass", "frame_decoded", DECODE, "(7FE0,0010)", "frame 0 decodes", F.col("expected_bytes")))
        .otherwise(_finding("error", "frame_decode_failed", DECODE, "(7FE0,0010)", "frame 0 can't be decoded", F.col("error")))
    )
    return counted(out.withColumn("findings", F.concat("findings", F.array(finding))))


def counted(df: DataFrame) -> DataFrame:
    """Adds n_errors, n_warnings, n_infos and valid."""
    count = lambda level: F.size(F.filter("findings", lambda f: f["level"] == level)).cast("long")
    return df.withColumns({"n_errors": count("error"), "n_warnings": count("warning"), "n_infos": count("info")}).withColumn("valid", F.col("n_errors") == 0)


def report_text(validated: DataFrame, verbose: bool = False) -> DataFrame:
    """Adds text: the verdict and the counts, then errors and warnings, and with verbose every check."""
    shown = F.col("findings") if verbose else F.filter("findings", lambda f: f["level"].isin("error", "warning"))
    value = lambda f: F.when(f["value"].isNull(), F.lit("")).otherwise(F.concat(F.lit(" = "), f["value"]))
    tag = lambda f: F.when(f["tag"].isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), f["tag"]))
    line = lambda f: F.concat(F.lit("  "), F.rpad(F.upper(f["level"]), 8, " "), f["code"], F.lit(": "), f["name"], tag(f), F.lit(", "), f["message"], value(f))
    head = F.format_string("%s: %s (%d errors, %d warnings, %d notes)", F.when(F.col("valid"), "PASS").otherwise("FAIL"), F.col("path"), F.col("n_errors"), F.col("n_warnings"), F.col("n_infos"))
    return validated.withColumn("text", F.array_join(F.concat(F.array(head), F.transform(shown, line)), "\n"))


def report_json(validated: DataFrame) -> DataFrame:
    """Adds report, a JSON text without absent members."""
    pick = lambda level: F.filter("findings", lambda f: f["level"] == level)
    body = F.struct(
        F.when(F.col("valid"), "pass").otherwise("fail").alias("status"),
        F.struct("valid", F.col("n_errors").alias("error_count"), F.col("n_warnings").alias("warning_count"), F.col("n_infos").alias("info_count")).alias("summary"),
        pick("error").alias("errors"), pick("warning").alias("warnings"), pick("info").alias("info"), F.col("findings").alias("checks"),
    )
    return validated.withColumn("report", F.to_json(body))
