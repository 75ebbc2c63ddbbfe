"""Order of frames in a file and of files in a series, by window functions.

Input is a relation with one row per frame (or file): a series key, the stored
number and nullable columns of geometry. Results carry the position, the
strategy, the spacing, and an error code where the rules reject the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions.geometry import dot, normal

TOL = 1e-4
PARALLEL_TOL = 1e-4


def _in(series: str, *order) -> Window:
    w = Window.partitionBy(series)
    return w.orderBy(*order) if order else w


def value_facts(df: DataFrame, series: str, number: str, value: str) -> DataFrame:
    """Adds rising, falling and unique of a value, tolerance 1e-4, and a row's places in stored and in value order from 0.

    One shuffle and two sorts: steps and places of an order come from one window each, the facts of the series from a third that needs no sort of its own.
    """
    stored, sorted_, w = _in(series, number), _in(series, value, number), _in(series)
    back = lambda o: F.col(value) - F.lag(value).over(o)
    df = df.select("*", back(stored).alias("__step"), (F.row_number().over(stored) - 1).cast("long").alias("stored_place"))
    df = df.select("*", back(sorted_).alias("__gap"), (F.row_number().over(sorted_) - 1).cast("long").alias("value_place"))
    any_ = lambda c: F.coalesce(F.bool_or(c).over(w), F.lit(False))
    facts = {"rising": any_(F.col("__step") > TOL), "falling": any_(F.col("__step") < -TOL), "unique": ~any_(F.col("__gap") <= TOL)}
    return df.withColumns(facts).drop("__step", "__gap")


def order_by_value(df: DataFrame, series: str, number: str, value: str) -> DataFrame:
    """Adds position and direction: input in one direction, even falling, is kept; a mixed one is sorted."""
    df = value_facts(df, series, number, value)
    mixed = F.col("rising") == F.col("falling")
    name = F.when(mixed, "mixed").when(F.col("rising"), "increasing").otherwise("decreasing")
    df = df.withColumns({"position": F.when(mixed, F.col("value_place")).otherwise(F.col("stored_place")), "direction": name})
    return df.drop("stored_place", "value_place")


def upper_median_gap(df: DataFrame, series: str, position: str, value: str, drop_ties: bool = True) -> DataFrame:
    """(series, spacing, n_gaps): element n div 2 of the sorted neighbour distances."""
    gap = F.abs(F.col(value) - F.lag(value).over(_in(series, position)))
    gaps = df.select(series, gap.alias("gap")).where(F.col("gap").isNotNull() & (F.col("gap") > TOL if drop_ties else F.lit(True)))
    w = _in(series)
    ranked = gaps.withColumns({"rn": F.row_number().over(_in(series, "gap")) - 1, "n_gaps": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("rn") == F.floor(F.col("n_gaps") / 2)).select(series, F.col("gap").alias("spacing"), "n_gaps")


def series_gap_check(df: DataFrame, series: str, position: str, value: str) -> DataFrame:
    """(series, spacing, n_gaps, n_bad, regular): every gap within max(5 %, 0.001 mm) of the upper median."""
    mid = upper_median_gap(df, series, position, value, drop_ties=False)
    gap = F.abs(F.col(value) - F.lag(value).over(_in(series, position)))
    gaps = df.select(series, gap.alias("gap")).where(F.col("gap").isNotNull())
    far = F.abs(F.col("gap") - F.col("spacing")) > F.greatest(0.05 * F.col("spacing"), F.lit(1e-3))
    return gaps.join(mid, series).groupBy(series).agg(F.first("spacing").alias("spacing"), F.first("n_gaps").alias("n_gaps"), F.count(F.when(far, 1)).alias("n_bad")).withColumn("regular", F.col("n_bad") == 0)


# ---------------------------------------------------------------- facts of a series, from its sorted rows

def _steps(values: Column) -> Column:
    """Each value less the one before it."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 2, n), F.slice(values, 1, n), lambda x, y: x - y)


def _some(values: Column, test) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def _every(c: Column) -> Column:
    return F.bool_and(F.coalesce(c, F.lit(False)))


def _differ(name: str) -> Column:
    return F.coalesce(F.min(name) != F.max(name), F.lit(False))


def _middle(values: Column) -> Column:
    """Element n div 2 of sorted values."""
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def _turned(rows: Column, axis: Column) -> Column:
    """Whether some row's normal isn't parallel to the axis."""
    return _some(rows, lambda r: 1 - F.abs(dot(axis, r["nrm"])) > PARALLEL_TOL)


def _with_missing(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


STRATEGIES = ("dimension-index", "stack", "geometry", "frame-increment-pointer", "slice-location", "raw")


FRAME_COLUMNS = {
    "dimension_index": "array<long>", "dimension_pointers": "array<string>", "stack_id": "string", "stack_position": "long", "temporal_position": "long", "image_position": "array<double>",
    "image_orientation": "array<double>", "sampled": "boolean", "vector_value": "double", "slice_location": "double", "spacing_between": "double", "slice_thickness": "double", "organization": "string",
}


def frame_order(df: DataFrame, series: str = "series", number: str = "frame") -> DataFrame:
    """Resolve the order of multi-frame files.

    Columns used where present: dimension_index array<long>, dimension_pointers
    array<string> (names of the indexed attributes), stack_id, stack_position,
    temporal_position, image_position, image_orientation, sampled, vector_value
    (the frame's entry of the vector that the frame increment pointer names),
    slice_location, spacing_between, slice_thickness, organization.
    Adds position, strategy, spacing and error.

    One aggregate a series decides strategy, error and spacing; its few columns
    are joined back, and one sort numbers the frames.
    """
    given = df.columns
    df = _with_missing(df, FRAME_COLUMNS)
    out = df.join(_frame_facts(df, series, number), series, "left")
    s = F.col("strategy")
    value = (
        F.when(s == "stack", F.col("stack_position").cast("double")).when(~F.col("__sorted"), None).when(s == "geometry", dot(F.col("image_position"), F.col("__axis")))
        .when(s == "frame-increment-pointer", F.col("vector_value")).when(s == "slice-location", F.col("slice_location"))
    )
    out = out.withColumns({"__index": F.when(s == "dimension-index", F.col("dimension_index")), "__value": value})
    position = F.row_number().over(_in(series, "__index", "__value", number)) - 1
    return out.withColumn("position", position.cast("long")).select(*given, "position", "strategy", "spacing", "error")


def _frame_facts(df: DataFrame, series: str, number: str) -> DataFrame:
    """(series, strategy, error, spacing, __axis, __sorted) of each file."""
    axis = normal(F.col("image_orientation"))
    stated = F.coalesce("spacing_between", "slice_thickness")
    k = F.size("dimension_pointers")
    row = F.struct(F.col(number).alias("k"), axis.alias("nrm"), F.col("image_position").alias("p"), F.col("vector_value").alias("vec"), F.col("slice_location").alias("loc"), F.col("stack_position").alias("at"), F.col("dimension_index").alias("d"))
    f = df.groupBy(series).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(row)).alias("r"), (_differ("temporal_position") | _differ("stack_id") | F.coalesce(F.bool_or(F.col("organization") == "3D_TEMPORAL"), F.lit(False))).alias("volumes"),
        _every((k > 0) & (F.size("dimension_index") == k)).alias("dim"), F.min_by("dimension_pointers", number).alias("pointers"), _every(F.col("stack_position").isNotNull()).alias("stack"),
        _every(~F.coalesce("sampled", F.lit(False)) & F.col("image_position").isNotNull() & F.col("image_orientation").isNotNull()).alias("geo"), F.bool_or(F.col("image_orientation").isNotNull() & axis.isNull()).alias("bad"),
        _every(F.col("vector_value").isNotNull()).alias("vec"), _every(F.col("slice_location").isNotNull()).alias("loc"), F.min_by(stated, F.when(stated.isNotNull(), F.col(number))).alias("stated"),
    )
    rows, first = F.col("r"), F.get("r", F.lit(0))
    f = f.withColumn("__axis", first["nrm"]).withColumn("proj", F.transform(rows, lambda r: dot(r["p"], F.col("__axis"))))
    lists = {"geometry": F.col("proj"), "frame-increment-pointer": F.transform(rows, lambda r: r["vec"]), "slice-location": F.transform(rows, lambda r: r["loc"])}
    unique = {name: ~_some(_steps(F.array_sort(v)), lambda g: g <= TOL) for name, v in lists.items()}
    may_vary = ("InStackPositionNumber", "ImagePositionPatient", "SliceLocation")
    varies = lambda p, i: ~p.isin(*may_vary) & F.exists(rows, lambda r: ~F.get(r["d"], i).eqNullSafe(F.get(first["d"], i)))
    dim_bad = F.col("dim") & _some(F.transform("pointers", varies), lambda b: b)
    stack_ok = F.col("stack") & (F.size(F.array_distinct(F.transform(rows, lambda r: r["at"]))) == F.col("n"))
    many = F.col("n") > 1
    error = F.when(many & (F.col("volumes") | dim_bad), "multi_volume").when(many & ~F.col("dim") & ~stack_ok & F.col("geo") & F.col("bad"), "zero_normal")
    strategy = (
        F.when(F.col("error").isNotNull(), None).when(~many, "raw").when(F.col("dim"), "dimension-index").when(stack_ok, "stack").when(F.col("geo") & ~_turned(rows, F.col("__axis")) & unique["geometry"], "geometry")
        .when(F.col("vec") & unique["frame-increment-pointer"], "frame-increment-pointer").when(F.col("loc") & unique["slice-location"], "slice-location").otherwise("raw")
    )
    f = f.withColumn("error", error).withColumn("strategy", strategy)
    s = F.col("strategy")
    by_value = F.coalesce(s.isin(*lists), F.lit(False))
    own = F.when(s == "geometry", lists["geometry"]).when(s == "frame-increment-pointer", lists["frame-increment-pointer"]).when(s == "slice-location", lists["slice-location"])
    f = f.withColumn("own", own).withColumn("__steps", _steps(F.col("own")))
    mixed = _some(F.col("__steps"), lambda g: g > TOL) == _some(F.col("__steps"), lambda g: g < -TOL)
    f = f.withColumn("__sorted", by_value & mixed)
    # Spacing: along the normal where all frames have geometry, along the sorting value, else as stated. A kept order is sorted already.
    by_index = F.array_sort(F.zip_with(rows, F.col("proj"), lambda r, p: F.struct(F.when(s == "dimension-index", r["d"]).alias("d"), F.when(s == "stack", r["at"]).alias("at"), r["k"].alias("k"), p.alias("p"))))
    along = F.when(s.isin("dimension-index", "stack") & F.col("geo"), F.transform(by_index, lambda r: r["p"])).when(F.col("__sorted"), F.array_sort(F.col("own"))).when(by_value, F.col("own"))
    gaps = F.array_sort(F.filter(F.transform(_steps(along), F.abs), lambda g: g > TOL))
    usable = ~F.coalesce(s.isin("frame-increment-pointer", "slice-location"), F.lit(False))
    spacing = F.when(F.col("error").isNull() & many, F.coalesce(_middle(gaps), F.when(usable, F.col("stated"))))
    return f.select(series, "strategy", "error", spacing.alias("spacing"), "__axis", "__sorted")


SAME = ("frame_of_reference", "rows", "columns", "samples", "bits", "photometric")


SERIES_COLUMNS = {
    "n_frames": "long", **{c: "string" for c in SAME}, "pixel_spacing": "array<double>", "image_position": "array<double>", "image_orientation": "array<double>",
    "instance_number": "long", "spacing_between": "double", "sampled": "boolean",
}


def series_order(df: DataFrame, series: str = "series", number: str = "idx") -> DataFrame:
    """Resolve the order of single-frame files of one series each.

    Columns used where present: n_frames, SAME columns, pixel_spacing array<double>,
    image_position, image_orientation, instance_number, spacing_between, sampled.
    Adds position, strategy (raw, geometry, instance-number), spacing and error;
    files without a series have the error missing_series.

    One aggregate a series decides everything but the positions, which take one sort.
    """
    given = df.columns
    df = _with_missing(df, SERIES_COLUMNS)
    out = df.join(_series_facts(df, series, number), series, "left").withColumn("error", F.when(F.col(series).isNull(), "missing_series").otherwise(F.col("error")))
    value = F.when(F.col("__by_geo"), dot(F.col("image_position"), F.col("__axis"))).otherwise(F.col("instance_number").cast("double"))
    out = out.withColumn("__value", F.when(F.col("__sorted"), value))
    position = F.row_number().over(_in(series, "__value", number)) - 1
    return out.withColumn("position", F.when(F.col("error").isNull(), position).cast("long")).select(*given, "strategy", "position", "spacing", "error")


def _series_facts(df: DataFrame, series: str, number: str) -> DataFrame:
    """(series, strategy, error, spacing, __axis, __by_geo, __sorted) of each series."""
    between, sampled = F.col("spacing_between"), F.coalesce("sampled", F.lit(False))
    geo = F.col("image_position").isNotNull() & F.col("image_orientation").isNotNull()
    row = F.struct(
        F.col(number).alias("k"), normal(F.col("image_orientation")).alias("nrm"), F.col("image_position").alias("p"), F.col("image_orientation").alias("o"), F.col("instance_number").cast("double").alias("i"),
        F.col("pixel_spacing").alias("px"), F.struct(*[F.col(c).cast("string").alias(c) for c in SAME]).alias("same"),
    )
    f = df.groupBy(series).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(row)).alias("r"), F.bool_or(F.coalesce("n_frames", F.lit(1).cast("long")) > 1).alias("multi"), F.count(F.when(sampled, 1)).alias("samp"), F.count(F.when(geo, 1)).alias("geo"),
        F.count("instance_number").alias("inst"), F.min(between).alias("low"), F.max(between).alias("high"), F.count(between).alias("stated"),
    )
    rows, first = F.col("r"), F.get("r", F.lit(0))
    far = lambda a, b: F.coalesce(F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) > TOL), lambda v: v), a.isNull() != b.isNull())
    raw = F.col("samp") == F.col("n")
    f = f.withColumns({"__axis": first["nrm"], "__by_geo": ~raw & (F.col("geo") == F.col("n"))})
    by_geo = F.col("__by_geo")
    f = f.withColumn("v", F.transform(rows, lambda r: F.when(by_geo, dot(r["p"], F.col("__axis"))).otherwise(r["i"])))
    f = f.withColumns({"steps": _steps(F.col("v")), "gaps": F.array_sort(F.filter(_steps(F.array_sort("v")), lambda g: g.isNotNull()))}).withColumn("mid", _middle(F.col("gaps")))
    differs = _some(rows, lambda r: ~r["same"].eqNullSafe(first["same"]) | far(r["px"], first["px"]))
    uneven = _some(F.col("gaps"), lambda g: F.abs(g - F.col("mid")) > F.greatest(0.05 * F.col("mid"), F.lit(1e-3)))
    error = (
        F.when(F.col("multi"), "multi_frame").when(differs, "incompatible").when(~raw & (F.col("samp") > 0), "mixed_sampled").when(raw, None).when((F.col("geo") > 0) & ~by_geo, "partial_geometry")
        .when(by_geo & _some(rows, lambda r: far(r["o"], first["o"])), "orientation_differs").when(~by_geo & (F.col("inst") < F.col("n")), "missing_instance_number")
        .when(_some(F.col("gaps"), lambda g: g <= TOL), "duplicate_position").when(by_geo & uneven, "irregular_spacing")
    )
    strategy = F.when(error.isNull(), F.when(raw, "raw").when(by_geo, "geometry").otherwise("instance-number"))
    monotone = raw | ~_some(F.col("steps"), lambda g: g <= 0) | ~_some(F.col("steps"), lambda g: g >= 0)
    stated = F.when((F.col("high") - F.col("low") <= TOL) & (F.col("low") > 0) & (F.col("stated") == F.col("n")), F.col("low"))
    spacing = F.when(error.isNull(), F.when(by_geo, F.col("mid")).otherwise(stated))
    return f.select(series, strategy.alias("strategy"), error.alias("error"), spacing.alias("spacing"), "__axis", "__by_geo", (~monotone).alias("__sorted"))
