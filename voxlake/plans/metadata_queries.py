"""Queries over metadata: coordinates, traces, ordering, stacking, manifests, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.functions import codes, coords, dtype, geometry, paths
from voxlake.operators import ordering as O
from voxlake.operators import relational as R
from voxlake.operators import validation as D

from .views import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- coordinates

POINTS = (
    "pt AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_partkey AS p, l_suppkey AS s, (l_quantity * 2)::BIGINT AS x, (l_linenumber * 9 + l_suppkey % 13)::BIGINT AS y, "
    "l_returnflag = 'A' AS fh, l_linestatus = 'O' AS fv, (l_suppkey % 20)::BIGINT AS cl, (l_partkey % 15)::BIGINT AS ct, CAST(0.37 + l_discount * 10 AS FLOAT) AS sx, CAST(1.5 - l_tax * 5 AS FLOAT) AS sy, (l_orderkey % 6)::BIGINT AS pl, (l_orderkey % 4)::BIGINT AS pt FROM lineitem)"
)
FORWARD = (
    "f AS (SELECT *, CASE WHEN fh THEN 119 - least(x, 119) ELSE x END AS x1, CASE WHEN fv THEN 79 - least(y, 79) ELSE y END AS y1 FROM pt), "
    "c AS (SELECT *, CASE WHEN x1 > cl THEN least(x1 - cl, 69) ELSE 0 END AS x2, CASE WHEN y1 > ct THEN least(y1 - ct, 49) ELSE 0 END AS y2 FROM f), "
    "r AS (SELECT *, floor(CAST(x2::FLOAT * sx AS FLOAT)::DOUBLE)::BIGINT AS x3, floor(CAST(y2::FLOAT * sy AS FLOAT)::DOUBLE)::BIGINT AS y3 FROM c)"
)


def points(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), (F.col("l_quantity") * 2).cast("long").alias("x"),
        (F.col("l_linenumber") * 9 + F.col("l_suppkey") % 13).cast("long").alias("y"), (F.col("l_returnflag") == "A").alias("fh"), (F.col("l_linestatus") == "O").alias("fv"), (F.col("l_suppkey") % 20).cast("long").alias("cl"),
        (F.col("l_partkey") % 15).cast("long").alias("ct"), (F.lit(0.37) + F.col("l_discount") * 10).cast("float").alias("sx"), (F.lit(1.5) - F.col("l_tax") * 5).cast("float").alias("sy"),
        (F.col("l_orderkey") % 6).cast("long").alias("pl"), (F.col("l_orderkey") % 4).cast("long").alias("pt"),
    )


def chain():
    c = F.col
    return [coords.FlipMap(120, 80, c("fh"), c("fv")), coords.CropMap(c("cl"), c("ct"), 70, 50), coords.ResizeMap(c("sx"), c("sy")), coords.PadMap(c("pl"), c("pt"))]


@query(f"WITH {POINTS}, {FORWARD} SELECT k, n, p, s, x3 + pl AS ox, y3 + pt AS oy FROM r")
def coord_apply(spark, sf):
    x, y = coords.apply_all(chain(), F.col("x"), F.col("y"))
    return points(spark, sf).select("k", "n", "p", "s", x.alias("ox"), y.alias("oy"))


@query(
    f"WITH {POINTS}, i AS (SELECT *, floor(CAST(greatest(0, x - pl)::FLOAT / sx AS FLOAT)::DOUBLE)::BIGINT + cl AS x1, floor(CAST(greatest(0, y - pt)::FLOAT / sy AS FLOAT)::DOUBLE)::BIGINT + ct AS y1 FROM pt) "
    "SELECT k, n, p, s, CASE WHEN fh THEN 119 - least(x1, 119) ELSE x1 END AS ox, CASE WHEN fv THEN 79 - least(y1, 79) ELSE y1 END AS oy FROM i"
)
def coord_invert(spark, sf):
    x, y = coords.invert_all(chain(), F.col("x"), F.col("y"))
    return points(spark, sf).select("k", "n", "p", "s", x.alias("ox"), y.alias("oy"))


@query(f"WITH {POINTS} SELECT k, n, p, s, least(x, 90) AS cx, least(y, 50) AS cy, x < 91 AND y < 51 AS inside FROM pt")
def coord_clamp(spark, sf):
    w, h = F.lit(91).cast("long"), F.lit(51).cast("long")
    return points(spark, sf).select("k", "n", "p", "s", coords.clamp(F.col("x"), w).alias("cx"), coords.clamp(F.col("y"), h).alias("cy"), coords.in_bounds(F.col("x"), F.col("y"), w, h).alias("inside"))


TRACES = (
    "tr AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_partkey AS p, l_suppkey AS s, (l_quantity)::BIGINT AS x0, (l_quantity + l_linenumber * 4)::BIGINT AS x1, (l_suppkey % 40)::BIGINT AS y0, (l_suppkey % 40 + l_linenumber * 3)::BIGINT AS y1 FROM lineitem), "
    "fi AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, o_orderstatus = 'F' AS fh, o_orderstatus = 'O' AS fv, (o_custkey % 30)::BIGINT AS cl, (o_custkey % 17)::BIGINT AS ct FROM orders), "
    "j AS (SELECT tr.*, fi.fh, fi.fv, fi.cl, fi.ct FROM tr JOIN fi ON tr.k = fi.k)"
)


def _map_sql(x: str, y: str, i: int) -> str:
    fx, fy = f"CASE WHEN fh THEN 99 - least({x}, 99) ELSE {x} END", f"CASE WHEN fv THEN 79 - least({y}, 79) ELSE {y} END"
    cx = f"CASE WHEN ({fx}) > cl THEN least(({fx}) - cl, 59) ELSE 0 END"
    cy = f"CASE WHEN ({fy}) > ct THEN least(({fy}) - ct, 39) ELSE 0 END"
    return f"floor(CAST(({cx})::FLOAT * 1.5::FLOAT AS FLOAT)::DOUBLE)::BIGINT + 5 AS mx{i}, floor(CAST(({cy})::FLOAT * 1.5::FLOAT AS FLOAT)::DOUBLE)::BIGINT + 7 AS my{i}"


@query(
    f"WITH {TRACES}, m AS (SELECT k, n, p, s, {_map_sql('x0', 'y0', 0)}, {_map_sql('x1', 'y1', 1)} FROM j), "
    "b AS (SELECT k, n, p, s, least(mx0, mx1) AS x_min, least(greatest(mx0, mx1), 99) AS x_max, least(my0, my1) AS y_min, least(greatest(my0, my1), 74) AS y_max FROM m) SELECT * FROM b WHERE x_min < x_max AND y_min < y_max"
)
def trace_remap(spark, sf):
    return _remapped(spark, sf)


def _remapped(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    long = lambda c, n: c.cast("long").alias(n)
    q, ln, sk = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_suppkey")
    traces = li.select(F.col("l_orderkey").alias("k"), long(ln, "n"), F.col("l_partkey").alias("p"), sk.alias("s"), long(q, "x_min"), long(q + ln * 4, "x_max"), long(sk % 40, "y_min"), long(sk % 40 + ln * 3, "y_max"))
    k = F.when(F.col("o_custkey") % 3 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))  # files without traces, traces without files
    files = o.select(k.alias("k"), (F.col("o_orderstatus") == "F").alias("fh"), (F.col("o_orderstatus") == "O").alias("fv"), long(F.col("o_custkey") % 30, "cl"), long(F.col("o_custkey") % 17, "ct"))
    maps = [coords.FlipMap(100, 80, F.col("fh"), F.col("fv")), coords.CropMap(F.col("cl"), F.col("ct"), 60, 40), coords.ResizeMap(1.5, 1.5), coords.PadMap(5, 7)]
    return R.remap_traces(R.join_traces(files, traces, "k"), maps, F.lit(100).cast("long"), F.lit(75).cast("long"), ["k", "n", "p", "s"])


@query(SQL["trace_remap"].replace("SELECT * FROM b WHERE", "SELECT count(DISTINCT k) AS images, count(*) AS traces FROM b WHERE"))
def trace_totals(spark, sf):
    return _remapped(spark, sf).agg(F.countDistinct("k").alias("images"), F.count("*").alias("traces"))


@query(
    "WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 2 WHEN 0 THEN 'L' ELSE 'R' END AS lat, CASE (o_orderkey // 2) % 2 WHEN 0 THEN 'CC' ELSE 'MLO' END AS vw, "
    "CASE o_custkey % 5 WHEN 0 THEN 'P\\L' WHEN 1 THEN 'P\\R' WHEN 2 THEN 'P\\HL' WHEN 3 THEN 'p\\ HR ' ELSE 'A\\R' END AS ori, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS tomo FROM orders), "
    "e AS (SELECT *, CASE lat || '-' || vw WHEN 'L-CC' THEN 'P\\L' WHEN 'R-CC' THEN 'P\\R' WHEN 'L-MLO' THEN 'P\\HL' WHEN 'R-MLO' THEN 'P\\HR' END AS inv FROM o) "
    "SELECT k, tomo AND upper(replace(ori, ' ', '')) = inv AS flip FROM e"
)
def dbt_flip_rule(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 5
    lat = F.when(k % 2 == 0, "L").otherwise("R")
    view = F.when(F.floor(k / 2) % 2 == 0, "CC").otherwise("MLO")
    ori = F.when(c == 0, "P\\L").when(c == 1, "P\\R").when(c == 2, "P\\HL").when(c == 3, "p\\ HR ").otherwise("A\\R")
    pr = F.col("o_orderpriority")
    sop = F.when(pr.startswith("1") | pr.startswith("2"), codes.TOMOSYNTHESIS).otherwise("1.2.3")
    return o.select(k.alias("k"), codes.needs_flip(sop, F.lit(None).cast("string"), lat, view, ori).alias("flip"))


# ---------------------------------------------------------------- ordering (events: user = series, value = place)

EV = "ev AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS v, event_id FROM events)"
EV_DIR = (
    EV + ", st AS (SELECT *, v - lag(v) OVER (PARTITION BY series ORDER BY frame) AS d, v - lag(v) OVER (PARTITION BY series ORDER BY v, frame) AS g FROM ev), "
    "fa AS (SELECT series, coalesce(bool_or(d > 1e-4), false) AS up, coalesce(bool_or(d < -1e-4), false) AS dn, NOT coalesce(bool_or(g <= 1e-4), false) AS uniq FROM st GROUP BY series), "
    "po AS (SELECT ev.series, ev.frame, ev.v, ev.event_id, fa.up, fa.dn, fa.uniq, CASE WHEN fa.up = fa.dn THEN row_number() OVER (PARTITION BY ev.series ORDER BY ev.v, ev.frame) - 1 ELSE ev.frame END AS position FROM ev JOIN fa ON ev.series = fa.series)"
)


def events(spark, sf):
    """Numbered by time; every third user's values are made monotone, so both rules apply."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("series"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("value").alias("v"), "event_id")


DIRECTION = "CASE WHEN up = dn THEN 'mixed' WHEN up THEN 'increasing' ELSE 'decreasing' END AS direction"


@query(f"WITH {EV_DIR} SELECT series, frame, position, uniq AS \"unique\", {DIRECTION} FROM po")
def order_slice_location(spark, sf):
    return O.order_by_value(events(spark, sf), "series", "frame", "v").select("series", "frame", "position", "unique", "direction")


MONO = EV_DIR.replace("value AS v, event_id FROM events", "CASE user_id % 3 WHEN 0 THEN (epoch_us(ts) // 1000000)::DOUBLE WHEN 1 THEN -(epoch_us(ts) // 1000000)::DOUBLE ELSE value END AS v, event_id FROM events")


@query(f"WITH {MONO} SELECT series, frame, position, {DIRECTION} FROM po")
def order_monotone(spark, sf):
    """Falling and rising series keep their order, mixed ones are sorted."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.col("ts").cast("timestamp").cast("long").cast("double")
    v = F.when(F.col("user_id") % 3 == 0, sec).when(F.col("user_id") % 3 == 1, -sec).otherwise(F.col("value"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("series"), (F.row_number().over(w) - 1).cast("long").alias("frame"), v.alias("v"))
    return O.order_by_value(e, "series", "frame", "v").select("series", "frame", "position", "direction")


GAPS = EV_DIR + ", gp AS (SELECT series, abs(v - lag(v) OVER (PARTITION BY series ORDER BY position)) AS gap FROM po), rk AS (SELECT series, gap, row_number() OVER (PARTITION BY series ORDER BY gap) - 1 AS rn, count(*) OVER (PARTITION BY series) AS n FROM gp WHERE gap {cond}), md AS (SELECT series, gap AS spacing, n AS n_gaps FROM rk WHERE rn = n // 2)"


@query(f"WITH {GAPS.format(cond='> 1e-4')} SELECT series, round(spacing, 6) AS spacing, n_gaps FROM md")
def spacing_upper_median(spark, sf):
    o = O.order_by_value(events(spark, sf), "series", "frame", "v")
    return O.upper_median_gap(o, "series", "position", "v").select("series", F.round("spacing", 6).alias("spacing"), "n_gaps")


@query(f"WITH {GAPS.format(cond='IS NOT NULL')} SELECT gp.series, round(any_value(spacing), 6) AS spacing, any_value(n_gaps) AS n_gaps, count(*) FILTER (WHERE abs(gap - spacing) > greatest(0.05 * spacing, 1e-3)) AS n_bad FROM gp JOIN md ON gp.series = md.series WHERE gap IS NOT NULL GROUP BY gp.series")
def series_gap_check(spark, sf):
    o = O.order_by_value(events(spark, sf), "series", "frame", "v")
    return O.series_gap_check(o, "series", "position", "v").select("series", F.round("spacing", 6).alias("spacing"), "n_gaps", "n_bad")


FRAMES_SQL = (
    "fr AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS v, event_id, user_id % 6 AS kind FROM events)"
)


def header_frames(spark, sf, kind: int | None = None):
    """Headers of six kinds: dimension index, stack position, geometry, increment vector, slice location, nothing; by user, or one for all."""
    e = events(spark, sf).withColumn("kind", F.col("series") % 6 if kind is None else F.lit(kind))
    only = lambda k, c: F.when(F.col("kind") == k, c)
    return e.select(
        "series", "frame", "v", "event_id",
        only(0, F.array(F.lit(1).cast("long"), -F.col("event_id"))).alias("dimension_index"), only(0, F.array(F.lit("StackID"), F.lit("InStackPositionNumber"))).alias("dimension_pointers"),
        only(1, F.col("event_id")).alias("stack_position"), only(2, F.array(F.lit(0.0), F.lit(0.0), F.col("v"))).alias("image_position"), only(2, F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0)])).alias("image_orientation"),
        only(3, F.col("v")).alias("vector_value"), only(4, F.col("v")).alias("slice_location"), only(5, F.lit(2.5)).alias("slice_thickness"),
    )


CASCADE = FRAMES_SQL + (
    ", fg AS (SELECT *, v - lag(v) OVER (PARTITION BY series ORDER BY v, frame) AS g, v - lag(v) OVER (PARTITION BY series ORDER BY frame) AS d FROM fr), "
    "fs AS (SELECT series, NOT coalesce(bool_or(g <= 1e-4), false) AS uniq, coalesce(bool_or(d > 1e-4), false) AS up, coalesce(bool_or(d < -1e-4), false) AS dn, count(*) AS n FROM fg GROUP BY series), "
    "ss AS (SELECT fr.*, fs.up, fs.dn, CASE WHEN n <= 1 THEN 'raw' WHEN kind = 0 THEN 'dimension-index' WHEN kind = 1 THEN 'stack' WHEN kind = 2 AND uniq THEN 'geometry' WHEN kind = 3 AND uniq THEN 'frame-increment-pointer' WHEN kind = 4 AND uniq THEN 'slice-location' ELSE 'raw' END AS strategy FROM fr JOIN fs ON fr.series = fs.series), "
    "ps AS (SELECT *, CASE WHEN strategy = 'dimension-index' THEN row_number() OVER (PARTITION BY series ORDER BY -event_id, frame) - 1 WHEN strategy = 'stack' THEN row_number() OVER (PARTITION BY series ORDER BY event_id, frame) - 1 WHEN strategy = 'raw' OR up <> dn THEN frame ELSE row_number() OVER (PARTITION BY series ORDER BY v, frame) - 1 END AS position FROM ss)"
)


@query(f"WITH {CASCADE} SELECT series, frame, position, strategy FROM ps")
def order_strategy_cascade(spark, sf):
    return O.frame_order(header_frames(spark, sf)).select("series", "frame", "position", "strategy")


def _one_strategy(kind: int, name: str) -> None:
    def f(spark, sf):
        return O.frame_order(header_frames(spark, sf, kind)).select("series", "frame", "position", "strategy", F.round("spacing", 6).alias("spacing"))

    f.__name__ = name
    cascade = CASCADE.replace("user_id % 6 AS kind", f"{kind} AS kind")
    gaps = f"WITH {cascade}, gp AS (SELECT series, CASE WHEN strategy IN ('geometry', 'frame-increment-pointer', 'slice-location') THEN abs(v - lag(v) OVER (PARTITION BY series ORDER BY position)) END AS gap FROM ps), rk AS (SELECT series, gap, row_number() OVER (PARTITION BY series ORDER BY gap) - 1 AS rn, count(*) OVER (PARTITION BY series) AS n FROM gp WHERE gap > 1e-4), md AS (SELECT series, gap AS spacing FROM rk WHERE rn = n // 2) SELECT ps.series, ps.frame, ps.position, ps.strategy, round(md.spacing, 6) AS spacing FROM ps LEFT JOIN md ON ps.series = md.series"
    query(gaps)(f)


for _k, _n in enumerate(("order_dimension_index", "order_stack", "order_geometry", "order_frame_increment", "order_by_location")):
    _one_strategy(_k, _n)

@query(
    "WITH fr AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS n, user_id % 6 AS kind FROM events), "
    "e AS (SELECT series, frame, CASE WHEN n > 1 AND kind = 3 THEN 'zero_normal' WHEN n > 1 AND kind < 5 THEN 'multi_volume' END AS error FROM fr) "
    "SELECT series, frame, error, CASE WHEN error IS NULL THEN 'raw' END AS strategy FROM e"
)
def order_rejections(spark, sf):
    """Files of more than one volume (by time, stack, organisation or a varying index) and files without a normal."""
    e = events(spark, sf).withColumn("kind", F.col("series") % 6)
    only = lambda k, c: F.when(F.col("kind") == k, c)
    h = e.select(
        "series", "frame", only(0, F.col("frame") % 2).alias("temporal_position"), only(1, (F.col("frame") % 2).cast("string")).alias("stack_id"), only(2, F.lit("3D_TEMPORAL")).alias("organization"),
        only(3, F.array(F.lit(0.0), F.lit(0.0), F.col("v"))).alias("image_position"), only(3, F.array_repeat(F.lit(0.0), 6)).alias("image_orientation"),
        only(4, F.array("frame")).alias("dimension_index"), only(4, F.array(F.lit("StackID"))).alias("dimension_pointers"),
    )
    return O.frame_order(h).select("series", "frame", "error", "strategy")


ITEMS = "it AS (SELECT l_orderkey AS series, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) - 1 AS idx, l_linenumber::BIGINT AS inst, l_returnflag AS ph FROM lineitem)"


def items(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("series"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("l_linenumber").cast("long").alias("instance_number"), F.col("l_returnflag").alias("photometric"))


@query(
    f"WITH {ITEMS}, st AS (SELECT *, inst - lag(inst) OVER (PARTITION BY series ORDER BY idx) AS d, inst - lag(inst) OVER (PARTITION BY series ORDER BY inst, idx) AS g FROM it), "
    "fa AS (SELECT series, coalesce(bool_and(d > 0), true) AS up, coalesce(bool_and(d < 0), true) AS dn, coalesce(bool_or(g <= 1e-4), false) AS dup FROM st GROUP BY series) "
    "SELECT it.series, it.idx, CASE WHEN dup THEN 'duplicate_position' END AS error, CASE WHEN dup THEN NULL ELSE 'instance-number' END AS strategy, CASE WHEN dup THEN NULL WHEN up OR dn THEN it.idx ELSE row_number() OVER (PARTITION BY it.series ORDER BY inst, it.idx) - 1 END AS position FROM it JOIN fa ON it.series = fa.series"
)
def series_instance_fallback(spark, sf):
    return O.series_order(items(spark, sf).drop("photometric")).select("series", "idx", "error", "strategy", "position")


@query(
    f"WITH {ITEMS}, fi AS (SELECT series, first(ph ORDER BY idx) AS f FROM it GROUP BY series), st AS (SELECT *, inst - lag(inst) OVER (PARTITION BY series ORDER BY inst, idx) AS g FROM it) "
    "SELECT st.series, count(*) AS n, CASE WHEN bool_or(st.ph <> fi.f) THEN 'incompatible' WHEN coalesce(bool_or(g <= 1e-4), false) THEN 'duplicate_position' END AS error FROM st JOIN fi ON st.series = fi.series GROUP BY st.series"
)
def series_compat_check(spark, sf):
    return O.series_order(items(spark, sf)).groupBy("series").agg(F.count("*").alias("n"), F.max("error").alias("error"))


@query(
    f"WITH {ITEMS}, k AS (SELECT series, idx, series % 5 AS kind, count(*) OVER (PARTITION BY series) AS n FROM it), "
    "e AS (SELECT *, CASE WHEN kind = 2 AND n > 1 THEN 'mixed_sampled' WHEN kind = 3 AND n > 1 THEN 'partial_geometry' WHEN kind = 4 AND n > 2 THEN 'irregular_spacing' END AS error FROM k) "
    "SELECT series, idx, error, CASE WHEN error IS NULL THEN CASE kind WHEN 1 THEN 'raw' WHEN 2 THEN 'raw' WHEN 3 THEN 'instance-number' ELSE 'geometry' END END AS strategy, CASE WHEN error IS NULL THEN idx END AS position, "
    "CASE WHEN error IS NULL AND n > 1 THEN CASE kind WHEN 0 THEN 2.5 WHEN 4 THEN 1.0 END END::DOUBLE AS spacing FROM e"
)
def series_geometry(spark, sf):
    """Series by geometry (falling), sampled, sampled in part, with geometry in part, and of uneven gaps."""
    kind, idx = F.col("series") % 5, F.col("idx")
    z = F.when(kind == 0, -2.5 * idx).when((kind == 3) & (idx > 0), idx * 1.0).when(kind == 4, idx * idx * 1.0)
    h = items(spark, sf).select(
        "series", "idx", (idx + 1).alias("instance_number"), ((kind == 1) | ((kind == 2) & (idx == 0))).alias("sampled"), F.when(z.isNotNull(), F.array(F.lit(0.0), F.lit(0.0), z)).alias("image_position"),
        F.when(z.isNotNull(), F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0)])).alias("image_orientation"),
    )
    return O.series_order(h).select("series", "idx", "error", "strategy", "position", "spacing")


# ---------------------------------------------------------------- stacking, manifests, names


@query(
    "WITH m AS (SELECT l_orderkey AS series, l_partkey AS sop, max_by(l_linenumber, (l_suppkey::BIGINT * 1000 + l_linenumber) * 1000000 + l_extendedprice) AS inst FROM lineitem GROUP BY ALL), "
    "f AS (SELECT DISTINCT l_orderkey AS series, CASE WHEN l_partkey % 7 = 0 THEN -l_partkey ELSE l_partkey END AS sop FROM lineitem), j AS (SELECT f.series, f.sop, m.inst FROM f JOIN m ON f.series = m.series AND f.sop = m.sop) "
    "SELECT series, sop, inst::BIGINT AS inst, row_number() OVER w - 1 AS slot, first_value(sop) OVER w AS stack_name FROM j WINDOW w AS (PARTITION BY series ORDER BY inst, sop)"
)
def combine_series(spark, sf):
    li = table(spark, sf, "lineitem")
    row = (F.col("l_suppkey") * 1000 + F.col("l_linenumber")) * 1000000 + F.col("l_extendedprice")
    meta = li.select(F.col("l_orderkey").alias("series"), F.col("l_partkey").alias("sop"), F.col("l_linenumber").cast("long").alias("inst"), row.alias("row"))
    sop = F.when(F.col("l_partkey") % 7 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))  # files without metadata
    files = li.select(F.col("l_orderkey").alias("series"), sop.alias("sop")).distinct()
    return R.combine_series(files, meta, series="series", sop="sop", instance="inst", row="row", tie=["sop"]).select("series", "sop", "inst", "slot", "stack_name")


PATHS = "pa AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '/') || CASE page_id % 9 WHEN 0 THEN '.dcm' WHEN 1 THEN '.DICOM' WHEN 2 THEN '.Dcm' WHEN 3 THEN '.tiff' WHEN 4 THEN '.tif' WHEN 5 THEN '.1.2.840.dcm' WHEN 6 THEN '' WHEN 7 THEN '.TIF' ELSE '.txt' END AS path FROM pages)"


def page_paths(spark, sf):
    m = F.col("page_id") % 9
    ext = F.when(m == 0, ".dcm").when(m == 1, ".DICOM").when(m == 2, ".Dcm").when(m == 3, ".tiff").when(m == 4, ".tif").when(m == 5, ".1.2.840.dcm").when(m == 6, "").when(m == 7, ".TIF").otherwise(".txt")
    return table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", "/"), ext).alias("path"))


EXT = "regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1)"
IDS = "list_filter(string_split(path, '/'), lambda z: z <> '')"
STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')"


@query(f"WITH {PATHS}, c AS (SELECT *, {IDS} AS pt FROM pa) SELECT page_id, CASE WHEN len(pt) >= 3 THEN pt[len(pt) - 2] END AS study, CASE WHEN len(pt) >= 3 THEN pt[len(pt) - 1] END AS series, CASE WHEN len(pt) >= 3 THEN {STEM} END AS sop FROM c")
def path_components(spark, sf):
    return page_paths(spark, sf).select("page_id", paths.path_ids(F.col("path")).alias("i")).select("page_id", F.col("i.study_instance_uid").alias("study"), F.col("i.series_instance_uid").alias("series"), F.col("i.sop_instance_uid").alias("sop"))


@query(f"WITH {PATHS}, e AS (SELECT page_id, {EXT} AS x FROM pa) SELECT page_id, x IN ('dcm', 'dicom', 'DCM', 'DICOM') AS is_dicom, x IN ('tiff', 'tif', 'TIFF', 'TIF') AS is_tiff FROM e")
def extension_filter(spark, sf):
    p = F.col("path")
    return page_paths(spark, sf).select("page_id", paths.is_dicom(p).alias("is_dicom"), paths.is_tiff(p).alias("is_tiff"))


@query("SELECT o_orderkey AS k, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'out/' || o_custkey || '/' || CASE WHEN o_orderstatus = 'P' THEN 'series' ELSE o_orderpriority END || '/' || o_orderkey || '.tiff' END AS path FROM orders")
def output_path(spark, sf):
    o = table(spark, sf, "orders")
    study = F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey").cast("string"))
    series = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("k"), paths.output_path(F.lit("out"), study, series, F.col("o_orderkey").cast("string")).alias("path"))


@query(f"WITH {PATHS}, c AS (SELECT *, {IDS} AS pt FROM pa) SELECT pt[len(pt) - 2] AS study_instance_uid, pt[len(pt) - 1] AS series_instance_uid, {STEM} AS sop_instance_uid, path, page_id AS inode, (CASE WHEN page_id % 4 = 0 THEN 0 ELSE page_id % 100 END)::BIGINT AS width, 0::BIGINT AS height, 1::BIGINT AS channels, 1::BIGINT AS num_frames FROM c WHERE len(pt) >= 3")
def manifest(spark, sf):
    f = page_paths(spark, sf).withColumns({"inode": F.col("page_id"), "width": F.when(F.col("page_id") % 4 != 0, F.col("page_id") % 100), "height": F.lit(None).cast("long"), "channels": F.lit(1), "num_frames": F.lit(1)})
    return R.manifest(f)


# ---------------------------------------------------------------- headers

HEADERS = (
    "h AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE 64 + o_custkey % 100 END AS r, CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE (CASE o_orderkey % 5 WHEN 0 THEN 8 WHEN 4 THEN 32 ELSE 16 END) END AS ba, "
    "(CASE WHEN o_orderkey % 5 = 0 THEN 8 ELSE 12 + o_custkey % 7 END) AS bs, (CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE 11 + o_custkey % 7 END) AS hb, CASE o_orderstatus WHEN 'F' THEN 'MONOCHROME2' WHEN 'O' THEN 'RGB' ELSE 'PALETTE COLOR' END AS ph, o_custkey % 3 AS pr, o_custkey % 29 - 1 AS nf, o_custkey % 19 AS px FROM orders)"
)


def headers(spark, sf):
    o = table(spark, sf, "orders")
    c, k, st = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus")
    s = lambda x: x.cast("string")
    return o.select(
        k.alias("k"), s(F.when(c % 13 != 0, 64 + c % 100)).alias("Rows"), F.lit("128").alias("Columns"), F.lit("1").alias("SamplesPerPixel"),
        F.when(st == "F", "MONOCHROME2").when(st == "O", "RGB").otherwise("PALETTE COLOR").alias("PhotometricInterpretation"),
        s(F.when(c % 17 != 0, F.when(k % 5 == 0, 8).when(k % 5 == 4, 32).otherwise(16))).alias("BitsAllocated"), s(F.when(k % 5 == 0, F.lit(8).cast("long")).otherwise(12 + c % 7)).alias("BitsStored"),
        s(F.when(k % 5 == 0, F.lit(7).cast("long")).otherwise(11 + c % 7)).alias("HighBit"), s(c % 3).alias("PixelRepresentation"), s(c % 29 - 1).alias("NumberOfFrames"), F.when(c % 19 != 0, c % 19 - 1).alias("PixelDataLength"),
    )


COLOR = "CASE WHEN ba = 16 AND ph LIKE 'MONO%' THEN 'gray16' WHEN ba = 8 AND ph LIKE 'MONO%' THEN 'gray8' WHEN ba = 8 AND ph = 'RGB' THEN 'rgb8' END"


@query(f"WITH {HEADERS} SELECT k, {COLOR} AS color, CASE WHEN {COLOR} LIKE 'gray%' THEN 1 WHEN {COLOR} = 'rgb8' THEN 3 END AS channels, CASE WHEN ba IN (8, 16) THEN (CASE WHEN pr = 1 THEN 'int' ELSE 'uint' END) || ba END AS dtype FROM h")
def color_type_map(spark, sf):
    h = headers(spark, sf)
    color = dtype.color_type(F.col("BitsAllocated").cast("int"), F.col("PhotometricInterpretation"))
    return h.select("k", color.alias("color"), dtype.channels(color).alias("channels"), dtype.dtype_name(F.col("BitsAllocated").cast("int"), F.col("PixelRepresentation").cast("int")).alias("dtype"))


ERRORS = (
    "e AS (SELECT k, (r IS NULL)::BIGINT AS e_rows, (ba IS NULL)::BIGINT AS e_alloc, (pr > 1)::BIGINT AS e_pr, (ba IS NOT NULL AND ba NOT IN (8, 16))::BIGINT AS e_ba, (ba IS NOT NULL AND NOT (bs BETWEEN 1 AND ba))::BIGINT AS e_bs, "
    f"(ba IS NOT NULL AND NOT (hb = bs - 1 AND hb < ba))::BIGINT AS e_hb, (({COLOR}) IS NULL)::BIGINT AS e_color, (nf <= 0)::BIGINT AS e_nf, (px <= 1)::BIGINT AS e_px FROM h)"
)


@query(f"WITH {HEADERS}, {ERRORS} SELECT k, e_ba = 1 AS bad_allocated, e_bs = 1 AS bad_stored, e_hb = 1 AS bad_high_bit FROM e")
def validate_bits(spark, sf):
    v = D.validate(headers(spark, sf))
    has = lambda code: F.exists("findings", lambda f: f["code"] == code)
    return v.select("k", has("unsupported_bits_allocated").alias("bad_allocated"), has("invalid_bits_stored").alias("bad_stored"), has("invalid_high_bit").alias("bad_high_bit"))


@query(f"WITH {HEADERS}, {ERRORS}, t AS (SELECT k, e_rows + e_alloc + e_pr + e_ba + e_bs + e_hb + e_color + e_nf + e_px AS n_errors FROM e) SELECT k, n_errors, 6::BIGINT AS n_warnings, n_errors = 0 AS valid FROM t")
def validate_report_counts(spark, sf):
    return D.validate(headers(spark, sf)).select("k", "n_errors", "n_warnings", "valid")


OPTIONAL = ("PhotometricInterpretation", "PlanarConfiguration", "RescaleSlope", "RescaleIntercept", "WindowCenter", "WindowWidth", "VOILUTFunction", "VOILUTSequence", "Pixel spacing", "Directory output naming")
_there = lambda c: f"CASE WHEN {c} THEN 'optional_tag_present' ELSE 'optional_tag_absent' END"


@query(
    "SELECT o_orderkey AS k, concat_ws(',', CASE o_custkey % 5 WHEN 0 THEN 'missing_photometric_interpretation' WHEN 1 THEN 'empty_required_tag' ELSE 'present' END, "
    "CASE o_custkey % 7 WHEN 0 THEN 'default_planar_configuration' WHEN 2 THEN 'invalid_planar_configuration' ELSE 'present' END, "
    + ", ".join(map(_there, ("o_custkey % 2 = 0", "o_custkey % 3 = 0", "o_custkey % 4 = 0", "o_custkey % 4 = 0 AND o_custkey % 8 <> 0")))
    + ", CASE o_orderkey % 3 WHEN 0 THEN 'voi_lut_function_absent' WHEN 1 THEN 'empty_voi_lut_function' ELSE 'voi_lut_function_present' END, CASE WHEN o_orderkey % 4 = 0 THEN 'voi_lut_sequence_present' ELSE 'voi_lut_sequence_absent' END, "
    "CASE WHEN o_custkey % 6 = 0 THEN 'resolution_unavailable' ELSE 'resolution_available' END, CASE WHEN o_orderkey % 5 = 0 THEN 'directory_output_not_ready' ELSE 'directory_output_ready' END) AS codes FROM orders"
)
def validate_optional(spark, sf):
    """Findings about photometric text, planar configuration, optional attributes, resolution and naming."""
    o = table(spark, sf, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    h = o.select(
        k.alias("k"), F.when(c % 5 == 1, " ").when(c % 5 > 1, "MONOCHROME2").alias("PhotometricInterpretation"), F.when(c % 7 == 2, "2").when(c % 7 == 1, "1").when(c % 7 > 2, "0").alias("PlanarConfiguration"),
        F.when(c % 2 == 0, "1").alias("RescaleSlope"), F.when(c % 3 == 0, "0").alias("RescaleIntercept"), F.when(c % 4 == 0, "40").alias("WindowCenter"), F.when(c % 8 == 0, " ").when(c % 4 == 0, "80").alias("WindowWidth"),
        F.when(k % 3 == 1, "").when(k % 3 == 2, "LINEAR").alias("VOILUTFunction"), F.when(k % 4 == 0, 1).alias("VOILUTSequenceItems"), F.when(c % 6 != 0, F.array(F.lit(0.5), F.lit(0.25))).alias("PixelSpacing"),
        F.when(k % 5 != 0, "1.2").alias("StudyInstanceUID"), F.lit("1.2.3").alias("SOPInstanceUID"),
    )
    codes = F.transform(F.filter("findings", lambda f: f["name"].isin(*OPTIONAL)), lambda f: f["code"])
    return D.validate(h).select("k", F.array_join(codes, ",").alias("codes"))


@query(
    "WITH s AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_partkey AS p, l_suppkey AS sk, CASE l_suppkey % 3 WHEN 0 THEN NULL ELSE CAST(l_discount + 0.5 AS FLOAT) END AS rs, CAST(l_tax + 0.25 AS FLOAT) AS cs, "
    "coalesce(CASE l_partkey % 4 WHEN 0 THEN l_quantity END, CASE l_partkey % 5 WHEN 0 THEN l_quantity * 2 END) AS z FROM lineitem) "
    "SELECT k, n, p, sk, round(CAST(1::FLOAT / cs AS FLOAT)::DOUBLE, 5) AS ppmm_x, round(CAST(1::FLOAT / coalesce(rs, 0.75::FLOAT) AS FLOAT)::DOUBLE, 5) AS ppmm_y, round(CAST(1::FLOAT / z::FLOAT AS FLOAT)::DOUBLE, 5) AS fpmm FROM s"
)
def resolution_fallback(spark, sf):
    li = table(spark, sf, "lineitem")
    col = (F.col("l_tax") + 0.25).cast("float").cast("double")
    own = F.when(F.col("l_suppkey") % 3 != 0, F.array((F.col("l_discount") + 0.5).cast("float").cast("double"), col))
    spacing = F.coalesce(own, F.array(F.lit(0.75), col))
    r = geometry.resolution(spacing, F.when(F.col("l_partkey") % 4 == 0, F.col("l_quantity")), F.when(F.col("l_partkey") % 5 == 0, F.col("l_quantity") * 2))
    out = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("sk"), r.alias("r"))
    return out.select("k", "n", "p", "sk", *[F.round(F.col(f"r.{c}").cast("double"), 5).alias(a) for c, a in (("ppmm_x", "ppmm_x"), ("ppmm_y", "ppmm_y"), ("frames_per_mm", "fpmm"))])


@query("WITH s AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_partkey AS p, l_suppkey AS s, CAST(l_discount * 7 + 0.3 AS FLOAT) AS v, 1 + l_suppkey % 3 AS u FROM lineitem) SELECT k, n, p, s, floor(CAST(v * 10::FLOAT AS FLOAT)::DOUBLE)::BIGINT AS per_cm, round(CASE u WHEN 3 THEN CAST(v / 10::FLOAT AS FLOAT) WHEN 2 THEN CAST(v / 25.4::FLOAT AS FLOAT) ELSE v END::DOUBLE, 6) AS back FROM s")
def resolution_tiff(spark, sf):
    v = (F.col("l_discount") * 7 + 0.3).cast("float")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), geometry.tiff_resolution(v).alias("per_cm"),
        F.round(geometry.from_tiff_resolution(v, 1 + F.col("l_suppkey") % 3).cast("double"), 6).alias("back"),
    )


@query(
    "WITH s AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_partkey AS p, l_suppkey AS s, CAST(l_discount * 7 + 0.3 AS FLOAT) AS x, CAST(l_tax * 5 + 0.2 AS FLOAT) AS y, CAST(l_quantity AS FLOAT) AS z, CAST(0.5 + l_linenumber AS FLOAT) AS f FROM lineitem) "
    "SELECT k, n, p, s, round(CAST(x * f AS FLOAT)::DOUBLE, 4) AS sx, round(CAST(y * 2::FLOAT AS FLOAT)::DOUBLE, 4) AS sy, round(CAST(z * 0.5::FLOAT AS FLOAT)::DOUBLE, 4) AS sz, "
    "round(CAST(x * CAST(1::FLOAT / f AS FLOAT) AS FLOAT)::DOUBLE, 4) AS ux, round(CAST(y * CAST(1::FLOAT / 3::FLOAT AS FLOAT) AS FLOAT)::DOUBLE, 4) AS uy, round(z::DOUBLE, 4) AS uz FROM s"
)
def resolution_resize(spark, sf):
    """A resolution scaled in three directions, and one taken back through a resize."""
    f = lambda c: c.cast("float")
    r = F.struct(f(F.col("l_discount") * 7 + 0.3).alias("ppmm_x"), f(F.col("l_tax") * 5 + 0.2).alias("ppmm_y"), f(F.lit(1.0)).alias("frames_per_mm"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), geometry.with_frames_per_mm(r, F.col("l_quantity")).alias("r"), (F.col("l_linenumber") + 0.5).alias("f"))
    up = geometry.scale_resolution(F.col("r"), F.col("f"), F.lit(2.0), F.lit(0.5))
    back = geometry.unscale_resolution(F.col("r"), F.col("f"), F.lit(3.0))
    rounded = lambda c, a: F.round(c.cast("double"), 4).alias(a)
    names = ("ppmm_x", "ppmm_y", "frames_per_mm")
    return li.select("k", "n", "p", "s", *[rounded(up[c], f"s{a}") for c, a in zip(names, "xyz")], *[rounded(back[c], f"u{a}") for c, a in zip(names, "xyz")])


@query(
    "WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), d AS (SELECT user_id, n, CAST((1 + user_id % 5) / 4.0 AS FLOAT) AS z, 1 + user_id % 60 AS t FROM e) "
    "SELECT user_id, n, t AS target, round((CASE WHEN n > 1 AND t > 1 AND n <> t THEN CAST(CAST(z * (t - 1)::FLOAT AS FLOAT) / (n - 1)::FLOAT AS FLOAT) ELSE z END)::DOUBLE, 5) AS frames_per_mm FROM d"
)
def resolution_resampled(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    t = (F.col("user_id") % 60 + 1).alias("target")
    z = geometry.resampled_z(((F.col("user_id") % 5 + 1) / 4.0).cast("float"), F.col("n"), F.col("user_id") % 60 + 1)
    return e.select("user_id", "n", t, F.round(z.cast("double"), 5).alias("frames_per_mm"))


@query(
    f"WITH {HEADERS}, c AS (SELECT k, CASE WHEN nf = 5 THEN ' ' WHEN nf = 6 THEN 'abc' WHEN nf = 7 THEN '70000' WHEN nf <> 8 THEN nf::VARCHAR END AS t, r, CASE WHEN ba = 8 THEN 1 ELSE 2 END AS b, CASE WHEN ph = 'RGB' THEN 3 ELSE 1 END AS ch FROM h), "
    "e AS (SELECT *, CASE WHEN trim(t) <> '' AND (try_cast(t AS BIGINT) IS NULL OR try_cast(t AS BIGINT) < 0) THEN 'INVALID_NUMBER_OF_FRAMES' WHEN try_cast(t AS BIGINT) > 65535 THEN 'TOO_MANY_FRAMES' END AS error FROM c), "
    "f AS (SELECT *, CASE WHEN error IS NULL THEN coalesce(try_cast(t AS BIGINT), 1) END AS n FROM e) SELECT k, error, n, n * ch * r * 128 AS numel, n * ch * r * 128 * b AS n_bytes FROM f"
)
def volume_dimensions(spark, sf):
    """Frame counts with what may be wrong with them, and the size of the volumes."""
    nf = F.col("NumberOfFrames")
    text = F.when(nf == "5", " ").when(nf == "6", "abc").when(nf == "7", "70000").when(nf != "8", nf)
    channels = F.when(F.col("PhotometricInterpretation") == "RGB", 3).otherwise(1)
    size = F.when(F.col("BitsAllocated") == "8", 1).otherwise(2)
    h = headers(spark, sf).withColumn("f", codes.frame_count(text))
    d = geometry.dimensions(F.col("f.n"), channels, F.col("Rows"), F.col("Columns"), size)
    return h.select("k", F.col("f.error").alias("error"), F.col("f.n").alias("n"), d["numel"].alias("numel"), d["n_bytes"].alias("n_bytes"))
