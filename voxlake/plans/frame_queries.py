"""Queries over single frames: sample types, crop, resize, pad, flip."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxlake.functions import dtype, geometry
from voxlake.kernels.resample import weights
from voxlake.operators import pixels as P

from .views import PX, SIDE, frames, pixels, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEYS = ["series", "sop"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(PX + " SELECT series, sop, x, y, px FROM px")
def pixels_u16(spark, sf):
    return pixels(spark, sf)


@query(PX + " SELECT sop, x, y, ((px * 255 + 32767) // 65535)::BIGINT AS v FROM px")
def dtype_u16_to_u8(spark, sf):
    return pixels(spark, sf).select("sop", "x", "y", dtype.u16_to_u8(F.col("px")).alias("v"))


@query(PX + " SELECT sop, x, y, (((px * 255 + 32767) // 65535) * 257)::BIGINT AS v FROM px")
def dtype_u8_to_u16(spark, sf):
    return pixels(spark, sf).select("sop", "x", "y", dtype.u8_to_u16(dtype.u16_to_u8(F.col("px"))).alias("v"))


@query(PX + " SELECT sop, x, y, round(CAST(px::FLOAT / 65535::FLOAT AS FLOAT)::DOUBLE, 6) AS v FROM px")
def dtype_to_f32(spark, sf):
    return pixels(spark, sf).select("sop", "x", "y", F.round(dtype.to_unit(F.col("px"), "u16").cast("double"), 6).alias("v"))


@query(PX + " SELECT sop, x, y, px <> 0 AS fg FROM px")
def foreground_mask(spark, sf):
    return pixels(spark, sf).select("sop", "x", "y", dtype.foreground(F.col("px")).alias("fg"))


SAT = PX + ", sat AS (SELECT series, sop, x, y, CASE WHEN px > 16000 THEN 65535 ELSE px END AS px FROM px)"


def saturated_frames(spark, sf):
    """Bright samples become saturated ones, so that excluding the maximum matters."""
    return frames(spark, sf).withColumn("data", F.transform("data", lambda v: F.when(v > 16000, F.lit(65535).cast("long")).otherwise(v)))


def saturated(spark, sf):
    """Bright samples become saturated ones, so that excluding the maximum matters."""
    return pixels(spark, sf).withColumn("px", F.when(F.col("px") > 16000, F.lit(65535).cast("long")).otherwise(F.col("px")))


@query(SAT + " SELECT sop, x, y, px <> 0 AND px <> 65535 AS fg FROM sat")
def foreground_mask_check_max(spark, sf):
    return saturated(spark, sf).select("sop", "x", "y", dtype.foreground(F.col("px"), check_max=True).alias("fg"))


def _box_sql(source: str, fg: str, x0=0, x1=8, g=0, head=PX) -> str:
    inside = f"x >= {x0} AND x < {x1} AND y >= {x0} AND y < {x1}"
    return (
        f"{head}, b AS (SELECT series, sop, greatest(0, coalesce(min(x) FILTER (WHERE {fg} AND {inside}), 0) - {g}) AS l, least(7, coalesce(max(x) FILTER (WHERE {fg} AND {inside}), 7) + {g}) AS r, "
        f"greatest(0, coalesce(min(y) FILTER (WHERE {fg} AND {inside}), 0) - {g}) AS t, least(7, coalesce(max(y) FILTER (WHERE {fg} AND {inside}), 7) + {g}) AS b FROM {source} GROUP BY ALL), "
        "box AS (SELECT series, sop, l::BIGINT AS \"left\", t::BIGINT AS top, (r - l + 1)::BIGINT AS width, (b - t + 1)::BIGINT AS height FROM b)"
    )


ROW = ' SELECT series, sop, "left", top, width, height FROM box'


@query(_box_sql("px", "px <> 0") + ROW)
def crop_bbox(spark, sf):
    return P.crop_boxes(frames(spark, sf), KEYS, SIDE, SIDE)


@query(_box_sql("px", "px <> 0", 1, 6, 1) + ROW)
def crop_bbox_border(spark, sf):
    return P.crop_boxes(frames(spark, sf), KEYS, SIDE, SIDE, border=0.2)


@query(_box_sql("sat", "px <> 0 AND px <> 65535", head=SAT) + ROW)
def crop_check_max(spark, sf):
    return P.crop_boxes(saturated_frames(spark, sf), KEYS, SIDE, SIDE, check_max=True)


#: Sparse frames: only the brightest samples are foreground, so boxes are small and empty frames occur.
DIM = PX + ", dim AS (SELECT series, sop, x, y, CASE WHEN px > 15500 THEN px ELSE 0 END AS px FROM px)"


def dim_frames(spark, sf):
    return frames(spark, sf).withColumn("data", F.transform("data", lambda v: F.when(v > 15500, v).otherwise(F.lit(0).cast("long"))))


@query(_box_sql("dim", "px <> 0", head=DIM) + ', u AS (SELECT series, min("left") AS l, min(top) AS t, max("left" + width) AS r, max(top + height) AS b FROM box GROUP BY series) SELECT series, l AS "left", t AS top, (r - l)::BIGINT AS width, (b - t)::BIGINT AS height FROM u')
def crop_series_union(spark, sf):
    return P.union_boxes(P.crop_boxes(dim_frames(spark, sf), KEYS, SIDE, SIDE), ["series"])


@query(
    _box_sql("dim", "px <> 0", head=DIM)
    + ', c AS (SELECT series, sop, "left" AS l, top AS t, "left" + width AS r, top + height AS b, row_number() OVER (PARTITION BY series ORDER BY sop) AS i FROM box), p AS (SELECT a.series, a.sop, greatest(a.l, z.l) AS l, greatest(a.t, z.t) AS t, least(a.r, z.r) AS r, least(a.b, z.b) AS b '
    "FROM c a JOIN c z ON a.series = z.series AND z.i = a.i + 1) SELECT series, sop, l AS \"left\", t AS top, greatest(0, r - l)::BIGINT AS width, greatest(0, b - t)::BIGINT AS height FROM p"
)
def crop_intersection(spark, sf):
    """Each frame's box with the box of the next frame of its series."""
    boxes, cols = P.crop_boxes(dim_frames(spark, sf), KEYS, SIDE, SIDE), ("left", "top", "width", "height")
    following = Window.partitionBy("series").orderBy("sop")
    j = boxes.withColumn("o", F.lead(F.struct(*cols)).over(following)).where("o is not null")
    out = geometry.box_intersection(tuple(F.col(c) for c in cols), tuple(F.col("o")[c] for c in cols))
    return j.select("series", "sop", *[c.cast("long").alias(n) for c, n in zip(out, cols)])


@query(_box_sql("dim", "px <> 0", head=DIM) + ' SELECT p.series, p.sop, p.x - b."left" AS x, p.y - b.top AS y, p.px FROM px p JOIN box b ON p.sop = b.sop AND p.series = b.series WHERE p.x >= b."left" AND p.x < b."left" + b.width AND p.y >= b.top AND p.y < b.top + b.height')
def crop_apply(spark, sf):
    boxes = P.crop_boxes(dim_frames(spark, sf), KEYS, SIDE, SIDE)
    j = frames(spark, sf).join(boxes, KEYS)
    cut = j.withColumn("cut", P.crop_frame(F.col("data"), F.lit(SIDE), F.col("left"), F.col("top"), F.col("width"), F.col("height")))
    return P.explode_frames(cut, KEYS, F.col("width"), "cut")


COMPONENT_SQL = (
    "WITH RECURSIVE px AS (SELECT label::BIGINT AS series, vec_id AS sop, ((i-1) % 8)::BIGINT AS x, ((i-1) // 8)::BIGINT AS y, CASE WHEN embedding[i]::DOUBLE > 0.1 THEN floor(embedding[i]::DOUBLE * 65535)::BIGINT ELSE 0::BIGINT END AS px "
    "FROM embeddings, (SELECT unnest(range(1, 65)) AS i) r), "
    "bb AS (SELECT sop, coalesce(min(x) FILTER (WHERE px <> 0), 0) AS l, coalesce(max(x) FILTER (WHERE px <> 0), 7) AS r, coalesce(min(y) FILTER (WHERE px <> 0), 0) AS t, coalesce(max(y) FILTER (WHERE px <> 0), 7) AS b FROM px GROUP BY sop), "
    "fg AS (SELECT p.series, p.sop, p.x, p.y FROM px p WHERE (px * 255 + 32767) // 65535 > 1), "
    "reach AS (SELECT sop, y * 8 + x AS a, y * 8 + x AS z FROM fg UNION SELECT r.sop, r.a, g.y * 8 + g.x FROM reach r JOIN fg g ON g.sop = r.sop AND abs(g.x - r.z % 8) + abs(g.y - r.z // 8) = 1), "
    "lab AS (SELECT sop, a, min(z) AS label FROM reach GROUP BY sop, a), "
    "comp AS (SELECT sop, label, count(*) AS n, min(a % 8) AS l, max(a % 8) AS r, min(a // 8) AS t, max(a // 8) AS b FROM lab GROUP BY sop, label), "
    "best AS (SELECT sop, l, r, t, b, row_number() OVER (PARTITION BY sop ORDER BY n DESC, label DESC) AS k FROM comp), "
    "s AS (SELECT DISTINCT series, sop FROM px) "
    'SELECT s.series, s.sop, coalesce(c.l, bb.l)::BIGINT AS "left", coalesce(c.t, bb.t)::BIGINT AS top, (coalesce(c.r, bb.r) - coalesce(c.l, bb.l) + 1)::BIGINT AS width, (coalesce(c.b, bb.b) - coalesce(c.t, bb.t) + 1)::BIGINT AS height '
    "FROM s JOIN bb ON s.sop = bb.sop LEFT JOIN best c ON c.sop = s.sop AND c.k = 1"
)


@query(COMPONENT_SQL)
def crop_components(spark, sf):
    from voxlake.operators.images import component_boxes

    return component_boxes(frames(spark, sf), KEYS, SIDE, SIDE)


SIZES = "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_partkey AS p, l_suppkey AS s, (l_quantity * 10)::BIGINT AS w, (l_linenumber * 64 + l_suppkey % 50)::BIGINT AS h FROM lineitem"


def sizes(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), (F.col("l_quantity") * 10).cast("long").alias("w"), (F.col("l_linenumber") * 64 + F.col("l_suppkey") % 50).cast("long").alias("h")
    )


@query(f"WITH d AS ({SIZES}), c AS (SELECT *, least(CAST(96::FLOAT / w::FLOAT AS FLOAT), CAST(128::FLOAT / h::FLOAT AS FLOAT)) AS sc FROM d) SELECT k, n, p, s, floor(CAST(w::FLOAT * sc AS FLOAT)::DOUBLE + 0.5)::BIGINT AS out_w, floor(CAST(h::FLOAT * sc AS FLOAT)::DOUBLE + 0.5)::BIGINT AS out_h FROM c")
def resize_fit_dims(spark, sf):
    sc = geometry.fit_scale(F.col("w"), F.col("h"), 96, 128)
    return sizes(spark, sf).withColumn("sc", sc).select("k", "n", "p", "s", geometry.scaled_side(F.col("w"), F.col("sc")).alias("out_w"), geometry.scaled_side(F.col("h"), F.col("sc")).alias("out_h"))


@query(f"WITH d AS ({SIZES}), c AS (SELECT *, CAST(97::FLOAT / w::FLOAT AS FLOAT) AS sx, CAST(131::FLOAT / h::FLOAT AS FLOAT) AS sy FROM d) SELECT k, n, p, s, floor(CAST(w::FLOAT * sx AS FLOAT)::DOUBLE + 0.5)::BIGINT AS out_w, floor(CAST(h::FLOAT * sy AS FLOAT)::DOUBLE + 0.5)::BIGINT AS out_h FROM c")
def resize_exact_dims(spark, sf):
    d = sizes(spark, sf)
    return d.select("k", "n", "p", "s", geometry.scaled_side(F.col("w"), geometry.exact_scale(F.col("w"), 97)).alias("out_w"), geometry.scaled_side(F.col("h"), geometry.exact_scale(F.col("h"), 131)).alias("out_h"))


@query(f"WITH d AS ({SIZES}), c AS (SELECT *, CAST(CAST(1::FLOAT / 2.5::FLOAT AS FLOAT) / CAST((1 + s % 7) / 4.0 AS FLOAT) AS FLOAT) AS sc FROM d) SELECT k, n, p, s, floor(CAST(w::FLOAT * sc AS FLOAT)::DOUBLE + 0.5)::BIGINT AS out_w FROM c")
def resize_pixel_spacing(spark, sf):
    ppmm = ((F.col("s") % 7 + 1) / 4.0).cast("float")
    return sizes(spark, sf).select("k", "n", "p", "s", geometry.spacing_target(F.col("w"), ppmm, 2.5).alias("out_w"))


@query(PX + ", g AS (SELECT (unnest(range(0, 3)))::BIGINT AS o) SELECT p.series, p.sop, gx.o AS x, gy.o AS y, p.px FROM px p JOIN g gx ON p.x = least(((2 * gx.o + 1) * 8) // 6, 7) JOIN g gy ON p.y = least(((2 * gy.o + 1) * 8) // 6, 7)")
def resize_nearest(spark, sf):
    f = frames(spark, sf).select(*KEYS, P.nearest_frame(F.col("data"), F.lit(SIDE), F.lit(SIDE), 3, 3).alias("data"))
    return P.explode_frames(f, KEYS, 3)


@query(PX + ", g AS (SELECT o, least(o * 8 // 3, 7) AS a, greatest(least(o * 8 // 3, 7) + 1, least((o + 1) * 8 // 3, 8)) AS z FROM (SELECT unnest(range(0, 3))::BIGINT AS o)) SELECT p.series, p.sop, gx.o AS x, gy.o AS y, max(p.px) AS px FROM px p JOIN g gx ON p.x >= gx.a AND p.x < gx.z JOIN g gy ON p.y >= gy.a AND p.y < gy.z GROUP BY ALL")
def resize_maxpool(spark, sf):
    f = frames(spark, sf).select(*KEYS, P.maxpool_frame(F.col("data"), SIDE, SIDE, 3, 3).alias("data"))
    return P.explode_frames(f, KEYS, 3)


def _filter_query(kind: str, name: str) -> None:
    w = weights(SIDE, 5, kind)
    rows = ", ".join(f"({i}::BIGINT, {j}::BIGINT, {w[i, j]!r}::DOUBLE)".replace("np.float64(", "").replace(")::DOUBLE", "::DOUBLE") for i in range(5) for j in range(SIDE) if w[i, j])
    sql = PX + f", w(o, j, v) AS (VALUES {rows}) SELECT p.series, p.sop, wx.o AS x, wy.o AS y, greatest(0, least(65535, floor(round(sum(wx.v * wy.v * p.px), 6) + 0.5)))::BIGINT AS px FROM px p JOIN w wx ON p.x = wx.j JOIN w wy ON p.y = wy.j GROUP BY ALL"

    def f(spark, sf):
        out = P.separable_frames(frames(spark, sf), KEYS, w, w).withColumn("data", P.as_samples(F.col("data")))
        return P.explode_frames(out, KEYS, 5)

    f.__name__ = name
    query(sql)(f)


for _kind in ("triangle", "catmull-rom", "gaussian", "lanczos3"):
    _filter_query(_kind, f"resize_{_kind.replace('-', '_')}")


def _pad_query(direction: str, name: str, left: str, top: str) -> None:
    sql = f"WITH d AS ({SIZES}), q AS (SELECT *, greatest(0, 480 - w) AS px, greatest(0, 500 - h) AS py FROM d) SELECT k, n, p, s, ({left})::BIGINT AS pad_left, ({top})::BIGINT AS pad_top, (px - ({left}))::BIGINT AS pad_right, (py - ({top}))::BIGINT AS pad_bottom FROM q"

    def f(spark, sf):
        d = sizes(spark, sf)
        return d.select("k", "n", "p", "s", *[c.alias(f"pad_{x}") for c, x in zip(geometry.padding(F.col("w"), F.col("h"), 480, 500, direction), ("left", "top", "right", "bottom"))])

    f.__name__ = name
    query(sql)(f)


_pad_query("center", "pad_center", "px // 2", "py // 2")
_pad_query("top-left", "pad_top_left", "px", "py")
_pad_query("bottom-right", "pad_bottom_right", "0", "0")

PAD_ZERO = PX + (
    ", e AS (SELECT series, sop, count(*) FILTER (WHERE px = 0 AND x = 0) AS zl, count(*) FILTER (WHERE px = 0 AND y = 0) AS zt, count(*) FILTER (WHERE px = 0 AND x = 7) AS zr, count(*) FILTER (WHERE px = 0 AND y = 7) AS zb FROM px GROUP BY ALL), "
    "pad AS (SELECT series, sop, (CASE WHEN zl < zr THEN 0 ELSE 3 END)::BIGINT AS pad_left, (CASE WHEN zt < zb THEN 0 ELSE 4 END)::BIGINT AS pad_top FROM e)"
)


@query(PAD_ZERO + " SELECT series, sop, pad_left, pad_top, 3 - pad_left AS pad_right, 4 - pad_top AS pad_bottom FROM pad")
def pad_zero(spark, sf):
    return P.zero_padding(frames(spark, sf), KEYS, SIDE, SIDE, 11, 12)


@query(PAD_ZERO + ", g AS (SELECT gx.o AS x, gy.o AS y FROM (SELECT unnest(range(0, 11))::BIGINT AS o) gx, (SELECT unnest(range(0, 12))::BIGINT AS o) gy) SELECT a.series, a.sop, g.x, g.y, coalesce(p.px, 0)::BIGINT AS px FROM pad a CROSS JOIN g LEFT JOIN px p ON p.series = a.series AND p.sop = a.sop AND p.x = g.x - a.pad_left AND p.y = g.y - a.pad_top")
def pad_apply(spark, sf):
    pads = P.zero_padding(frames(spark, sf), KEYS, SIDE, SIDE, 11, 12)
    j = frames(spark, sf).join(pads, KEYS)
    out = j.withColumn("data", P.pad_frame(F.col("data"), F.lit(SIDE), F.lit(SIDE), F.col("pad_left"), F.col("pad_top"), F.col("pad_right"), F.col("pad_bottom")))
    return P.explode_frames(out, KEYS, 11)


def _flip_query(h: bool, v: bool, name: str) -> None:
    def f(spark, sf):
        out = frames(spark, sf).select(*KEYS, P.flip_frame(F.col("data"), F.lit(SIDE), F.lit(SIDE), h, v).alias("data"))
        return P.explode_frames(out, KEYS, SIDE)

    f.__name__ = name
    query(PX + f" SELECT series, sop, {'7 - x' if h else 'x'} AS x, {'7 - y' if v else 'y'} AS y, px FROM px")(f)


_flip_query(True, False, "flip_h")
_flip_query(False, True, "flip_v")
_flip_query(True, True, "flip_both")

PREPARE_SQL = (
    _box_sql("dim", "px <> 0", head=DIM)
    + ', u AS (SELECT series, min("left") AS l, min(top) AS t, max("left" + width) AS r, max(top + height) AS b FROM box GROUP BY series), '
    "c AS (SELECT p.series, p.sop, p.x - u.l AS x, p.y - u.t AS y, p.px, u.r - u.l AS w, u.b - u.t AS h FROM px p JOIN u ON p.series = u.series WHERE p.x >= u.l AND p.x < u.r AND p.y >= u.t AND p.y < u.b), "
    "g AS (SELECT unnest(range(0, 4))::BIGINT AS o), "
    "n AS (SELECT c.series, c.sop, gx.o AS x, gy.o AS y, c.px FROM c JOIN g gx ON c.x = least(((2 * gx.o + 1) * c.w) // 8, c.w - 1) JOIN g gy ON c.y = least(((2 * gy.o + 1) * c.h) // 8, c.h - 1)) "
    'SELECT n.series, n.sop, n.x + 1 AS x, n.y + 1 AS y, n.px, u.l AS crop_left, u.t AS crop_top, u.r - u.l AS crop_width, u.b - u.t AS crop_height FROM n JOIN u ON n.series = u.series WHERE n.px <> 0'
)


@query(PREPARE_SQL)
def prepare_end_to_end(spark, sf):
    """Common crop of each series, nearest resize to 4x4, centre padding to 6x6, with the crop as metadata; nonzero samples."""
    box = P.union_boxes(P.crop_boxes(dim_frames(spark, sf), KEYS, SIDE, SIDE), ["series"])
    j = frames(spark, sf).join(box, "series")
    w, h, one = F.col("width"), F.col("height"), F.lit(1)
    index = P.prepared_index(SIDE, (F.col("left"), F.col("top"), w, h), (4, 4), (one, one))
    j = j.withColumn("padded", P.gather(F.col("data"), F.lit(6), F.lit(6), index))
    meta = [F.col(c).alias(f"crop_{c}") for c in ("left", "top", "width", "height")]
    j = j.select("series", "sop", *meta, "padded")
    return P.explode_frames(j, ["series", "sop", "crop_left", "crop_top", "crop_width", "crop_height"], 6, "padded").where("px <> 0")
