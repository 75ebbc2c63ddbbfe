"""Queries over volumes: handlers, resampling, pyramid parts, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.config import Handler
from voxlake.functions import geometry
from voxlake.operators import frames as N
from voxlake.operators import pixels as P
from voxlake.operators import relational as R
from voxlake.operators import volume as V
from voxlake.operators.pixels import explode_frames

from .views import PX, SIDE, frames, pixels, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NUM = PX + ", num AS (SELECT series, sop, row_number() OVER (PARTITION BY series ORDER BY sop) - 1 AS idx, count(*) OVER (PARTITION BY series) AS n FROM (SELECT DISTINCT series, sop FROM px))"


@query(NUM + " SELECT series, sop, idx FROM num")
def volume_keep(spark, sf):
    return V.keep_volume(frames(spark, sf).select("series", "sop"), "series", ["sop"]).withColumn("idx", F.col("idx").cast("long"))


@query(NUM + " SELECT p.series, p.sop, p.x, p.y, p.px FROM px p JOIN num ON p.sop = num.sop AND p.series = num.series WHERE num.idx = num.n // 2")
def volume_central(spark, sf):
    return explode_frames(V.central_slice(frames(spark, sf), "series", ["sop"]), ["series", "sop"], SIDE)


def _mip(spark, sf, skip_start, skip_end):
    """The largest sample of each place: whole tiles are kept in tasks and merged after the shuffle, no row a sample."""
    from voxlake.operators import tiles

    grid = tiles.Grid(SIDE, SIDE, SIDE)
    top = tiles.projected(frames(spark, sf), "series", ["sop"], grid, central="central-slice", skip_start=skip_start, skip_end=skip_end, data="data", empty="drop")
    return tiles.tile_samples(top.select("series", "ty", "tx", F.col("m").alias("data")), ["series"], grid)


@query(PX + " SELECT series, x, y, max(px) AS px FROM px GROUP BY ALL")
def volume_mip(spark, sf):
    return _mip(spark, sf, 0, 0)


@query(NUM + " SELECT p.series, p.x, p.y, max(p.px) AS px FROM px p JOIN num ON p.sop = num.sop AND p.series = num.series WHERE num.idx >= 5 AND num.idx < num.n - 5 GROUP BY ALL")
def volume_mip_skip(spark, sf):
    return _mip(spark, sf, 5, 5)


LERP = NUM + (
    ", o AS (SELECT unnest(range(0, 16))::BIGINT AS out), s AS (SELECT DISTINCT series, n FROM num), "
    "g AS (SELECT s.series, o.out, CAST(CAST(o.out::FLOAT / 15::FLOAT AS FLOAT) * (s.n - 1)::FLOAT AS FLOAT) AS pos FROM s, o), "
    "k AS (SELECT series, out, floor(pos)::BIGINT AS lo, ceil(pos)::BIGINT AS hi, CAST(pos - floor(pos) AS FLOAT)::DOUBLE AS a FROM g), "
    "f AS (SELECT p.series, num.idx, p.x, p.y, p.px FROM px p JOIN num ON p.sop = num.sop AND p.series = num.series) "
    "SELECT k.series, k.out AS frame, l.x, l.y, floor(l.px * (1 - k.a) + h.px * k.a)::BIGINT AS px FROM k JOIN f l ON l.series = k.series AND l.idx = k.lo JOIN f h ON h.series = k.series AND h.idx = k.hi AND h.x = l.x AND h.y = l.y"
)


@query(LERP)
def volume_interpolate(spark, sf):
    out = V.interpolate(frames(spark, sf), "series", ["sop"], 16)
    return explode_frames(out.withColumn("frame", F.col("frame").cast("long")), ["series", "frame"], SIDE)


@query(
    "WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), d AS (SELECT user_id, n, CAST((1 + user_id % 5) / 4.0 AS FLOAT) AS fpmm FROM e) "
    "SELECT user_id, n, (floor(CAST(CAST((n - 1)::FLOAT / fpmm AS FLOAT) / 2.5::FLOAT AS FLOAT)::DOUBLE + 0.5) + 1)::BIGINT AS target FROM d"
)
def volume_zspacing_target(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    fpmm = ((F.col("user_id") % 5 + 1) / 4.0).cast("float")
    return e.select("user_id", "n", geometry.z_target(F.col("n"), fpmm, 2.5).alias("target"))


@query(PX + ", s AS (SELECT series, x, y, sum(px)::BIGINT AS s FROM px GROUP BY ALL) SELECT series, x, y, s, round(CASE WHEN max(s) OVER (PARTITION BY series) > 0 THEN s::DOUBLE / max(s) OVER (PARTITION BY series) ELSE 0 END, 9) AS v FROM s")
def volume_parallel_beam(spark, sf):
    return V.depth_sum(pixels(spark, sf), "series").withColumn("v", F.round("v", 9))


BLUR_SQL = PX + (
    ", t AS (SELECT d, w FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) v(d, w)), "
    "g AS (SELECT gx.o AS x, gy.o AS y FROM (SELECT unnest(range(0, 4))::BIGINT AS o) gx, (SELECT unnest(range(0, 4))::BIGINT AS o) gy) "
    "SELECT p.series, p.sop, g.x, g.y, sum(a.w * b.w * p.px)::BIGINT AS v256 FROM g CROSS JOIN t a CROSS JOIN t b JOIN px p ON p.x = least(greatest(2 * g.x + a.d, 0), 7) AND p.y = least(greatest(2 * g.y + b.d, 0), 7) GROUP BY ALL"
)


@query(BLUR_SQL)
def pyramid_blur_down(spark, sf):
    w = V.blur_weights(SIDE)
    out = P.separable_frames(frames(spark, sf), ["series", "sop"], w, w).withColumn("data", F.transform("data", lambda v: F.round(v * 256).cast("long")))
    return explode_frames(out, ["series", "sop"], 4).withColumnRenamed("px", "v256")


@query(
    PX + ", g AS (SELECT o, (o * 7) // 14 AS lo, least((o * 7) // 14 + 1, 7) AS hi, o * 7 / 14.0::DOUBLE - floor(o * 7 / 14.0::DOUBLE) AS f FROM (SELECT unnest(range(0, 15))::BIGINT AS o)), "
    "t AS (SELECT o, lo AS i, 1 - f AS w FROM g UNION ALL SELECT o, hi, f FROM g), k AS (SELECT o, i, sum(w) AS w FROM t GROUP BY ALL HAVING sum(w) > 0) "
    "SELECT p.series, p.sop, gx.o AS x, gy.o AS y, sum(p.px * gx.w * gy.w * 4)::BIGINT AS v4 FROM px p JOIN k gx ON p.x = gx.i JOIN k gy ON p.y = gy.i GROUP BY ALL"
)
def pyramid_upsample(spark, sf):
    w = V.corner_weights(SIDE, 15)
    out = P.separable_frames(frames(spark, sf), ["series", "sop"], w, w).withColumn("data", F.transform("data", lambda v: F.round(v * 4).cast("long")))
    return explode_frames(out, ["series", "sop"], 15).withColumnRenamed("px", "v4")


def _bilateral_sql(image: str, keys: str, name: str, side: int = SIDE) -> str:
    """CTE `name`: the bilateral filter of image (keys, x, y, v FLOAT), neighbours repeated at the edges."""
    same = " AND ".join(f"n.{k} = p.{k}" for k in keys.split(", "))
    own = ", ".join(f"p.{k}" for k in keys.split(", "))
    return (
        f"{name}_at AS (SELECT o, d, least(greatest(o + d, 0), {side - 1}) AS i FROM (SELECT unnest(range(0, {side}))::BIGINT AS o), (SELECT unnest(range(-6, 7))::BIGINT AS d)), "
        f"{name}_pn AS (SELECT {own}, p.x, p.y, p.v, a.d AS dx, b.d AS dy, a.i AS nx, b.i AS ny FROM {image} p JOIN {name}_at a ON a.o = p.x JOIN {name}_at b ON b.o = p.y), "
        f"{name}_nb AS (SELECT {own}, p.x, p.y, n.v, exp(-(p.dx * p.dx + p.dy * p.dy) / 18.0::DOUBLE) * exp(-(floor(CAST(CAST(least(CAST((n.v - p.v) * (n.v - p.v) AS FLOAT), 1::FLOAT) * 2047::FLOAT AS FLOAT) + 0.5::FLOAT AS FLOAT)::DOUBLE) / 2047.0::DOUBLE) / (2 * 0.015::DOUBLE * 0.015::DOUBLE)) AS w "
        f"FROM {name}_pn p JOIN {image} n ON {same} AND n.x = p.nx AND n.y = p.ny), "
        f"{name} AS (SELECT {keys}, x, y, sum(v::DOUBLE * w) / sum(w) AS v FROM {name}_nb GROUP BY ALL)"
    )


def _expanded_sql(image: str, name: str, side: int = SIDE) -> str:
    """CTE `name`: image (series, x, y, v) blurred, halved and interpolated back, for an even side."""
    n, last = side // 2, side - 1
    return (
        f"{name}_t AS (SELECT d, w FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) v(d, w)), {name}_o AS (SELECT unnest(range(0, {n}))::BIGINT AS o), "
        f"{name}_k AS (SELECT o, least(greatest(2 * o + d, 0), {last}) AS i, sum(w) AS w FROM {name}_o CROSS JOIN {name}_t GROUP BY ALL), "
        f"{name}_d AS (SELECT p.series, a.o AS x, b.o AS y, sum(a.w * b.w * p.v) / 256 AS v FROM {image} p JOIN {name}_k a ON p.x = a.i JOIN {name}_k b ON p.y = b.i GROUP BY ALL), "
        f"{name}_g AS (SELECT o, (o * {n - 1}) // {last} AS lo, least((o * {n - 1}) // {last} + 1, {n - 1}) AS hi, o * {n - 1} / {last}.0::DOUBLE - floor(o * {n - 1} / {last}.0::DOUBLE) AS f FROM (SELECT unnest(range(0, {side}))::BIGINT AS o)), "
        f"{name}_u AS (SELECT o, i, sum(w) AS w FROM (SELECT o, lo AS i, 1 - f AS w FROM {name}_g UNION ALL SELECT o, hi, f FROM {name}_g) GROUP BY ALL), "
        f"{name} AS (SELECT p.series, a.o AS x, b.o AS y, sum(a.w * b.w * p.v) AS v FROM {name}_d p JOIN {name}_u a ON p.x = a.i JOIN {name}_u b ON p.y = b.i GROUP BY ALL)"
    )


@query(PX + ", im AS (SELECT series, sop, x, y, CAST(px::FLOAT / 65535::FLOAT AS FLOAT) AS v FROM px), " + _bilateral_sql("im", "series, sop", "bi") + " SELECT series, sop, x, y, round(v * 1000000)::BIGINT AS v FROM bi")
def bilateral_8x8(spark, sf):
    from voxlake.operators.images import bilateral_frames

    out = bilateral_frames(frames(spark, sf), ["series", "sop"], SIDE, SIDE).withColumn("data", F.transform("data", lambda v: F.round(v * 1000000).cast("long")))
    return explode_frames(out, ["series", "sop"], SIDE).withColumnRenamed("px", "v")


FUSED = PX + (
    ", two AS (SELECT series, x, y, max(px) AS m, sum(px)::BIGINT AS s, count(*) AS n FROM px GROUP BY ALL), "
    "im AS (SELECT series, x, y, CAST(m::FLOAT / 65535::FLOAT AS FLOAT) AS v FROM two), "
    "ic AS (SELECT series, x, y, CASE WHEN max(s) OVER (PARTITION BY series) > 0 THEN CAST(s::FLOAT / (max(s) OVER (PARTITION BY series))::FLOAT AS FLOAT) ELSE 0::FLOAT END AS v FROM two), "
    + _bilateral_sql("im", "series", "bm") + ", " + _bilateral_sql("ic", "series", "bc") + ", " + _expanded_sql("bm", "em") + ", " + _expanded_sql("bc", "ec") +
    " SELECT t.series, t.x, t.y, CASE WHEN t.n = 1 THEN t.m ELSE floor(least(greatest(ec.v + 2 * ec.v * ((bc.v - ec.v) + 1.5 * (bm.v - em.v)), 0), 1) * 65535)::BIGINT END AS px FROM two t "
    "JOIN bm ON bm.series = t.series AND bm.x = t.x AND bm.y = t.y JOIN bc ON bc.series = t.series AND bc.x = t.x AND bc.y = t.y JOIN em ON em.series = t.series AND em.x = t.x AND em.y = t.y JOIN ec ON ec.series = t.series AND ec.x = t.x AND ec.y = t.y"
)


@query(FUSED)
def volume_laplacian_mip(spark, sf):
    """Pyramid fusion of the largest and the central image of each series."""
    from voxlake.operators.images import laplacian_mip

    return explode_frames(laplacian_mip(frames(spark, sf), "series", "sop", SIDE, SIDE), ["series"], SIDE)


#: Frames of 64 x 64, each from one embedding: the product of its values at x and y. Tiles of 16, four frames trimmed.
BIG, TILE, SKIPPED = 64, 16, (1, 3)
BIG_PX = (
    "WITH big AS (SELECT label::BIGINT AS series, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, count(*) OVER (PARTITION BY label) AS n, embedding FROM embeddings), "
    f"few AS (SELECT * FROM big WHERE idx >= {SKIPPED[0]} AND idx < n - {SKIPPED[1]}), line AS (SELECT unnest(range(0, {BIG}))::BIGINT AS o), "
    "px AS (SELECT series, idx, n, ax.o AS x, ay.o AS y, floor(least(greatest(embedding[ax.o + 1]::DOUBLE, 0) * greatest(embedding[ay.o + 1]::DOUBLE, 0), 1) * 65535)::BIGINT AS px FROM few CROSS JOIN line ax CROSS JOIN line ay), "
)


def big_frames(spark, sf):
    """(series, sop, data): 64 x 64 frames as little-endian u16."""
    from voxlake.operators.tiles import map_rows

    def each(rows):
        import numpy as np

        for series, sop, v in rows:
            e = np.maximum(np.array(v, np.float32).astype(np.float64), 0)
            yield series, sop, np.floor(np.minimum(np.outer(e, e), 1) * 65535).astype("<u2").tobytes()

    df = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("series"), F.col("vec_id").cast("long").alias("sop"), "embedding")
    return map_rows(df, each, T.StructType.fromDDL("series long, sop long, data binary"))


def _big_fused(centre: str) -> str:
    return BIG_PX + (
        f"two AS (SELECT series, x, y, max(px) AS m, sum(px)::BIGINT AS s, max(px) FILTER (WHERE idx - {SKIPPED[0]} = (n - {sum(SKIPPED)}) // 2) AS mid, count(*) AS n FROM px GROUP BY ALL), "
        f"im AS (SELECT series, x, y, CAST(m::FLOAT / 65535::FLOAT AS FLOAT) AS v FROM two), ic AS (SELECT series, x, y, {centre} AS v FROM two), "
        + _bilateral_sql("im", "series", "bm", BIG) + ", " + _bilateral_sql("ic", "series", "bc", BIG) + ", " + _expanded_sql("bm", "em", BIG) + ", " + _expanded_sql("bc", "ec", BIG) +
        " SELECT t.series, t.x, t.y, CASE WHEN t.n = 1 THEN t.m ELSE floor(least(greatest(ec.v + 2 * ec.v * ((bc.v - ec.v) + 1.5 * (bm.v - em.v)), 0), 1) * 65535)::BIGINT END AS px FROM two t "
        "JOIN bm USING (series, x, y) JOIN bc USING (series, x, y) JOIN em USING (series, x, y) JOIN ec USING (series, x, y)"
    )


def _fuse_big(spark, sf, central):
    from voxlake.operators import tiles

    grid = tiles.Grid(BIG, BIG, TILE)
    return tiles.tile_samples(tiles.fuse_tiles(big_frames(spark, sf), "series", ["sop"], grid, central=central, skip_start=SKIPPED[0], skip_end=SKIPPED[1], empty="drop"), ["series"], grid)


@query(_big_fused("CASE WHEN max(s) OVER (PARTITION BY series) > 0 THEN CAST(s::FLOAT / (max(s) OVER (PARTITION BY series))::FLOAT AS FLOAT) ELSE 0::FLOAT END"))
def fusion_tiles_parallel_beam(spark, sf):
    """Fusion with the depth sum as the centre, frames trimmed, tile by tile."""
    return _fuse_big(spark, sf, "parallel-beam")


@query(_big_fused("CAST(mid::FLOAT / 65535::FLOAT AS FLOAT)"))
def fusion_tiles_central_slice(spark, sf):
    """Fusion with the middle frame as the centre, frames trimmed, tile by tile."""
    return _fuse_big(spark, sf, "central-slice")


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_linestatus").alias("part"), F.col("l_extendedprice").alias("v"))


@query("SELECT l_returnflag AS channel, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS std FROM lineitem GROUP BY l_returnflag")
def stats_channel(spark, sf):
    return R.channel_stats(_lines(spark, sf), ["channel"]).select("channel", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(PX + " SELECT series, count(*) AS n, round(avg(px / 65535.0), 6) AS mean, round(stddev_samp(px / 65535.0), 6) AS std FROM px GROUP BY series")
def stats_channel_normalized(spark, sf):
    s = pixels(spark, sf).select("series", (F.col("px") / 65535.0).alias("v"))
    return R.channel_stats(s, ["series"]).select("series", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT l_returnflag AS channel, count(*) AS n, round(avg(l_extendedprice), 3) AS mean, round(stddev_samp(l_extendedprice), 3) AS std FROM lineitem GROUP BY l_returnflag")
def stats_merge(spark, sf):
    parts = R.partial_stats(_lines(spark, sf), ["channel", "part"])
    return R.merge_stats(parts, ["channel"]).select("channel", "n", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


#: Frames as a file of their samples above 0, two bytes each, behind four bytes of a count; the files begin with eight bytes.
PLACES = """WITH f AS (SELECT label::BIGINT AS series, vec_id AS sop, 2 * len(list_filter(embedding, lambda v: v::DOUBLE > 0.1))::BIGINT + 4 AS length FROM embeddings),
o AS (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY series) AS n, 8 + coalesce(sum(length) OVER (PARTITION BY series ORDER BY sop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM f WINDOW w AS (PARTITION BY series ORDER BY sop))"""


def _placed(spark, sf):
    f = frames(spark, sf).select("series", F.col("sop").alias("frame"), (F.size(F.filter("data", lambda v: v > 0)) * 2 + 4).cast("long").alias("length"))
    return N.byte_places(f, "series", "frame", "length", 8)


@query(PLACES + """ SELECT series, p::INTEGER AS shown, sop AS frame, false AS derived, place::BIGINT AS "offset", length FROM o""")
def frame_index(spark, sf):
    """Where every frame of every series lies."""
    return N.shown_frames(_placed(spark, sf), file="series")


@query(PLACES + """,
s AS (SELECT series, n, unnest(range(0, CASE WHEN n <= 1 THEN n ELSE 24 END)) AS shown FROM (SELECT DISTINCT series, n FROM o)),
a AS (SELECT *, CASE WHEN n <= 1 THEN 0::FLOAT ELSE ((shown::FLOAT / 23::FLOAT)::FLOAT * (n - 1)::FLOAT)::FLOAT END AS x FROM s)
SELECT a.series, shown::INTEGER AS shown, sop AS frame, x <> floor(x) AS derived, place::BIGINT AS "offset", length FROM a LEFT JOIN o ON o.series = a.series AND x = floor(x) AND o.p = x::BIGINT""")
def frame_lookup(spark, sf):
    """Which of 24 resampled frames of every series are stored ones, and where these lie."""
    return N.shown_frames(_placed(spark, sf), Handler("interpolate", target_frames=24), "series")
