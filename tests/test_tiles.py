"""Fusion in tiles against the whole-image kernel."""

import numpy as np
import pytest

from voxlake.errors import ImageError
from voxlake.kernels import volumes as V
from voxlake.operators import tiles

SCHEMA = "series string, sop long, data binary"


def image_rows(width, height, counts, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for name, n in counts.items():
        base = rng.integers(0, 40000, (height, width))
        for i in range(n):
            rows.append((name, i, np.clip(base + rng.integers(-300, 300, (height, width)) + 900 * i, 0, 65535).astype("<u2")))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(s, i, d if d is None else d.tobytes()) for s, i, d in rows], SCHEMA)


def whole(got, grid):
    out = {}
    for r in got:
        y0, y1, x0, x1 = grid.window(r.ty, r.tx)
        out.setdefault(r.series, np.full((grid.height, grid.width), -1, int))[y0:y1, x0:x1] = np.frombuffer(r.data, "<u2").reshape(y1 - y0, x1 - x0)
    return out


@pytest.mark.parametrize("central", ["parallel-beam", "central-slice"])
@pytest.mark.parametrize(("width", "height"), [(40, 33), (9, 3)])
def test_every_tile_size_gives_the_same(spark, central, width, height):
    rows = image_rows(width, height, {"a": 6, "b": 4, None: 5})
    seen = []
    for tile in (5, 16, 64):
        grid = tiles.Grid(width, height, tile)
        seen.append(whole(tiles.fuse_tiles(frame(spark, rows), "series", ["sop"], grid, central=central, skip_start=1, skip_end=2).collect(), grid))
    assert set(seen[0]) == {"a", "b", None}
    for other in seen[1:]:
        assert all((other[k] == seen[0][k]).all() for k in seen[0])
    for name, got in seen[0].items():
        frames = [d for s, _, d in rows if s == name]
        want = V.laplacian_mip(frames, skip_start=1, skip_end=2, central=central)
        assert np.abs(got - want.astype(int)).max() <= 2  # the kernel adds depth in f32, tiles in integers
        assert (got == want).mean() > 0.5


def test_one_frame_is_unchanged_and_series_may_repeat_keys(spark):
    rows = image_rows(20, 12, {"one": 3})
    grid = tiles.Grid(20, 12, 8)
    got = whole(tiles.fuse_tiles(frame(spark, rows), "series", ["sop"], grid, skip_start=1, skip_end=1).collect(), grid)
    assert (got["one"] == rows[1][2]).all()


def test_empty_trim_is_an_error_or_goes(spark):
    rows = image_rows(8, 8, {"short": 2, "long": 5})
    grid = tiles.Grid(8, 8, 4)
    with pytest.raises(Exception, match="EMPTY_VOLUME"):
        tiles.fuse_tiles(frame(spark, rows), "series", ["sop"], grid, skip_start=1, skip_end=1).collect()
    kept = tiles.fuse_tiles(frame(spark, rows), "series", ["sop"], grid, skip_start=1, skip_end=1, empty="drop").collect()
    assert {r.series for r in kept} == {"long"} and len(kept) == 4


def test_wrong_frames_name_their_series(spark):
    grid = tiles.Grid(8, 8, 4)
    for bad in (None, np.zeros(5, "<u2")):
        with pytest.raises(Exception, match="series-x"):
            tiles.fuse_tiles(frame(spark, [("series-x", 0, bad), ("series-x", 1, np.zeros((8, 8), "<u2"))]), "series", ["sop"], grid).collect()
    with pytest.raises(ImageError):
        tiles.fuse_tiles(frame(spark, []), "series", ["sop"], tiles.Grid(2, 9, 4))
    assert tiles.fuse_tiles(frame(spark, []), "series", ["sop"], grid).collect() == []


def test_halo_of_any_reach(spark):
    """Windows read from strips are windows of the image, also where a halo is wider than a tile."""
    rng = np.random.default_rng(1)
    image = rng.integers(0, 65535, (13, 17)).astype("<u2")
    for tile, halo in ((3, 7), (4, 4), (20, 3), (1, 2)):
        grid = tiles.Grid(17, 13, tile)
        cut = tiles.cut_tiles(frame(spark, [("s", 0, image), (None, 1, image[::-1])]), ["series", "sop"], grid)
        got = tiles.exchange(cut, ["series", "sop"], grid, halo, {"data": "<u2"}, lambda row, w: (w[0].tobytes(),), "window binary").collect()
        assert len(got) == 2 * len(list(grid.tiles()))
        for r in got:
            top, bottom, left, right = grid.window(r.ty, r.tx, halo)
            want = image if r.sop == 0 else image[::-1]
            assert (np.frombuffer(r.window, "<u2").reshape(bottom - top, right - left) == want[top:bottom, left:right]).all()


def test_a_frame_is_read_once(spark):
    """The brightest place and the images come from one pass over the frames."""
    grid = tiles.Grid(8, 8, 4)
    df = tiles.fuse_tiles(frame(spark, image_rows(8, 8, {"a": 3})), "series", ["sop"], grid)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
