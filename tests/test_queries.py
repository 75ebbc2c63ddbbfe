"""Every registered query of the image engine against DuckDB on the smallest test data."""

import glob
import os

import duckdb
import pytest

from voxlake.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalogue.SQL[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == want and got


def test_fusion_matches_the_kernel(spark):
    """The grouped form (maxima and sums as aggregates) against the array kernel on whole volumes."""
    import numpy as np

    from voxlake.kernels.volumes import laplacian_mip
    from voxlake.plans.views import frames

    want = {}
    for r in frames(spark, SF).orderBy("sop").collect():
        want.setdefault(r.series, []).append(np.array(r.data, np.uint16).reshape(8, 8))
    got = {}
    for r in catalogue.QUERIES["volume_laplacian_mip"](spark, SF).collect():
        got.setdefault(r.series, np.zeros((8, 8), int))[r.y, r.x] = r.px
    assert set(got) == set(want)
    for k, v in want.items():
        assert np.abs(laplacian_mip(v).astype(int) - got[k]).max() <= 2
