"""Header scans and the committed file writer."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_kernels import slice_of
from voxlake import jobs
from voxlake.codec import dicom, tiff
from voxlake.operators import prepare
from voxlake.sources import files as S
from voxlake.sources import sinks
from voxlake.sources.headers import read_headers, scan_headers
from voxlake.sources.ranges import RangeFile


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    (src / "deep").mkdir(parents=True)
    big = np.arange(1024 * 700, dtype="<u2").tobytes()
    for z in range(4):
        (src / f"s{z}.dcm").write_bytes(dicom.write(slice_of(z, Rows=1024, Columns=700, PixelData=big)))
    (src / "deep" / "plain").write_bytes(dicom.write(slice_of(7)))
    (src / "deep" / "note").write_text("no magic here")
    (src / "cut.dcm").write_bytes(dicom.write(slice_of(8))[:-5])
    (src / "empty.dcm").write_bytes(b"")
    (src / "other.txt").write_text("x")
    (src / ".hidden.dcm").write_bytes(b"x")
    return src


def test_rows_are_those_of_whole_files(spark, folder):
    got = {r.path: r for r in scan_headers(spark, str(folder)).collect()}
    assert sorted(p.rpartition("/")[2] for p in got) == ["cut.dcm", "empty.dcm", "plain", "s0.dcm", "s1.dcm", "s2.dcm", "s3.dcm"]
    whole = {r.path: r for r in prepare.headers(S.find_dicoms(spark, str(folder))).collect()}
    for path, want in whole.items():
        have = got[path].asDict()
        assert {k: have[k] for k in want.asDict()} == want.asDict() or want.error_code and have["error_code"], path
    assert got[next(p for p in got if p.endswith("/s1.dcm"))].PixelDataLength == 1024 * 700 * 2
    assert {p.rpartition("/")[2] for p, r in got.items() if r.error_code} == {"cut.dcm", "empty.dcm"}


def test_under_a_twentieth_of_the_bytes_is_read(spark, folder, tmp_path):
    s = scan_headers(spark, str(folder)).where("path like '%/s_.dcm'").agg(F.sum("bytes_read").alias("r"), F.sum("length").alias("n")).first()
    assert 0 < s.r < 0.05 * s.n
    out = tmp_path / "t"
    out.mkdir()
    (out / "a.tiff").write_bytes(tiff.encode([np.arange(1 << 20, dtype="<u2").reshape(1024, 1024)] * 2, tiff.Preparation(crop=(1, 2, 3, 4), num_frames=2), "none"))
    (out / "bad.tiff").write_bytes(b"II*")
    rows = {r.path.rpartition("/")[2]: r for r in scan_headers(spark, str(out), "tiff").collect()}
    assert rows["a.tiff"].bytes_read < 0.05 * rows["a.tiff"].length and (rows["a.tiff"].width, rows["a.tiff"].num_frames) == (1024, 2)
    assert rows["bad.tiff"].error_code and rows["bad.tiff"].width is None
    whole = {r.path: r for r in prepare.tiff_info(S.scan(spark, str(out))).collect()}
    for r in rows.values():
        if not r.error_code:
            assert {k: r[k] for k in ("width", "height", "channels", "num_frames", "crop")} == {k: whole[r.path][k] for k in ("width", "height", "channels", "num_frames", "crop")}


def test_fragments_are_not_read():
    import io

    import pyarrow as pa

    body = dicom.write(slice_of(0))
    at = body.index(bytes.fromhex("e07f1000"))
    frags = b"".join(bytes.fromhex("feff00e0") + len(f).to_bytes(4, "little") + f for f in (b"", b"x" * 90000, b"y" * 70000)) + bytes.fromhex("feffdde000000000")
    body = body[:at] + bytes.fromhex("e07f1000") + b"OB\0\0" + b"\xff" * 4 + frags
    f = RangeFile(pa.PythonFile(io.BytesIO(body), "r"), 4096)
    ds = dicom.parse(f, spans=True)
    assert [len(r) for r in ds["PixelData"]] == [0, 90000, 70000] and f.read < 20000
    assert body[ds["PixelData"][1].start : ds["PixelData"][1].stop] == b"x" * 90000
    assert dicom.header_row(ds)["PixelDataLength"] == dicom.header_row(dicom.parse(body))["PixelDataLength"]


def test_errors_of_the_path(spark, folder, tmp_path):
    with pytest.raises(NotADirectoryError):
        scan_headers(spark, str(folder / "s0.dcm"))
    with pytest.raises(FileNotFoundError):
        scan_headers(spark, str(tmp_path / "nowhere"))
    (tmp_path / "void").mkdir()
    assert scan_headers(spark, str(tmp_path / "void")).collect() == []
    rows = read_headers(spark, [f"{folder}/s0.dcm", f"{folder}/gone.dcm"]).collect()
    assert sorted((r.path.rpartition("/")[2], r.error_code) for r in rows) == [("gone.dcm", "UNREADABLE"), ("s0.dcm", None)]


def test_filters_reach_the_listing(spark, folder):
    name = "spark.sql.python.filterPushdown.enabled"
    plain = scan_headers(spark, str(folder)).where(F.col("path").endswith("2.dcm")).collect()
    spark.conf.set(name, "true")
    try:
        os.chmod(folder / "s0.dcm", 0)
        df = scan_headers(spark, str(folder)).where(F.col("path").endswith("2.dcm") & (F.col("length") > 0))
        assert df.collect() == plain and len(plain) == 1
        assert "EndsWith" not in df._jdf.queryExecution().executedPlan().toString().partition("Scan")[0]
    finally:
        spark.conf.unset(name)


def test_many_partitions(spark, folder):
    df = scan_headers(spark, str(folder), taskcost="1")
    assert df.rdd.getNumPartitions() == 8 and df.count() == 7  # one file is opened for its magic only


def test_order_and_validate_read_headers_only(spark, folder):
    assert jobs.run_validate(spark, str(folder), decode=False).count() == 7
    assert {r.path.rpartition("/")[2] for r in jobs.run_order(spark, str(folder)).collect()} >= {"s0.dcm", "s3.dcm"}


# ---------------------------------------------------------------- committed writes


def left(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and "_reports" not in p.parts)


def test_writes_once_and_reports(spark, tmp_path):
    root = tmp_path / "out"
    rows = [(f"{root}/a/{i}.bin", bytes([i]) * i, "x") for i in range(20)] + [(None, b"q", "no name"), (f"{root}/void", None, "no content")]
    df = spark.createDataFrame(rows, "p string, c binary, why string").repartition(5)
    done = sinks.write_files(df, str(root), "p", "c", ["why"])
    before = {p: os.stat(root / p).st_mtime_ns for p in left(root)}
    assert done.count() == 22 and done.count() == 22 and done.where("bytes is null").count() == 2
    assert {p: os.stat(root / p).st_mtime_ns for p in left(root)} == before and len(before) == 20
    assert (root / "a" / "7.bin").read_bytes() == b"\x07" * 7 and not list(root.glob("_staging*"))
    again = sinks.write_files(df.withColumn("c", F.when(F.col("c").isNotNull(), F.lit(b"new"))), str(root), "p", "c")
    assert again.where("bytes = 3").count() == 20 and (root / "a" / "7.bin").read_bytes() == b"new" and len(left(root)) == 20


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    root = tmp_path / "out"

    def fails(it):
        import pyarrow as pa

        for b in it:
            for i in range(b.num_rows):
                n = b.column(0)[i].as_py()
                if n == 17:
                    raise ValueError("half way")
                yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{n}"]), pa.array([b"x"], pa.binary())], names=["path", "content"])

    df = spark.range(0, 40, 1, 2).mapInArrow(fails, "path string, content binary")
    with pytest.raises(Exception, match="half way"):
        sinks.write_files(df, str(root))
    assert left(root) == []


def test_paths_stay_below_the_root(spark, tmp_path):
    for bad in (f"{tmp_path}/elsewhere/x", f"{tmp_path}/out/../x"):
        with pytest.raises(Exception, match="isn't below"):
            sinks.write_files(spark.createDataFrame([(bad, b"x")], "path string, content binary"), f"{tmp_path}/out")
    none = sinks.write_files(spark.createDataFrame([], "path string, content binary"), f"{tmp_path}/out")
    assert none.collect() == []
