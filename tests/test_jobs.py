import json

import numpy as np
import pytest

from tests.test_kernels import AXIAL, slice_of
from voxlake import jobs
from voxlake.codec import dicom, tiff
from voxlake.config import Handler, Preprocessor
from voxlake.functions import coords, geometry, paths
from voxlake.operators import ordering, prepare, relational
from voxlake.operators.prepare import order_frames
from voxlake.sources import files as S
from voxlake.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for z in range(3):
        (src / f"s{z}.dcm").write_bytes(dicom.write(slice_of(z)))
    (src / "plain").write_bytes(dicom.write(slice_of(7, SeriesInstanceUID="1.9.2", SpacingBetweenSlices="3")))
    (src / "short").write_bytes(b"abc")
    (src / "odd.Dcm").write_bytes(dicom.write(slice_of(8)))
    (src / "note.txt").write_text("x")
    return src


def test_find_and_lists(spark, folder, tmp_path):
    names = sorted(r.path.rpartition("/")[2] for r in S.find_dicoms(spark, str(folder)).select("path").collect())
    assert names == ["plain", "s0.dcm", "s1.dcm", "s2.dcm"]
    listed = tmp_path / "list.txt"
    listed.write_text(f"{folder}/s1.dcm\n\n{folder}/s0.dcm\n")
    got = S.load_source(spark, str(listed)).orderBy("n").collect()
    assert [r.path.rpartition("/")[2] for r in got] == ["s1.dcm", "s0.dcm"] and got[0].content == (folder / "s1.dcm").read_bytes()
    (tmp_path / "none.txt").write_text("\n \n")
    with pytest.raises(ValueError, match="lists no files"):
        S.load_source(spark, str(tmp_path / "none.txt"))
    assert S.with_inode(S.find_dicoms(spark, str(folder))).where("inode > 0").count() == 4


def test_preprocess_manifest_stats_resize(spark, folder, tmp_path):
    out = tmp_path / "out"
    done = jobs.run_preprocess(spark, str(folder), str(out), Preprocessor(size=(16, 16), padding="center")).collect()
    assert len(done) == 4 and all(r.error is None for r in done)
    t = tiff.Tiff((out / "1.9" / "1.9.1" / "1.2.3.0.tiff").read_bytes())
    assert t.page(0).size == (16, 16) and t.preparation().resolution is not None
    m = jobs.run_manifest(spark, str(out), str(tmp_path / "m.parquet")).collect()
    assert (tmp_path / "m.parquet").is_file() and spark.read.parquet(str(tmp_path / "m.parquet")).collect() == m
    assert [(r.study_instance_uid, r.sop_instance_uid, r.width, r.channels, r.num_frames) for r in m] == [("1.9", f"1.2.3.{z}", 16, 1, 1) for z in (0, 1, 2, 7)]
    s = jobs.run_stats(spark, str(out)).collect()
    px = np.concatenate([tiff.decode(p.read_bytes())[0].ravel() for p in out.rglob("*.tiff")]).astype(float)
    assert s[0].n == px.size and s[0].mean == pytest.approx(px.mean()) and s[0].std == pytest.approx(px.std(ddof=1))
    small = tmp_path / "small"
    assert jobs.run_resize(spark, str(out), str(small), 0.5).count() == 4
    assert tiff.Tiff((small / "1.9" / "1.9.1" / "1.2.3.0.tiff").read_bytes()).page(0).size == (8, 8)
    loaded = prepare.load_tiffs(S.find_tiffs(spark, str(out)), dtype="f32")
    parts = list(prepare.batches(loaded, 3))
    assert [p.shape for p in parts] == [(3, 1, 16, 16, 1), (1, 1, 16, 16, 1)] and parts[0].dtype == np.float32
    meta = tmp_path / "meta.csv"
    meta.write_text("series_instance_uid,sop_instance_uid,instance_number\n" + "".join(f"1.9.1,1.2.3.{z},{5 - z}\n" for z in range(3)))
    stacks = jobs.run_combine(spark, str(out), str(meta), str(tmp_path / "stack")).collect()
    assert len(stacks) == 1
    stacked = tiff.decode((tmp_path / "stack" / "1.9" / "1.9.1" / "1.2.3.2.tiff").read_bytes())
    assert len(stacked) == 3


def test_traces(spark, tmp_path):
    src = tmp_path / "t"
    src.mkdir()
    blank = np.zeros((80, 100), np.uint8)
    for name, hor, ver in (("a", True, False), ("b", False, True), ("c", True, True)):
        (src / f"{name}.tiff").write_bytes(tiff.encode([blank], tiff.Preparation(flip=(100, 80, hor, ver))))
    (src / "test1.tiff").write_bytes(tiff.encode([np.zeros((100, 100), np.uint8)]))
    csv = tmp_path / "t.csv"
    csv.write_text("sop_instance_uid,trace_hash,x_min,x_max,y_min,y_max\n" + "".join(f"{n},1,10,20,30,40\n" for n in ("a", "b", "c", "test1", "nobody")))
    got = {r.sop_instance_uid: (r.x_min, r.x_max, r.y_min, r.y_max) for r in jobs.run_traces(spark, str(src), str(csv)).collect()}
    assert got == {"a": (79, 89, 30, 40), "b": (10, 20, 39, 49), "c": (79, 89, 39, 49), "test1": (10, 20, 30, 40)}


def test_validate(spark, tmp_path):
    src = tmp_path / "v"
    src.mkdir()
    good = slice_of(0, WindowCenter="1", WindowWidth="2")
    (src / "good.dcm").write_bytes(dicom.write(good))
    for tag, code in (("HighBit", "missing_high_bit"), ("BitsStored", "missing_bits_stored"), ("BitsAllocated", "missing_bits_allocated")):
        (src / f"{code}.dcm").write_bytes(dicom.write({k: v for k, v in good.items() if k != tag}))
    (src / "unsupported_output_color_type.dcm").write_bytes(dicom.write({**good, "PhotometricInterpretation": "RGB"}))
    (src / "invalid_bits_stored.dcm").write_bytes(dicom.write({**good, "BitsStored": 17}))
    (src / "invalid_high_bit.dcm").write_bytes(dicom.write({**good, "HighBit": 3}))
    (src / "invalid_number_of_frames.dcm").write_bytes(dicom.write({**good, "NumberOfFrames": 0}))
    (src / "empty_required_tag.dcm").write_bytes(dicom.write({**good, "PhotometricInterpretation": ""}))
    rows = {r.path.rpartition("/")[2][:-4]: r for r in jobs.run_validate(spark, str(src)).collect()}
    assert rows["good"].valid and json.loads(rows["good"].report)["summary"]["error_count"] == 0
    for name, r in rows.items():
        codes = {f.code for f in r.findings if f.level == "error"}
        assert (name in codes) == (name != "good"), (name, codes)


def test_series(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    for i, z in enumerate((2, 0, 1)):
        (src / f"{i}.dcm").write_bytes(dicom.write(slice_of(z)))
    order = jobs.run_order(spark, str(src))
    assert [(r.path.rpartition("/")[2], r.strategy, r.spacing) for r in order.orderBy("position").collect()] == [("1.dcm", "geometry", 1.0), ("2.dcm", "geometry", 1.0), ("0.dcm", "geometry", 1.0)]
    files = S.find_dicoms(spark, str(src)).join(order.where("error is null").select("series", "path", "position"), "path")
    r = prepare.preprocess_series(files, Preprocessor(crop=False), dtype="u8").collect()
    assert len(r) == 1 and r[0].shape == [3, 6, 8, 1] and prepare.to_numpy(r[0]).dtype == np.uint8
    top = prepare.preprocess_series(files, Preprocessor(crop=False, handler=Handler("max-intensity"))).collect()
    assert top[0].shape == [1, 6, 8, 1]
    broken = S.scan(spark, str(src)).selectExpr("path", "cast('x' as binary) content")
    assert {r.error_code for r in prepare.preprocess(broken).collect()} == {"NOT_DICOM"}
    with pytest.raises(Exception, match="NOT_DICOM"):
        prepare.preprocess(broken, Preprocessor(strict=True)).collect()


CASES = {
    "dim": {"dimension_index": [[3], [1], [2]], "dimension_pointers": ["InStackPositionNumber"]}, "stack": {"stack_position": [3, 1, 2], "spacing_between": 1.5}, "geo": {"image_position": [[0.0, 0.0, z] for z in (2.0, 0.0, 1.0)], "image_orientation": AXIAL},
    "down": {"image_position": [[0.0, 0.0, z] for z in (2.0, 1.0, 0.0)], "image_orientation": AXIAL}, "sampled": {"image_position": [[0.0, 0.0, z] for z in (2.0, 0.0, 1.0)], "image_orientation": AXIAL, "sampled": True},
    "vector": {"vector_value": [10.0, 0.0, 5.0]}, "loc": {"slice_location": [10.0, 0.0, 5.0], "spacing_between": 1.5}, "temporal": {"temporal_position": [1, 2, 3]}, "raw": {"slice_thickness": 2.0},
    "zero": {"image_position": [[0.0, 0.0, z] for z in (2.0, 0.0, 1.0)], "image_orientation": [0.0] * 6}, "varies": {"dimension_index": [[3], [1], [2]], "dimension_pointers": ["StackID"]}, "ties": {"slice_location": [1.0, 1.0, 2.0]},
}
DDL = (
    "series string, frame int, dimension_index array<long>, dimension_pointers array<string>, stack_id string, stack_position long, temporal_position long, image_position array<double>, image_orientation array<double>, sampled boolean, "
    "vector_value double, slice_location double, spacing_between double, slice_thickness double, organization string"
)


def test_relational_order_equals_plain(spark):
    names = [c.split()[0] for c in DDL.split(", ")][2:]
    rows, want = [], {}
    for series, cols in CASES.items():
        plain = []
        for i in range(3):
            d = {c: None for c in names} | {"sampled": False}
            for c, v in cols.items():
                d[c] = v[i] if isinstance(v, list) and c not in ("image_orientation", "dimension_pointers") else v
            plain.append({"frame": i, **d})
            rows.append((series, i, *(d[c] for c in names)))
        try:
            want[series] = order_frames(plain)
        except Exception:
            want[series] = None
    got = {}
    for r in ordering.frame_order(spark.createDataFrame(rows, DDL)).orderBy("series", "position").collect():
        got.setdefault(r.series, []).append(r)
    for s, w in want.items():
        if w is None:
            assert {r.error is not None for r in got[s]} == {True}, s
        else:
            assert (got[s][0].strategy, [r.frame for r in got[s]], got[s][0].spacing) == w, s


SERIES = "series string, idx long, image_position array<double>, image_orientation array<double>, instance_number long, spacing_between double, sampled boolean, rows string"


def test_series_order_rules(spark):
    def geo(s, zs, **kw):
        return [(s, i, [0.0, 0.0, float(z)] if z is not None else None, AXIAL if z is not None else None, i + 1, kw.get("between"), kw.get("sampled", [False] * 9)[i], kw.get("rows", ["6"] * 9)[i]) for i, z in enumerate(zs)]

    rows = (
        geo("shuffled", [2, 0, 1]) + geo("down", [2, 1, 0]) + geo("partial", [0, None, 1]) + geo("uneven", [0, 1, 5]) + geo("twice", [0, 0, 1]) + geo("mixed", [0, 1, 2], sampled=[True, False, True]) + geo("sampled", [2, 0, 1], sampled=[True] * 3)
        + geo("sizes", [0, 1, 2], rows=["6", "6", "7"]) + geo("instance", [None] * 3, between=2.5)
    )
    out = {}
    for r in ordering.series_order(spark.createDataFrame(rows, SERIES)).orderBy("series", "position").collect():
        out.setdefault(r.series, []).append(r)
    tell = lambda s: (out[s][0].strategy, [r.idx for r in out[s]], out[s][0].spacing)
    assert tell("shuffled") == ("geometry", [1, 2, 0], 1.0)
    assert tell("down") == ("geometry", [0, 1, 2], 1.0)
    assert tell("sampled")[:2] == ("raw", [0, 1, 2])
    assert tell("instance") == ("instance-number", [0, 1, 2], 2.5)
    errors = {s: out[s][0].error for s in ("partial", "uneven", "twice", "mixed", "sizes")}
    assert errors == {"partial": "partial_geometry", "uneven": "irregular_spacing", "twice": "duplicate_position", "mixed": "mixed_sampled", "sizes": "incompatible"}


def test_coordinates(spark):
    from pyspark.sql import functions as F

    def at(maps, x, y, invert=False):
        f = coords.invert_all if invert else coords.apply_all
        a, b = f(maps, F.lit(x).cast("long"), F.lit(y).cast("long"))
        return tuple(spark.range(1).select(a, b).first())

    assert at([coords.FlipMap(100, 80, True, False)], 10, 30) == (89, 30)
    assert at([coords.FlipMap(100, 80, True, True)], 10, 30) == (89, 49)
    assert at([coords.ResizeMap(0.5, 0.5)], 10, 10) == (5, 5)
    assert at([coords.ResizeMap(1.5, 1.5)], 4, 6) == (6, 9) and at([coords.ResizeMap(1.5, 1.5)], 6, 9, True) == (4, 6)
    assert at([coords.PadMap(2, 2)], 1, 1, True) == (0, 0)
    chain = [coords.FlipMap(100, 80, True, False), coords.CropMap(70, 20, 20, 20), coords.ResizeMap(2.0, 2.0), coords.PadMap(5, 7)]
    assert at(chain, 10, 30) == (43, 27) and at(chain, 43, 27, True) == (10, 30)
    c2 = [coords.CropMap(4, 4, 4, 4), coords.ResizeMap(2.0, 2.0), coords.PadMap(1, 1)]
    assert [at(c2, v, v) for v in (0, 4, 7)] == [(1, 1), (1, 1), (7, 7)]
    r = spark.range(1).select(geometry.resolution(F.array(F.lit(0.661468), F.lit(0.661468)), F.lit(5.0)).alias("r")).first().r
    assert r.ppmm_x == pytest.approx(1.5117888, 1e-6) and r.frames_per_mm == pytest.approx(0.2)
    got = spark.range(1).select(paths.path_ids(F.lit("/a/st.1/se.2/1.2.840.tiff")).alias("p"), paths.path_ids(F.lit("x.tiff")).alias("q"), paths.stem(F.lit("/a/.hidden")).alias("s")).first()
    assert tuple(got.p) == ("st.1", "se.2", "1.2.840") and got.q is None and got.s == ".hidden"


def test_stats_merge(spark):
    df = spark.createDataFrame([("a", i % 2, float(i)) for i in range(1, 6)] + [("b", 0, 128.0)], "k string, part int, v double")
    for got in (relational.channel_stats(df, ["k"]), relational.merge_stats(relational.partial_stats(df, ["k", "part"]), ["k"])):
        rows = {r.k: r for r in got.collect()}
        assert rows["a"].mean == 3 and rows["a"].std == pytest.approx(1.58113883) and rows["b"].std == 0


def test_stream(spark, folder, tmp_path):
    q = ingest.ingest(ingest.once_each(ingest.watch(spark, str(folder), "*.dcm")), lambda b: prepare.preprocess(b, Preprocessor(crop=False)), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).where("error_code is null").count() == 3


def test_arguments():
    a = jobs.parser().parse_args(["preprocess", "in", "out", "--size", "4,5", "--filter", "maxpool", "--handler", "max-intensity"])
    cfg = jobs.settings(a)
    assert cfg.size == (4, 5) and cfg.filter == "max-pool" and not cfg.crop and cfg.handler.skip_start == 5
    assert jobs.main(["preprocess", "in", "out", "--size", "0,5"]) == 2
