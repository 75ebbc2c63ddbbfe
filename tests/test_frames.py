"""The frame index and reads by it."""

import numpy as np
import pytest

from tests.test_kernels import AXIAL, slice_of
from voxlake.codec import dicom, tiff
from voxlake.config import Handler
from voxlake.operators import frames as R
from voxlake.operators.prepare import frame_plan

RLE = "1.2.840.10008.1.2.5"


def encapsulated(d, fragments, table):
    """A file whose pixel data are these fragments, behind an offset table."""
    body = dicom.write({**d, "PixelData": b""}, RLE)
    body = body[: body.index(bytes.fromhex("e07f1000"))]
    item = lambda f: bytes.fromhex("feff00e0") + len(f).to_bytes(4, "little") + f
    return body + bytes.fromhex("e07f1000") + b"OB\0\0" + b"\xff" * 4 + b"".join(map(item, (table, *fragments))) + bytes.fromhex("feffdde000000000")


@pytest.fixture
def folder(tmp_path):
    zs = [2.0, 0.0, 1.0, 3.0]
    own = [{"PlanePositionSequence": [{"ImagePositionPatient": [0, 0, z]}], "PlaneOrientationSequence": [{"ImageOrientationPatient": AXIAL}]} for z in zs]
    (tmp_path / "native.dcm").write_bytes(dicom.write(slice_of(0, 4, PerFrameFunctionalGroupsSequence=own)))
    (tmp_path / "big.dcm").write_bytes(dicom.write(slice_of(0, 1000, Rows=32, Columns=32, PixelData=np.arange(1000 * 1024, dtype="<u4").astype("<u2").tobytes())))
    frags = [b"ab", b"cdef", b"gh", b"ijklmn"]  # frame 0: two of them
    (tmp_path / "table.dcm").write_bytes(encapsulated(slice_of(0, 3), frags, b"".join(v.to_bytes(4, "little") for v in (0, 22, 32))))
    (tmp_path / "none.dcm").write_bytes(encapsulated(slice_of(0, 3), frags, b""))
    (tmp_path / "pages.tiff").write_bytes(tiff.encode([np.full((4, 5), i, np.uint8) for i in range(3)], None, "none"))
    (tmp_path / "bad.dcm").write_bytes(b"x")
    return tmp_path


def paths_of(spark, folder):
    return spark.createDataFrame([(str(p),) for p in sorted(folder.iterdir())] + [(str(folder / "gone.dcm"),)], "path string")


def test_ranges_of_all_kinds_of_files(spark, folder):
    got = {}
    for r in R.stored_frames(paths_of(spark, folder)).collect():
        got.setdefault(r.path.rpartition("/")[2], []).append(r)
    bytes_of = lambda name, r: b"".join((folder / name).read_bytes()[p.offset : p.offset + p.length] for p in r.parts)
    px = slice_of(0, 4)["PixelData"]
    assert [(r.position, r.frame, r.strategy) for r in got["native.dcm"]] == [(0, 1, "geometry"), (1, 2, "geometry"), (2, 0, "geometry"), (3, 3, "geometry")]
    assert all(bytes_of("native.dcm", r) == px[96 * r.frame : 96 * r.frame + 96] for r in got["native.dcm"])
    assert [bytes_of("table.dcm", r) for r in got["table.dcm"]] == [b"abcdef", b"gh", b"ijklmn"]
    assert [bytes_of("pages.tiff", r) for r in got["pages.tiff"]] == [bytes([i]) * 20 for i in range(3)]
    assert {n: r[0].error_code for n, r in got.items() if r[0].error_code} == {"none.dcm": "INVALID_FRAGMENTS", "bad.dcm": "NOT_DICOM", "gone.dcm": "UNREADABLE"}


@pytest.mark.parametrize("h", [Handler(), Handler("central-slice"), Handler("central-slice", skip_start=1), Handler("max-intensity"), Handler("interpolate", target_frames=1), Handler("interpolate", target_frames=4), Handler("interpolate", target_frames=9)])
def test_shown_frames_are_those_of_the_plan(spark, h):
    orders = {f"f{n}": list(np.random.default_rng(n).permutation(n)) for n in range(1, 8)}
    stored = spark.createDataFrame([(f, int(i), p, len(o)) for f, o in orders.items() for p, i in enumerate(o)], "path string, frame int, position int, n int")
    got = {}
    for r in R.shown_frames(stored, h).orderBy("path", "shown").collect():
        assert r.derived == (r.frame is None) and r.shown == len(got.setdefault(r.path, []))
        got[r.path].append(r.frame)
    assert got == {f: frame_plan(o, h) for f, o in orders.items()}


def test_a_thousand_frames_read_only_their_bytes(spark, folder):
    index = R.stored_frames(paths_of(spark, folder))
    rng = np.random.default_rng(1)
    big, px = str(folder / "big.dcm"), np.arange(1000 * 1024, dtype="<u4").astype("<u2").tobytes()
    asked = [(big, int(i)) for i in rng.integers(0, 1000, 995)] + [(big, 1000), (big, -1), (str(folder / "bad.dcm"), 0), ("/nowhere", 0), (str(folder / "table.dcm"), 1)]
    rows = R.fetch_frames(spark.createDataFrame(asked, "path string, shown int"), index).collect()
    assert sorted((r.path, r.shown) for r in rows) == sorted(asked)
    good = [r for r in rows if r.path == big and not r.error_code]
    assert len(good) == 995 and all(bytes(r.content) == px[2048 * r.shown : 2048 * r.shown + 2048] for r in good)
    assert sum(r.bytes_read for r in good) == 995 * 2048
    assert {(r.path.rpartition("/")[2], r.shown): r.error_code for r in rows if r.error_code} == {("big.dcm", 1000): "FRAME_OUT_OF_RANGE", ("big.dcm", -1): "FRAME_OUT_OF_RANGE", ("bad.dcm", 0): "NOT_DICOM", ("nowhere", 0): "UNKNOWN_FILE"}
    derived = R.fetch_frames(spark.createDataFrame([(big, 0)], "path string, shown int"), index, Handler("max-intensity")).first()
    assert (derived.error_code, derived.content) == ("DERIVED_FRAME", None)
