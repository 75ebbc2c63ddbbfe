"""Series written page by page against series prepared whole."""

import numpy as np
import pyarrow as pa
import pytest

from tests.test_kernels import slice_of
from voxlake import jobs
from voxlake.codec import dicom, tiff
from voxlake.config import Handler, Preprocessor
from voxlake.operators import prepare, series
from voxlake.sources import files as S


def picture(z, side=24):
    rng = np.random.default_rng(z)
    image = np.zeros((side, side), "<u2")
    image[3 : 15 + z % 5, 4 : 20 - z % 3] = rng.integers(1, 4000, (12 + z % 5, 16 - z % 3))
    return image


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for z in (3, 0, 4, 1, 2, 5, 6):
        (src / f"f{z}.dcm").write_bytes(dicom.write(slice_of(z, Rows=24, Columns=24, PixelData=picture(z).tobytes(), PixelSpacing="0.5\\0.25")))
    (src / "alone.dcm").write_bytes(dicom.write(slice_of(9, SeriesInstanceUID="5.5", SOPInstanceUID="5.5.1", Rows=24, Columns=24, PixelData=picture(9).tobytes())))
    return src


SETTINGS = [
    Preprocessor(),
    Preprocessor(crop=False, size=(16, 12), padding="zero"),
    Preprocessor(size=(40, 30), padding="center", filter="nearest"),
    Preprocessor(components=True, border=0.1),
    Preprocessor(spacing=(1.0, 1.0, 2.0)),
    Preprocessor(handler=Handler("central-slice")),
    Preprocessor(handler=Handler("max-intensity", 1, 2)),
    Preprocessor(handler=Handler("interpolate", target_frames=10), size=(20, 20)),
    Preprocessor(handler=Handler("laplacian-mip", 1, 1, projection="central-slice")),
    Preprocessor(handler=Handler("laplacian-mip")),
]


@pytest.mark.parametrize("cfg", SETTINGS, ids=lambda c: f"{c.handler.kind}-{c.size}-{c.spacing}-{c.components}")
def test_files_are_those_of_whole_series(spark, folder, tmp_path, cfg):
    out = tmp_path / "out"
    done = jobs.run_series(spark, str(folder), str(out), cfg).collect()
    order = jobs.run_order(spark, str(folder)).where("error is null")
    files = S.find_dicoms(spark, str(folder)).join(order.select("series", "path", "position", "spacing"), "path")
    want = {r.sop_instance_uid: r for r in prepare.preprocess_series(files, cfg, spacing="spacing", compression="packbits").collect()}
    errors = {r.error_code for r in want.values() if r.error_code}
    assert {r.error for r in done if r.error} == errors
    assert sum(r.error is None for r in done) == sum(r.error_code is None for r in want.values()) > 0
    for r in done:
        if r.error is None:
            path = r.path.removeprefix("file://")
            with open(path, "rb") as f:
                have = tiff.Tiff(f.read())
            other = tiff.Tiff(want[path.rpartition("/")[2].removesuffix(".tiff")].tiff)
            assert have.count() == other.count() and have.preparation() == other.preparation()
            assert all((have.frame(i) == other.frame(i)).all() for i in range(have.count()))


def test_errors_name_their_input(spark, folder, tmp_path):
    good = (folder / "f4.dcm").read_bytes()
    (folder / "f4.dcm").write_bytes(good[:-40])
    order = spark.createDataFrame([("a", z, f"file:{folder}/f{z}.dcm", None) for z in range(7)] + [("b", 0, f"file:{folder}/gone.dcm", None), (None, 0, f"file:{folder}/alone.dcm", None)], "series string, position long, path string, spacing double")
    got = {r.path.rpartition("/")[2]: r for r in series.write_series(order, f"{tmp_path}/out").collect()}
    assert got["f0.dcm"].error == "TRUNCATED_DICOM" and got["f0.dcm"].message.startswith("input 4:")
    assert got["gone.dcm"].error == "UNREADABLE" and got["5.5.1.tiff"].error is None
    mixed = spark.createDataFrame([("a", 0, f"file:{folder}/f0.dcm", None), ("a", 1, f"file:{folder}/small.dcm", None)], order.schema)
    (folder / "small.dcm").write_bytes(dicom.write(slice_of(1)))
    assert [r.error for r in series.write_series(mixed, f"{tmp_path}/out2").collect()] == ["INCOMPATIBLE_FRAMES"]
    gone = Preprocessor(handler=Handler("max-intensity", 5, 5))
    rows = spark.createDataFrame([("a", z, f"file:{folder}/f{z}.dcm", None) for z in range(3)], order.schema)
    assert [r.error for r in series.write_series(rows, f"{tmp_path}/out3", gone).collect()] == ["EMPTY_VOLUME"]
    assert series.write_series(rows.limit(0), f"{tmp_path}/out4").collect() == []


def test_pages_are_written_as_they_come(tmp_path):
    """The writer never reads further than the page it writes."""
    names = ["target", "path", "height", "width", "channels", "dtype", "data", "pages", "crop", "turned", "scale", "resolution"]
    image = picture(1)
    taken = []

    def batches():
        for i in range(300):
            taken.append(i)
            row = [f"{tmp_path}/a.tiff", "p", *series.fields_of(image), 300, None, None, None, None]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)

    writer = series.StackWriter(str(tmp_path), f"{tmp_path}/_reports/x", names, Preprocessor(), "none")
    for _, parts in writer.contents(batches()):
        for n, _ in enumerate(parts):
            assert len(taken) == n + 1
    assert len(taken) == 300
