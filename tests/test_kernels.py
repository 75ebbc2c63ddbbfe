import numpy as np
import pytest

from voxlake.codec import dicom, tiff
from voxlake.codec.tiff import Preparation
from voxlake.config import Handler, Preprocessor, filter_name
from voxlake.errors import ImageError
from voxlake.kernels import images as K
from voxlake.kernels import volumes as V
from voxlake.kernels.resample import FILTERS, weights
from voxlake.operators import prepare as P

AXIAL = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def grid(*rows):
    return np.array([[int(c) for c in r] for r in rows], np.uint8)


def box(*v):
    return K.Box(*v)


def test_crop_boxes():
    centre = grid("0000", "0110", "0110", "0000")
    assert K.crop_box(centre) == box(1, 1, 2, 2)
    assert K.crop_box(np.zeros((4, 4), np.uint8)) == box(0, 0, 4, 4)
    assert K.crop_box(np.ones((4, 4), np.uint8)) == box(0, 0, 4, 4)
    corners = centre.copy()
    corners[0, 0] = corners[3, 3] = 255
    assert K.crop_box(corners, check_max=True) == box(1, 1, 2, 2)
    assert K.crop_box(grid("000000", "001100", "001100", "001100", "001100", "000000"), border=0.2) == box(1, 0, 4, 5)
    ring = np.zeros((6, 6), np.uint8)
    ring[0], ring[5], ring[:, 0], ring[:, 5] = 1, 1, 1, 1
    ring[2:4, 2:4] = 1
    assert K.crop_box(ring, border=0.1) == box(0, 0, 5, 5)
    assert box(1, 1, 2, 2).union(box(2, 2, 2, 2)) == box(1, 1, 3, 3)


def test_components():
    img = np.zeros((8, 8), np.uint8)
    img[1:3, 1:3], img[3:7, 4:7] = 7, 9
    assert K.component_box(img) == box(4, 3, 3, 4)
    big = np.zeros((1024, 1024), np.uint16)
    big[83:911, 101:901] = 1
    assert K.component_box(big) == box(101, 83, 800, 828)
    spiral = grid("1111111", "1000001", "1011101", "1010101", "1010001", "1011111")
    lab = K.label_components(spiral > 0)
    assert set(np.unique(lab)) == {-1, 0}
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.random((9, 11)) < 0.55
        lab = K.label_components(m)
        seen = {}
        for y, x in np.argwhere(m):
            seen.setdefault(lab[y, x], []).append((y, x))
        for label, cells in seen.items():
            todo, got = [cells[0]], {cells[0]}
            while todo:
                y, x = todo.pop()
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= q[0] < 9 and 0 <= q[1] < 11 and m[q] and q not in got:
                        got.add(q)
                        todo.append(q)
            assert got == set(cells) and label == min(y * 11 + x for y, x in cells)


def test_resize():
    blocks = np.kron(np.array([[1, 2], [3, 4]], np.uint8), np.ones((2, 2), np.uint8))
    assert K.resize(blocks, 2, 2, "nearest").tolist() == [[1, 2], [3, 4]]
    assert K.resize(np.arange(1, 17, dtype=np.uint8).reshape(4, 4), 2, 2, "max-pool").tolist() == [[6, 8], [14, 16]]
    assert K.fit_size(8, 4, 4, 4)[2:] == (4, 2)
    for kind in FILTERS:
        for src, dst in ((8, 5), (5, 8), (7, 7), (9, 2)):
            assert np.allclose(weights(src, dst, kind).sum(1), 1)
        assert (K.resize(np.full((9, 7), 500, np.uint16), 4, 5, kind) == 500).all()
    assert K.resize(np.zeros((6, 6, 3), np.uint8), 3, 2, "triangle").shape == (2, 3, 3)


def test_padding():
    ones = np.ones((4, 4), np.uint8)
    assert K.padding_of(ones, 6, 6, "center") == (1, 1, 1, 1)
    assert K.padding_of(np.ones((2, 2), np.uint8), 5, 7, "center") == (1, 2, 2, 3)
    assert K.padding_of(ones, 6, 6, "top-left") == (2, 2, 0, 0)
    assert K.padding_of(grid("1100", "1100", "1100", "1000"), 6, 8) == (0, 0, 2, 4)
    assert K.padding_of(grid("0001", "0011", "0011", "0011"), 6, 8) == (2, 4, 0, 0)
    assert K.pad(ones, (1, 2, 0, 0)).shape == (6, 5)


def test_types():
    assert K.to_u8(np.array([0, 128, 129, 257, 32767, 32768, 65535], np.uint16)).tolist() == [0, 0, 1, 1, 127, 128, 255]
    assert K.convert(np.array([0, 255], np.uint8), "u16").tolist() == [0, 65535]
    with pytest.raises(ValueError):
        K.convert(np.zeros(1, np.uint8), "u4")


def test_volumes():
    a, b = np.full((2, 2), 1000, np.uint16), np.full((2, 2), 2000, np.uint16)
    assert [int(f[0, 0]) for f in V.interpolate([a, b], 3)] == [1000, 1500, 2000]
    assert V.interpolate([a], 5) == [a] and len(V.interpolate([a, b], 1)) == 1
    assert (V.max_intensity([a, b]) == 2000).all()
    with pytest.raises(ImageError) as e:
        V.max_intensity([np.zeros((2, 2)), np.zeros((2, 3))])
    assert e.value.details["frame_index"] == 1
    with pytest.raises(ImageError):
        V.max_intensity([])
    flat = [np.full((8, 8), 20000, np.uint16)] * 12
    assert abs(int(V.laplacian_mip(flat, central="central-slice")[4, 4]) - 20000) <= 1
    assert V.laplacian_mip([a], skip_start=0) is a
    with pytest.raises(ImageError):
        V.laplacian_mip([a, b])  # a side of 2
    with pytest.raises(ImageError):
        V.laplacian_mip(flat, skip_start=6, skip_end=6)


def test_bilateral_against_loops():
    rng = np.random.default_rng(0)
    x = rng.random((9, 8)).astype(np.float32)
    got = V.bilateral(x)
    want = np.zeros_like(x)
    for y in range(9):
        for c in range(8):
            s = n = 0.0
            for dy in range(-6, 7):
                for dx in range(-6, 7):
                    v = x[min(max(y + dy, 0), 8), min(max(c + dx, 0), 7)]
                    w = np.exp(-(dx * dx + dy * dy) / 18) * np.exp(-((v - x[y, c]) ** 2) / (2 * 0.015**2))
                    s, n = s + v * w, n + w
            want[y, c] = s / n
    assert np.abs(got - want).mean() < 0.01
    assert (V.bilateral(np.full((5, 5), 0.5, np.float32)) == 0.5).all()


@pytest.mark.parametrize("kind", ["none", "packbits", "lzw", "deflate"])
def test_tiff_round_trip(kind):
    rng = np.random.default_rng(3)
    done = Preparation((10, 8, True, False), (70, 20, 20, 20), (0.5, 1.5), (1, 2, 3, 4), (1.5, 2.5, None), 2)
    for frames in (
        [rng.integers(0, 65536, (7, 9)).astype(np.uint16) for _ in range(2)], [np.zeros((40, 50), np.uint8)] * 2, [rng.integers(0, 3, (5, 6, 3)).astype(np.uint8) for _ in range(2)], [rng.integers(0, 65536, (90, 70)).astype(np.uint16)] * 2,
    ):
        data = tiff.encode(frames, done, kind)
        t = tiff.Tiff(data)
        assert t.count() == 2 and t.preparation().crop == (70, 20, 20, 20)
        back = t.preparation()
        assert (back.flip, back.resize, back.padding, back.num_frames) == ((10, 8, True, False), (0.5, 1.5), (1, 2, 3, 4), 2)
        assert back.resolution[:2] == (1.5, 2.5)
        assert all((a == b).all() for a, b in zip(tiff.decode(data), frames))
        assert [f.shape for f in tiff.decode(data, [1, 0, 1])] == [frames[0].shape] * 3
    with pytest.raises(ImageError):
        tiff.decode(data, [2])
    with pytest.raises(ImageError):
        tiff.decode(data, [])
    with pytest.raises(ImageError):
        tiff.encode([np.zeros((2, 2), np.float32)])


def test_lzw_widths():
    rng = np.random.default_rng(9)
    for n in (0, 1, 255, 1000, 9000, 60000):
        for top in (2, 256):
            d = rng.integers(0, top, n).astype(np.uint8).tobytes()
            assert tiff.lzw_decode(tiff.lzw_encode(d), n) == d


def slice_of(z, n=1, **more):
    px = (np.arange(n * 48).reshape(n, 6, 8) * 7 % 4096).astype(np.uint16)
    return {
        "SOPClassUID": "1.2", "SOPInstanceUID": f"1.2.3.{z}", "StudyInstanceUID": "1.9", "SeriesInstanceUID": "1.9.1", "Rows": 6, "Columns": 8, "SamplesPerPixel": 1, "PhotometricInterpretation": "MONOCHROME2", "BitsAllocated": 16, "BitsStored": 12,
        "HighBit": 11, "PixelRepresentation": 0, "PixelSpacing": ["0.5", "0.25"], "ImagePositionPatient": [0, 0, z], "ImageOrientationPatient": AXIAL, "InstanceNumber": z + 1, "PixelData": px.tobytes(), **({"NumberOfFrames": n} if n > 1 else {}), **more,
    }


@pytest.mark.parametrize("syntax", [dicom.EXPLICIT, dicom.IMPLICIT])
def test_dicom_round_trip(syntax):
    frames = [{"FrameContentSequence": [{"DimensionIndexValues": [1, v], "StackID": "1"}], "PlanePositionSequence": [{"ImagePositionPatient": [0, 0, z]}]} for v, z in ((3, 2.0), (1, 0.0), (2, 1.0))]
    d = slice_of(0, 3, PerFrameFunctionalGroupsSequence=frames, DimensionIndexSequence=[{"DimensionIndexPointer": "StackID"}, {"DimensionIndexPointer": "InStackPositionNumber"}])
    ds = dicom.parse(dicom.write(d, syntax))
    assert ds.whole("Rows") == 6 and ds.text("PhotometricInterpretation") == "MONOCHROME2" and dicom.frame_count(ds) == 3
    assert (dicom.stored_frame(ds, 1).ravel() == (np.arange(48, 96) * 7 % 4096)).all()
    assert P.order_frames(dicom.frame_rows(ds)) == ("dimension-index", [1, 2, 0], 1.0)
    with pytest.raises(ImageError):
        dicom.stored_frame(ds, 3)
    with pytest.raises(ImageError):
        dicom.parse(b"nothing")
    with pytest.raises(ImageError):
        dicom.parse(dicom.write(d, syntax)[:-400])


def base(n, **cols):
    keys = ("dimension_index", "dimension_pointers", "stack_id", "stack_position", "temporal_position", "image_position", "image_orientation", "vector_value", "slice_location", "spacing_between", "slice_thickness", "organization")
    return [{"frame": i, "sampled": False, **{k: None for k in keys}, **{k: v[i] if isinstance(v, list) else v for k, v in cols.items()}} for i in range(n)]


def places(zs):
    return {"image_position": [[0, 0, z] for z in zs], "image_orientation": [AXIAL] * len(zs)}


def test_frame_order_cases():
    o = P.order_frames
    assert o(base(3, stack_position=[3, 1, 2], spacing_between=1.5)) == ("stack", [1, 2, 0], 1.5)
    assert o(base(3, **places([2, 0, 1]))) == ("geometry", [1, 2, 0], 1.0)
    assert o(base(3, **places([2, 1, 0]))) == ("geometry", [0, 1, 2], 1.0)
    assert o(base(3, sampled=True, **places([2, 0, 1])))[:2] == ("raw", [0, 1, 2])
    assert o(base(3, vector_value=[10.0, 0.0, 5.0])) == ("frame-increment-pointer", [1, 2, 0], 5.0)
    assert o(base(3, slice_location=[10.0, 0.0, 5.0], spacing_between=1.5)) == ("slice-location", [1, 2, 0], 5.0)
    with pytest.raises(ImageError):
        o(base(2, temporal_position=[1, 2]))


def test_preparation_of_a_file():
    data = dicom.write(slice_of(0, 4))
    frames, done, strategy, order, _ = P.prepare_file(data, Preprocessor(size=(16, 16)))
    assert [f.shape for f in frames] == [(16, 16)] * 4 and done.num_frames == 4
    assert done.resolution[0] == pytest.approx(4 * done.resize[0])
    one = P.prepare_file(data, Preprocessor(crop=False, handler=Handler("central-slice")))[0]
    assert len(one) == 1 and (one[0] == P.render_display(data, 2, Preprocessor())).all()
    mip = P.prepare_file(data, Preprocessor(crop=False, handler=Handler("max-intensity")))[0]
    assert len(mip) == 1
    spaced = P.prepare_file(data, Preprocessor(crop=False, spacing=(1.0, 1.0, None)))
    assert spaced[0][0].shape == (3, 2)
    deep = dicom.write(slice_of(0, 10, SliceThickness="5"))
    assert len(P.prepare_file(deep, Preprocessor(crop=False, spacing=(1.0, 1.0, 10.0)))[0]) == 6
    flat = P.resize_tiff(tiff.encode(frames, done), 0.5)
    assert tiff.Tiff(flat).preparation().resize[0] == pytest.approx(done.resize[0] / 2)


def test_voi():
    ds = dicom.parse(dicom.write(slice_of(0, WindowCenter="100", WindowWidth="51")))
    x = dicom.rendered_frame(ds, 0)
    assert x.dtype == np.uint16 and x.min() == 0 and x.max() == 65535
    v = dicom.stored_frame(ds, 0).astype(float)
    assert ((x == 0) == (v <= 74.5)).all()
    n = dicom.rendered_frame(ds, 0, "normalize")
    assert n.min() == 0 and n.max() == 65535


def test_preview_and_flip():
    p = P.preview([np.full((20, 20), 9, np.uint8)], [(3, 12, 4, 15)])
    assert p[4, 3].tolist() == [255, 0, 0] and p[10, 8].tolist() == [9, 9, 9] and p[15, 12].tolist() == [255, 0, 0]
    f = np.zeros((2, 2, 4), np.uint8)
    f[..., 0] = [[1, 2], [3, 4]]
    assert K.flip(f, True, True)[0, 0, 0] == 4 and K.flip(f, True, True)[1, 1, 0] == 1


def test_settings():
    for bad in ({"size": (0, 4)}, {"size": (4, 4), "spacing": (1, 1, None)}, {"spacing": (0, 1, None)}, {"border": 0.6}, {"border": float("nan")}, {"padding": "x"}, {"filter": "x"}, {"voi": "x"}):
        with pytest.raises(ValueError):
            Preprocessor(**bad)
    with pytest.raises(ValueError):
        Handler("interpolate")
    with pytest.raises(ValueError):
        Handler("nothing")
    assert filter_name("maxpool") == "max-pool" and Preprocessor(filter="catmull").filter == "catmull-rom"
