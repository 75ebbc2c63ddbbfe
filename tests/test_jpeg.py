"""JPEG and malformed files: own encoders make the fixtures."""

import struct

import numpy as np
import pytest

from tests.test_kernels import slice_of
from voxlake import jobs
from voxlake.codec import dicom, jpeg, tiff
from voxlake.config import Handler, Preprocessor
from voxlake.errors import ImageError
from voxlake.operators import prepare
from voxlake.sources import files as S


class Writer:
    """Bits with stuffing; every symbol has a code of 8 bits."""

    def __init__(self):
        self.bits = ""

    def put(self, value, size):
        self.bits += format(value, f"0{size}b") if size else ""

    def number(self, v):
        size = int(abs(v)).bit_length()
        self.put(v if v >= 0 else v + (1 << size) - 1, size)

    def done(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def table(kind, symbols):
    return segment(0xC4, bytes([kind]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))


def baseline(planes, factors, rows, cols, quant=1, restart=0, names=None, extra=b""):
    """planes: samples of each component at its own size, multiples of its blocks."""
    dc, ac = list(range(12)), [0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    hm, vm = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-cols // (8 * hm)), -(-rows // (8 * vm))
    out, w, last, n = b"", Writer(), [0] * len(planes), 0
    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            out += w.done() + bytes([0xFF, 0xD0 + n % 8])
            w, last, n = Writer(), [0] * len(planes), n + 1
        my, mx = divmod(mcu, across)
        for c, (plane, (h, v)) in enumerate(zip(planes, factors)):
            for i in range(v):
                for j in range(h):
                    y, x = (my * v + i) * 8, (mx * h + j) * 8
                    f = jpeg.BASIS @ (plane[y : y + 8, x : x + 8].astype(float) - 128) @ jpeg.BASIS.T
                    z = np.round(f / quant).astype(int).ravel()[jpeg.ZIGZAG]
                    d, last[c] = int(z[0]) - last[c], int(z[0])
                    w.put(dc.index(abs(d).bit_length()), 8)
                    w.number(d)
                    run = 0
                    for k in range(1, 64):
                        if not z[k]:
                            run += 1
                            continue
                        while run > 15:
                            w.put(ac.index(0xF0), 8)
                            run -= 16
                        w.put(ac.index(run << 4 | int(abs(z[k])).bit_length()), 8)
                        w.number(int(z[k]))
                        run = 0
                    if run:
                        w.put(ac.index(0), 8)
    names = names or range(1, len(planes) + 1)
    sof = struct.pack(">BHHB", 8, rows, cols, len(planes)) + b"".join(bytes([n, h << 4 | v, 0]) for n, (h, v) in zip(names, factors))
    sos = bytes([len(planes)]) + b"".join(bytes([n, 0]) for n in names) + bytes([0, 63, 0])
    head = b"\xff\xd8" + extra + segment(0xDB, bytes([0] + [quant] * 64)) + segment(0xC0, sof) + table(0, dc) + table(0x10, ac)
    return head + (segment(0xDD, struct.pack(">H", restart)) if restart else b"") + segment(0xDA, sos) + out + w.done() + b"\xff\xd9"


def lossless(x, bits, select=1, restart_rows=0, shift=0):
    x = x if x.ndim == 3 else x[:, :, None]
    rows, cols, n = x.shape
    out, w, k = b"", Writer(), 0
    v = x.astype(int) >> shift
    for y in range(rows):
        begin = y == 0 or restart_rows and y % restart_rows == 0
        if y and begin:
            out += w.done() + bytes([0xFF, 0xD0 + k % 8])
            w, k = Writer(), k + 1
        for i in range(cols):
            for c in range(n):
                a, b, d = (v[y, i - 1, c] if i else 0), (v[y - 1, i, c] if y else 0), (v[y - 1, i - 1, c] if y and i else 0)
                if begin:
                    p = a if i else 1 << (bits - shift - 1)
                elif not i:
                    p = b
                else:
                    p = (a, b, d, a + b - d, a + ((b - d) >> 1), b + ((a - d) >> 1), (a + b) >> 1)[select - 1]
                e = (int(v[y, i, c]) - int(p) + 32768) % 65536 - 32768
                size = 16 if e == -32768 else abs(e).bit_length()
                w.put(size, 8)
                if size < 16:
                    w.number(e)
    sof = struct.pack(">BHHB", bits, rows, cols, n) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(n))
    sos = bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([select, 0, shift])
    head = b"\xff\xd8" + segment(0xC3, sof) + table(0, list(range(17)))
    return head + (segment(0xDD, struct.pack(">H", restart_rows * cols)) if restart_rows else b"") + segment(0xDA, sos) + out + w.done() + b"\xff\xd9"


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-1] == 63 and len(set(jpeg.ZIGZAG)) == 64


def smooth(rows, cols, k=0):
    y, x = np.mgrid[:rows, :cols]
    return (127 + 60 * np.sin(x / 5 + k) + 50 * np.cos(y / 7 - k)).astype(np.uint8)


@pytest.mark.parametrize("restart", [0, 2])
def test_baseline(restart):
    g = smooth(16, 24)
    got = jpeg.decode(baseline([g], [(1, 1)], 13, 21, restart=restart))
    assert got.shape == (13, 21) and np.abs(got.astype(int) - g[:13, :21]).max() <= 1
    rgb = [smooth(16, 24, k) for k in range(3)]
    for extra, names in ((segment(0xEE, b"Adobe\0\0\0\0\0\0\0"), None), (b"", b"RGB")):
        got = jpeg.decode(baseline(rgb, [(1, 1)] * 3, 16, 24, restart=restart, names=names, extra=extra))
        assert np.abs(got.astype(int) - np.stack(rgb, -1)).max() <= 1
    cb, cr = np.full((8, 16), 90, np.uint8), np.full((8, 16), 170, np.uint8)
    y = smooth(16, 32)
    got = jpeg.decode(baseline([y, cb, cr], [(2, 2), (1, 1), (1, 1)], 15, 30, restart=restart)).astype(int)
    want = np.clip(np.stack((y + 1.402 * 42, y + 0.344136 * 38 - 0.714136 * 42, y - 1.772 * 38), -1), 0, 255)[:15, :30]
    assert np.abs(got - want).max() <= 2


@pytest.mark.parametrize("select", range(1, 8))
def test_lossless(select):
    rng = np.random.default_rng(select)
    for bits, dtype in ((8, np.uint8), (12, np.uint16), (16, np.uint16)):
        x = rng.integers(0, 1 << bits, (9, 11)).astype(dtype)
        assert (jpeg.decode(lossless(x, bits, select)) == x).all()
        assert (jpeg.decode(lossless(x, bits, select, restart_rows=4)) == x).all()
    x = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (jpeg.decode(lossless(x, 8, select)) == x).all()
    x = rng.integers(0, 256, (5, 7)).astype(np.uint8) & 0xFC
    assert (jpeg.decode(lossless(x, 8, select, shift=2)) == x).all()


def test_malformed_jpeg():
    good = lossless(np.arange(64, dtype=np.uint8).reshape(8, 8), 8)
    for bad in (b"", b"\xff\xd8", good[: len(good) // 2], good.replace(b"\xff\xc3", b"\xff\xc9"), b"\xff\xd8\x00" + good[2:]):
        with pytest.raises(ImageError):
            jpeg.decode(bad)


def files(x, syntax, fragments, **more):
    rows, cols = x.shape[-2:]
    attrs = slice_of(0, Rows=rows, Columns=cols, BitsAllocated=16, BitsStored=12, HighBit=11, PixelData=fragments, **more)
    return dicom.write(attrs, syntax)


def test_encapsulated_frames():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4096, (3, 6, 5)).astype(np.uint16)
    parts = [lossless(f, 12) for f in x]
    whole = dicom.parse(files(x, dicom.JPEG[3], [b"", *parts], NumberOfFrames=3))
    cut, offsets, at = [], [], 0
    for p in parts:
        offsets.append(at)
        for piece in (p[:40], p[40:]):
            cut.append(piece)
            at += len(piece) + len(piece) % 2 + 8
    split = dicom.parse(files(x, dicom.JPEG[2], [struct.pack("<3I", *offsets), *cut], NumberOfFrames=3))
    one = dicom.parse(files(x[:1], dicom.JPEG[2], [b"", parts[0][:40], parts[0][40:]]))
    for i in range(3):
        assert (dicom.stored_frame(whole, i) == x[i]).all() and (dicom.stored_frame(split, i) == x[i]).all()
    assert (dicom.stored_frame(one, 0) == x[0]).all()
    with pytest.raises(ImageError, match="FRAME_OUT_OF_RANGE"):
        dicom.stored_frame(whole, 3)
    with pytest.raises(ImageError, match="INVALID_FRAGMENTS"):
        dicom.stored_frame(dicom.parse(files(x, dicom.JPEG[2], [b"", *cut], NumberOfFrames=3)), 0)


def broken_files():
    x = np.arange(30, dtype=np.uint16).reshape(1, 6, 5)
    return {
        "big": (files(x, dicom.BIG_ENDIAN, x.tobytes()), "UNSUPPORTED_TRANSFER_SYNTAX"),
        "j2k": (files(x, "1.2.840.10008.1.2.4.90", [b"", b"ab"]), "UNSUPPORTED_TRANSFER_SYNTAX"),
        "jpeg": (files(x, dicom.JPEG[2], [b"", b"ab"]), "INVALID_JPEG"),
        "size": (files(x, dicom.JPEG[2], [b"", lossless(x[0, :3], 12)]), "INVALID_JPEG"),
        "none": (files(x, dicom.RLE, [b""]), "FRAME_OUT_OF_RANGE"),
        "rle": (files(x, dicom.RLE, [b"", b"ab"]), "INVALID_RLE"),
        "table": (files(x, dicom.RLE, [b"", struct.pack("<16I", 2, 64, 9999, *[0] * 13) + b"ab"]), "INVALID_RLE"),
        "frames": (files(x, dicom.EXPLICIT, x.tobytes(), NumberOfFrames="abc"), "INVALID_NUMBER_OF_FRAMES"),
        "short": (files(x, dicom.EXPLICIT, x.tobytes()[:8]), "FRAME_OUT_OF_RANGE"),
        "cut": (files(x, dicom.EXPLICIT, x.tobytes())[:-7], "TRUNCATED_DICOM"),
        "not": (b"x" * 200, "NOT_DICOM"),
    }


def test_broken_files_end_no_job(spark, tmp_path):
    cases = broken_files()
    for name, (content, _) in cases.items():
        (tmp_path / f"{name}.dcm").write_bytes(content)
    (tmp_path / "good.dcm").write_bytes(files(np.ones((1, 6, 5), np.uint16), dicom.EXPLICIT, np.ones((6, 5), "<u2").tobytes()))
    found = S.scan(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2][:-4]: r.error_code for r in prepare.preprocess(found, Preprocessor(crop=False)).collect()}
    assert got == {"good": None, **{n: code for n, (_, code) in cases.items()}}
    tried = {r.path.rpartition("/")[2][:-4]: r for r in prepare.decode_checks(found).collect()}
    assert tried["good"].decoded and tried["good"].expected_bytes == 60 and not any(tried[n].decoded for n in cases if n != "frames")
    plans = prepare.frame_plans(found, Handler("central-slice")).collect()
    assert sum(r.error_code is None for r in plans) == 8


def test_masked_bits():
    x = np.array([[0xF123, 0x0FFF], [0x8000, 1]], "<u2")
    planes = [x.tobytes()] * 3
    rgb = dicom.parse(dicom.write(slice_of(0, Rows=2, Columns=2, SamplesPerPixel=3, PhotometricInterpretation="RGB", PlanarConfiguration=1, BitsAllocated=16, BitsStored=12, HighBit=11, PixelData=b"".join(planes))))
    assert (dicom.stored_frame(rgb, 0) == (x & 0xFFF)[:, :, None]).all()


def test_decode_outcome_is_a_finding(spark, tmp_path):
    good = slice_of(0)
    (tmp_path / "good.dcm").write_bytes(dicom.write(good))
    (tmp_path / "short.dcm").write_bytes(dicom.write({**good, "PixelData": good["PixelData"][:4]}))
    (tmp_path / "bad.dcm").write_bytes(dicom.write({**good, "BitsStored": 17}))
    from voxlake.operators.validation import report_text

    rows = {r.path.rpartition("/")[2][:-4]: r for r in report_text(jobs.run_validate(spark, str(tmp_path))).collect()}
    codes = {n: {f.code for f in r.findings} for n, r in rows.items()}
    assert "frame_decoded" in codes["good"] and rows["good"].valid and rows["good"].text.startswith("PASS")
    assert "frame_decode_failed" in codes["short"] and rows["short"].n_errors == 1 and not rows["short"].valid and '"error_count":1' in rows["short"].report
    assert "frame_decode_skipped" in codes["bad"] and "invalid_bits_stored" in rows["bad"].text
    off = jobs.run_validate(spark, str(tmp_path), decode=False).where("valid").count()
    assert off == 2


def test_series_job_and_channel_mismatch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for i, z in enumerate((2, 0, 1)):
        (src / f"{i}.dcm").write_bytes(dicom.write(slice_of(z)))
    (src / "other.dcm").write_bytes(dicom.write(slice_of(0, SeriesInstanceUID="7.7")))
    (src / "again.dcm").write_bytes(dicom.write(slice_of(0, SeriesInstanceUID="7.7")))
    done = jobs.run_series(spark, str(src), str(out), Preprocessor(crop=False)).collect()
    assert sorted((r.path.rpartition("/")[2], r.error) for r in done) == [("1.2.3.0.tiff", None), ("again.dcm", "duplicate_position"), ("other.dcm", "duplicate_position")]
    (made,) = out.rglob("*.tiff")
    stack = tiff.Tiff(made.read_bytes())
    assert stack.count() == 3 and stack.preparation().num_frames == 3
    (out / "rgb.tiff").write_bytes(tiff.encode([np.zeros((4, 4, 3), np.uint8)]))
    with pytest.raises(ImageError, match="CHANNEL_MISMATCH"):
        jobs.run_stats(spark, str(out))


def test_previews(spark, tmp_path):
    src = tmp_path / "t"
    src.mkdir()
    (src / "a.tiff").write_bytes(tiff.encode([np.full((60, 80), 9, np.uint8)]))
    csv = tmp_path / "t.csv"
    csv.write_text("sop_instance_uid,trace_hash,x_min,x_max,y_min,y_max\na,1,10,30,20,40\n")
    jobs.run_traces(spark, str(src), str(csv), previews=str(tmp_path / "p")).collect()
    picture = tiff.decode((tmp_path / "p" / "a.tiff").read_bytes())[0]
    assert picture.shape == (60, 80, 3) and tuple(picture[20, 10]) == (255, 0, 0) and tuple(picture[30, 20]) == (9, 9, 9)


def test_display_rows(spark, tmp_path):
    (tmp_path / "a.dcm").write_bytes(dicom.write(slice_of(0)))
    (tmp_path / "b.dcm").write_bytes(b"x" * 300)
    rows = {r.path.rpartition("/")[2]: r for r in prepare.render_displays(S.scan(spark, str(tmp_path))).collect()}
    want = prepare.render_display((tmp_path / "a.dcm").read_bytes(), 0)
    assert (prepare.to_numpy(rows["a.dcm"]) == want).all() and rows["b.dcm"].error_code == "NOT_DICOM"
    assert prepare.frame_plan([2, 0, 1], Handler("interpolate", target_frames=5)) == [2, None, 0, None, 1]
    assert prepare.stored_of([2, None], 0) == 2
    with pytest.raises(ImageError, match="DERIVED_FRAME"):
        prepare.stored_of([2, None], 1)
