"""A DICOM reader (implicit and explicit little endian, nested sequences, native pixels, RLE, JPEG) and a small writer."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from voxlake.errors import ImageError

from . import jpeg
from .tiff import unpack_bits

IMPLICIT, EXPLICIT, DEFLATED, RLE = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.5"
BIG_ENDIAN = "1.2.840.10008.1.2.2"
JPEG = ("1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.4.51", "1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70")
#: The attributes used here, their tags and value representations.
ATTRIBUTES = {
    "TransferSyntaxUID": (0x0002, 0x0010, "UI"), "MediaStorageSOPClassUID": (0x0002, 0x0002, "UI"), "SOPClassUID": (0x0008, 0x0016, "UI"), "SOPInstanceUID": (0x0008, 0x0018, "UI"), "Modality": (0x0008, 0x0060, "CS"),
    "ViewPosition": (0x0018, 0x5101, "CS"), "SliceThickness": (0x0018, 0x0050, "DS"), "SpacingBetweenSlices": (0x0018, 0x0088, "DS"), "ImagerPixelSpacing": (0x0018, 0x1164, "DS"),
    "VolumetricProperties": (0x0008, 0x9206, "CS"), "StudyInstanceUID": (0x0020, 0x000D, "UI"), "SeriesInstanceUID": (0x0020, 0x000E, "UI"), "InstanceNumber": (0x0020, 0x0013, "IS"), "PatientOrientation": (0x0020, 0x0020, "CS"),
    "ImagePositionPatient": (0x0020, 0x0032, "DS"), "ImageOrientationPatient": (0x0020, 0x0037, "DS"), "FrameOfReferenceUID": (0x0020, 0x0052, "UI"), "Laterality": (0x0020, 0x0060, "CS"), "ImageLaterality": (0x0020, 0x0062, "CS"),
    "SliceLocation": (0x0020, 0x1041, "DS"), "StackID": (0x0020, 0x9056, "SH"), "InStackPositionNumber": (0x0020, 0x9057, "UL"), "TemporalPositionIndex": (0x0020, 0x9128, "UL"), "FrameContentSequence": (0x0020, 0x9111, "SQ"),
    "PlanePositionSequence": (0x0020, 0x9113, "SQ"), "PlaneOrientationSequence": (0x0020, 0x9116, "SQ"), "DimensionIndexValues": (0x0020, 0x9157, "UL"), "DimensionIndexPointer": (0x0020, 0x9165, "AT"),
    "DimensionIndexSequence": (0x0020, 0x9222, "SQ"), "DimensionOrganizationType": (0x0020, 0x9311, "CS"), "SamplesPerPixel": (0x0028, 0x0002, "US"), "PhotometricInterpretation": (0x0028, 0x0004, "CS"), "PlanarConfiguration": (0x0028, 0x0006, "US"),
    "NumberOfFrames": (0x0028, 0x0008, "IS"), "FrameIncrementPointer": (0x0028, 0x0009, "AT"), "Rows": (0x0028, 0x0010, "US"), "Columns": (0x0028, 0x0011, "US"), "PixelSpacing": (0x0028, 0x0030, "DS"),
    "BitsAllocated": (0x0028, 0x0100, "US"), "BitsStored": (0x0028, 0x0101, "US"), "HighBit": (0x0028, 0x0102, "US"), "PixelRepresentation": (0x0028, 0x0103, "US"), "WindowCenter": (0x0028, 0x1050, "DS"), "WindowWidth": (0x0028, 0x1051, "DS"),
    "RescaleIntercept": (0x0028, 0x1052, "DS"), "RescaleSlope": (0x0028, 0x1053, "DS"), "VOILUTFunction": (0x0028, 0x1056, "CS"), "VOILUTSequence": (0x0028, 0x3010, "SQ"), "PixelMeasuresSequence": (0x0028, 0x9110, "SQ"),
    "SharedFunctionalGroupsSequence": (0x5200, 0x9229, "SQ"), "PerFrameFunctionalGroupsSequence": (0x5200, 0x9230, "SQ"), "PixelData": (0x7FE0, 0x0010, "OW"),
}
NAME = {(g, e): n for n, (g, e, _) in ATTRIBUTES.items()}
LONG = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
UNDEFINED = 0xFFFFFFFF
NUMBERS = {"US": "H", "UL": "I", "SS": "h", "SL": "i", "FL": "f", "FD": "d"}


class Dataset(dict):
    """Attribute name (or tag) -> raw bytes, list of Dataset (sequence) or list of bytes (fragments); with each VR."""

    def __init__(self) -> None:
        super().__init__()
        self.vr: dict = {}

    def text(self, name: str) -> str | None:
        v = self.get(name)
        return v.decode("latin-1").strip(" \0\t\r\n") if isinstance(v, bytes) else None

    def numbers(self, name: str) -> list[float] | None:
        """All parts as numbers; None if absent, empty or not numeric."""
        v = self.get(name)
        if not isinstance(v, bytes) or not v:
            return None
        if (f := NUMBERS.get(self.vr.get(name, ""))) is not None:
            return list(struct.unpack(f"<{len(v) // struct.calcsize(f)}{f}", v[: len(v) // struct.calcsize(f) * struct.calcsize(f)]))
        try:
            return [float(p) for p in self.text(name).split("\\") if p.strip()] or None
        except ValueError:
            return None

    def number(self, name: str) -> float | None:
        v = self.numbers(name)
        return v[0] if v else None

    def whole(self, name: str) -> int | None:
        v = self.number(name)
        return int(v) if v is not None and math.isfinite(v) else None

    def items_of(self, name: str) -> list[Dataset]:
        v = self.get(name)
        return v if isinstance(v, list) and all(isinstance(x, Dataset) for x in v) else []

    def tags_of(self, name: str) -> list[str]:
        v = self.get(name)
        return [NAME.get(p, f"({p[0]:04X},{p[1]:04X})") for p in struct.iter_unpack("<HH", v)] if isinstance(v, bytes) and len(v) % 4 == 0 else []


def _at(c: bytes, kinds: str, at: int) -> tuple:
    """Numbers at a place of anything that gives bytes for a slice."""
    return struct.unpack(kinds, c[at : at + struct.calcsize(kinds)])


def _items(c: bytes, at: int, end: int, explicit: bool) -> tuple[list[Dataset], int]:
    out = []
    while at + 8 <= end:
        g, e, n = _at(c, "<HHI", at)
        at += 8
        if (g, e) != (0xFFFE, 0xE000):
            break
        ds, at = _elements(c, at, end if n == UNDEFINED else at + n, explicit)
        out.append(ds)
    return out, at


def _elements(c: bytes, at: int, end: int, explicit: bool, meta: bool = False, spans: bool = False) -> tuple[Dataset, int]:
    ds = Dataset()
    while at + 8 <= end:
        g, e = _at(c, "<HH", at)
        if meta and g != 2:
            break
        if g == 0xFFFE:
            at += 8
            break
        key = NAME.get((g, e), (g, e))
        if explicit:
            vr = c[at + 4 : at + 6].decode("latin-1")
            if vr in LONG:
                (n,), at = _at(c, "<I", at + 8), at + 12
            else:
                (n,), at = _at(c, "<H", at + 6), at + 8
        else:
            vr = ATTRIBUTES[key][2] if isinstance(key, str) else "UN"
            (n,), at = _at(c, "<I", at + 4), at + 8
        ds.vr[key] = vr
        if key == "PixelData" and n == UNDEFINED:
            frags = []
            while at + 8 <= len(c):
                ig, ie, m = _at(c, "<HHI", at)
                at += 8
                if (ig, ie) != (0xFFFE, 0xE000):
                    break
                frags.append(range(at, at + m) if spans else c[at : at + m])
                at += m
            ds[key] = frags
        elif key == "PixelData" and spans:
            if at + n > len(c):
                raise ImageError("TRUNCATED_DICOM", f"{key} ends beyond the file")
            ds[key] = [range(at, at + n)]
            at += n
        elif vr == "SQ" or n == UNDEFINED:
            ds[key], at = _items(c, at, end if n == UNDEFINED else at + n, explicit)
        else:
            if at + n > len(c):
                raise ImageError("TRUNCATED_DICOM", f"{key} ends beyond the file")
            ds[key] = c[at : at + n]
            at += n
    return ds, at


def parse(content: bytes, spans: bool = False) -> Dataset:
    """The dataset with its file meta attributes; spans: pixel data as the ranges of its bytes in the file, which aren't read."""
    if content[128:132] != b"DICM":
        raise ImageError("NOT_DICOM", "no DICM at byte 128")
    try:
        return _parse(content, spans)
    except (struct.error, UnicodeDecodeError, zlib.error, RecursionError) as e:
        raise ImageError("INVALID_DICOM", str(e)) from e


def _parse(content: bytes, spans: bool = False) -> Dataset:
    meta, at = _elements(content, 132, len(content), True, meta=True)
    syntax = meta.text("TransferSyntaxUID") or EXPLICIT
    if syntax == BIG_ENDIAN:
        raise ImageError("UNSUPPORTED_TRANSFER_SYNTAX", syntax)
    if syntax == DEFLATED:
        content, at = zlib.decompress(content[at:], -15), 0  # ranges would be of what was inflated
        spans = False
    ds, _ = _elements(content, at, len(content), syntax != IMPLICIT, spans=spans)
    for k, v in meta.items():
        ds.setdefault(k, v)
        ds.vr.setdefault(k, meta.vr[k])
    return ds


def frame_count(ds: Dataset) -> int:
    """NumberOfFrames; 1 where it is absent or empty, an error where it isn't a count."""
    n = ds.whole("NumberOfFrames")
    if n is None:
        if ds.text("NumberOfFrames"):
            raise ImageError("INVALID_NUMBER_OF_FRAMES", ds.text("NumberOfFrames"))
        return 1
    if n < 0:
        raise ImageError("INVALID_NUMBER_OF_FRAMES", str(n))
    if n > 65535:
        raise ImageError("TOO_MANY_FRAMES", str(n))
    return n


def frame_bytes(ds: Dataset) -> int | None:
    """Bytes of one native frame, or None without a size."""
    rows, cols, n, bits = (ds.whole(k) for k in ("Rows", "Columns", "SamplesPerPixel", "BitsAllocated"))
    return rows * cols * (n or 1) * -(-bits // 8) if rows and cols and bits else None


def _rle(fragment: bytes, size: int, planes: int) -> bytes:
    if len(fragment) < 64:
        raise ImageError("INVALID_RLE", "no segment table")
    head = struct.unpack_from("<16I", fragment)
    if head[0] != planes or any(not 64 <= at <= len(fragment) for at in head[1 : planes + 1]):
        raise ImageError("INVALID_RLE", f"{head[0]} segments for {planes} planes, or one beyond the frame")
    ends = [*head[2 : planes + 1], len(fragment)]
    out = np.empty((size, planes), np.uint8)
    for i in range(planes):
        part = unpack_bits(fragment[head[1 + i] : ends[i]], size)
        if len(part) < size:
            raise ImageError("INVALID_RLE", "a segment ends too early")
        out[:, i] = np.frombuffer(part, np.uint8, size)
    return out.tobytes()


def _fragments(data: list[bytes], i: int, frames: int) -> bytes:
    """The encapsulated bytes of frame i: its own fragment, or those that the offset table gives it."""
    table, parts = data[0] if data else b"", data[1:]
    if i >= frames or not parts:
        raise ImageError("FRAME_OUT_OF_RANGE", f"frame {i}", frame_index=i)
    if frames == 1:
        return b"".join(parts)
    if len(parts) == frames:
        return parts[i]
    offsets = [v for (v,) in struct.iter_unpack("<I", table[: len(table) // 4 * 4])]
    if len(offsets) != frames:
        raise ImageError("INVALID_FRAGMENTS", f"{len(parts)} fragments for {frames} frames without an offset table")
    ends = [*offsets[1:], UNDEFINED]
    out, at = [], 0
    for p in parts:
        if offsets[i] <= at < ends[i]:
            out.append(p)
        at += len(p) + 8
    return b"".join(out)


def _encapsulated(ds: Dataset, data: list[bytes], i: int, rows: int, cols: int, n: int, dtype: np.dtype) -> np.ndarray:
    syntax, frames = ds.text("TransferSyntaxUID"), frame_count(ds)
    if syntax == RLE:
        planes = n * dtype.itemsize
        raw = np.frombuffer(_rle(_fragments(data, i, frames), rows * cols, planes), np.uint8).reshape(rows * cols, n, dtype.itemsize)
        return np.ascontiguousarray(raw[:, :, ::-1]).view(dtype).reshape(rows, cols, n)
    if syntax not in JPEG:
        raise ImageError("UNSUPPORTED_TRANSFER_SYNTAX", syntax or "")
    img = jpeg.decode(_fragments(data, i, frames), rgb=ds.text("PhotometricInterpretation") == "RGB")
    img = img.reshape(*img.shape[:2], -1)
    if img.shape != (rows, cols, n) or img.itemsize > dtype.itemsize:
        raise ImageError("INVALID_JPEG", f"an image of {img.shape} for {(rows, cols, n)}")
    return img.astype(f"<u{dtype.itemsize}").view(dtype)


def stored_frame(ds: Dataset, i: int) -> np.ndarray:
    """Stored samples of frame i, as integers of their type; (rows, columns) or (rows, columns, samples)."""
    rows, cols, n, bits = (ds.whole(k) for k in ("Rows", "Columns", "SamplesPerPixel", "BitsAllocated"))
    n = n or 1
    if not rows or not cols or bits not in (8, 16):
        raise ImageError("INVALID_HEADER", "rows, columns and 8 or 16 bits are needed")
    signed = ds.whole("PixelRepresentation") == 1
    dtype = np.dtype(f"<{'i' if signed else 'u'}{bits // 8}")
    data = ds.get("PixelData")
    if isinstance(data, list):
        img = _encapsulated(ds, data, i, rows, cols, n, dtype)
    else:
        size = rows * cols * n * dtype.itemsize
        if not isinstance(data, bytes) or (i + 1) * size > len(data):
            raise ImageError("FRAME_OUT_OF_RANGE", f"frame {i}", frame_index=i)
        img = np.frombuffer(data, dtype, rows * cols * n, i * size)
        planar = n > 1 and ds.whole("PlanarConfiguration") == 1
        img = np.moveaxis(img.reshape(n, rows, cols), 0, 2) if planar else img.reshape(rows, cols, n)
    stored = ds.whole("BitsStored") or bits
    if stored < bits and not signed:
        img = img & dtype.type((1 << stored) - 1)
    return img[:, :, 0] if n == 1 else img


def rendered_frame(ds: Dataset, i: int, voi: str | tuple[float, float] = "default") -> np.ndarray:
    """Frame i as u8 or u16 over the full range: rescale, then a window (LINEAR) or the frame's own range.

    voi: "default" (the file's first window, else the range), "normalize" (the range), or (centre, width).
    """
    x = stored_frame(ds, i)
    out = np.uint8 if ds.whole("BitsAllocated") == 8 else np.uint16
    top = float(np.iinfo(out).max)
    if x.ndim == 3:
        return x.astype(out)
    slope, intercept = ds.number("RescaleSlope"), ds.number("RescaleIntercept")
    v = x.astype(np.float64) * (1.0 if slope is None else slope) + (0.0 if intercept is None else intercept)
    if isinstance(voi, tuple):
        centre, width = voi
    else:
        centre, width = (ds.number("WindowCenter"), ds.number("WindowWidth")) if voi == "default" else (None, None)
    if centre is not None and width is not None and width >= 1:
        c, w = centre - 0.5, max(width - 1, 1e-9)
        y = np.where(v <= c - w / 2, 0, np.where(v > c + w / 2, top, ((v - c) / w + 0.5) * top))
    else:
        low, high = v.min(), v.max()
        y = (v - low) / (high - low) * top if high > low else np.zeros_like(v)
    if ds.text("PhotometricInterpretation") == "MONOCHROME1":
        y = top - y
    return np.clip(y, 0, top).astype(out)


# ---------------------------------------------------------------- frames and header rows


def frame_rows(ds: Dataset) -> list[dict]:
    """Ordering columns of each frame: its own group, else the shared one, else the top level."""
    n = frame_count(ds)
    shared = (ds.items_of("SharedFunctionalGroupsSequence") or [Dataset()])[0]
    own = ds.items_of("PerFrameFunctionalGroupsSequence")
    pointers = [p for item in ds.items_of("DimensionIndexSequence") for p in item.tags_of("DimensionIndexPointer")]
    vector = (ds.tags_of("FrameIncrementPointer") or [None])[0]
    values = ds.numbers(vector) if vector else None
    out = []
    for i in range(n):
        f = own[i] if i < len(own) else Dataset()

        def group(seq, attr, f=f):
            for d in (f, shared):
                for item in d.items_of(seq):
                    if (v := item.numbers(attr)) is not None:
                        return v
            return ds.numbers(attr)

        content = (f.items_of("FrameContentSequence") or [Dataset()])[0]
        one = lambda v: v[0] if v else None
        pos, ori = group("PlanePositionSequence", "ImagePositionPatient"), group("PlaneOrientationSequence", "ImageOrientationPatient")
        dim = content.numbers("DimensionIndexValues")
        out.append({
            "frame": i, "dimension_index": [int(v) for v in dim] if dim else None, "dimension_pointers": pointers or None, "stack_id": content.text("StackID"),
            "stack_position": content.whole("InStackPositionNumber"), "temporal_position": content.whole("TemporalPositionIndex"),
            "image_position": pos if pos and len(pos) == 3 else None, "image_orientation": ori if ori and len(ori) == 6 else None, "sampled": (ds.text("VolumetricProperties") or "").upper() == "SAMPLED",
            "vector_value": values[i] if values and len(values) == n else None, "slice_location": ds.number("SliceLocation") if n == 1 else one(f.numbers("SliceLocation")),
            "spacing_between": one(group("PixelMeasuresSequence", "SpacingBetweenSlices")), "slice_thickness": one(group("PixelMeasuresSequence", "SliceThickness")), "organization": ds.text("DimensionOrganizationType"),
        })
    return out


def header_row(ds: Dataset) -> dict:
    """The flat header columns that validation and naming use; attributes stay text where they are numbers."""
    text = {n: _plain(ds, n) for n, (_, _, vr) in ATTRIBUTES.items() if vr not in ("SQ", "OW", "AT")}
    data = ds.get("PixelData")
    spacing = ds.numbers("PixelSpacing") if "PixelSpacing" in ds else ds.numbers("ImagerPixelSpacing")
    if not spacing:
        for g in (*ds.items_of("SharedFunctionalGroupsSequence"), *ds.items_of("PerFrameFunctionalGroupsSequence")[:1]):
            for m in g.items_of("PixelMeasuresSequence"):
                spacing = spacing or m.numbers("PixelSpacing")
    voi = ds.get("VOILUTSequence")
    return text | {
        "PixelSpacing": spacing if spacing and len(spacing) >= 2 else None, "PixelDataLength": len(data) if isinstance(data, bytes) else sum(map(len, data)) if data is not None else None,
        "VOILUTSequenceItems": len(voi) if isinstance(voi, list) else None, "present": [n for n in ds if isinstance(n, str)],
    }


def _plain(ds: Dataset, name: str) -> str | None:
    if ds.vr.get(name) in NUMBERS:
        v = ds.numbers(name)
        return "\\".join(str(int(x) if float(x).is_integer() else x) for x in v) if v else None
    return ds.text(name)


# ---------------------------------------------------------------- writing (native, little endian)


def _value(vr: str, v, explicit: bool) -> bytes:
    if isinstance(v, bytes):
        out = v
    elif vr == "SQ":
        out = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(b := _body(d, explicit))) + b for d in v)
    elif vr == "AT":
        out = b"".join(struct.pack("<HH", *ATTRIBUTES[n][:2]) for n in ([v] if isinstance(v, str) else v))
    elif vr in NUMBERS:
        v = v if isinstance(v, (list, tuple)) else [v]
        out = struct.pack(f"<{len(v)}{NUMBERS[vr]}", *v)
    else:
        out = ("\\".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)).encode("latin-1")
    return out + (b"\0" if vr in ("UI", "OB", "OW") else b" ") * (len(out) % 2)


def _body(attrs: dict, explicit: bool) -> bytes:
    out = b""
    for name in sorted(attrs, key=lambda n: ATTRIBUTES[n][:2]):
        g, e, vr = ATTRIBUTES[name]
        if name == "PixelData" and isinstance(attrs[name], list):
            items = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(p := f + b"\0" * (len(f) % 2))) + p for f in attrs[name])
            out += struct.pack("<HH2sHI", g, e, b"OB", 0, UNDEFINED) + items + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
            continue
        v = _value(vr, attrs[name], explicit)
        if not explicit:
            head = struct.pack("<HHI", g, e, len(v))
        elif vr in LONG:
            head = struct.pack("<HH2sHI", g, e, vr.encode(), 0, len(v))
        else:
            head = struct.pack("<HH2sH", g, e, vr.encode(), len(v))
        out += head + v
    return out


def write(attrs: dict, syntax: str = EXPLICIT) -> bytes:
    """A file from attribute values; sequences are lists of such dicts."""
    meta = _body({"TransferSyntaxUID": syntax, **{k: v for k, v in attrs.items() if ATTRIBUTES[k][0] == 2}}, True)
    body = _body({k: v for k, v in attrs.items() if ATTRIBUTES[k][0] != 2}, syntax != IMPLICIT)
    return b"\0" * 128 + b"DICM" + meta + body
