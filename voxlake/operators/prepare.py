"""From DICOM bytes to prepared frames, arrays or TIFF files.

One row a file in, one row a file out, in Arrow batches; `series` gathers the
single-frame files of a series (in the order of `series_order`) and prepares them
together. Errors become columns unless the settings are strict.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.codec import dicom, tiff
from voxlake.codec.tiff import Preparation
from voxlake.config import Handler, Preprocessor
from voxlake.errors import ImageError, typed
from voxlake.functions.arrow import schema_of, to_batches
from voxlake.kernels import images as K
from voxlake.kernels import volumes as V

OUT = (
    "path string, study_instance_uid string, series_instance_uid string, sop_instance_uid string, shape array<int>, dtype string, data binary, tiff binary, strategy string, order array<int>, "
    "crop array<int>, scale array<float>, padding array<int>, flip boolean, resolution array<float>, num_frames int, error_code string, error_message string"
)


# ---------------------------------------------------------------- order of frames, plain form


def _unique(v: list[float]) -> bool:
    s = sorted(v)
    return all(b - a > 1e-4 for a, b in zip(s, s[1:]))


def _by_value(v: list[float]) -> list[int]:
    up = any(b - a > 1e-4 for a, b in zip(v, v[1:]))
    down = any(b - a < -1e-4 for a, b in zip(v, v[1:]))
    return list(range(len(v))) if up != down else sorted(range(len(v)), key=lambda i: (v[i], i))


def _normal(o: list[float]) -> np.ndarray:
    n = np.cross(o[:3], o[3:])
    size = np.linalg.norm(n)
    if size == 0:
        raise ImageError("ZERO_NORMAL", "row and column directions are parallel")
    return n / size


def _gap(v: Iterable[float]) -> float | None:
    v = list(v)
    gaps = sorted(abs(b - a) for a, b in zip(v, v[1:]) if abs(b - a) > 1e-4)
    return gaps[len(gaps) // 2] if gaps else None


def order_frames(rows: list[dict]) -> tuple[str, list[int], float | None]:
    """(strategy, order, spacing) of one file's frames; the relational form is operators.ordering.frame_order."""
    n = len(rows)
    if n <= 1:
        return "raw", list(range(n)), None
    col = lambda c: [r[c] for r in rows]
    if rows[0]["organization"] == "3D_TEMPORAL" or len({t for t in col("temporal_position") if t is not None}) > 1 or len({s for s in col("stack_id") if s is not None}) > 1:
        raise ImageError("MULTI_VOLUME", "more than one volume in a file")
    pointers = rows[0]["dimension_pointers"] or []
    stated = next((s for r in rows if (s := r["spacing_between"] if r["spacing_between"] is not None else r["slice_thickness"]) is not None), None)

    def along(order):
        if any(r["sampled"] or r["image_position"] is None for r in rows) or rows[order[0]]["image_orientation"] is None:
            return stated
        try:
            axis = _normal(rows[order[0]]["image_orientation"])
        except ImageError:
            return stated
        got = _gap(float(np.dot(rows[i]["image_position"], axis)) for i in order)
        return got if got is not None else stated

    if pointers and all(len(d or ()) == len(pointers) for d in col("dimension_index")):
        for k, p in enumerate(pointers):
            if len({d[k] for d in col("dimension_index")}) > 1 and p not in ("InStackPositionNumber", "ImagePositionPatient", "SliceLocation"):
                raise ImageError("MULTI_VOLUME", f"{p} varies")
        order = sorted(range(n), key=lambda i: (rows[i]["dimension_index"], i))
        return "dimension-index", order, along(order)
    if all(p is not None for p in col("stack_position")) and len(set(col("stack_position"))) == n:
        order = sorted(range(n), key=lambda i: rows[i]["stack_position"])
        return "stack", order, along(order)
    if not any(r["sampled"] or r["image_position"] is None or r["image_orientation"] is None for r in rows):
        ref = _normal(rows[0]["image_orientation"])
        if all(1 - abs(float(np.dot(ref, _normal(o)))) <= 1e-4 for o in col("image_orientation")):
            v = [float(np.dot(p, ref)) for p in col("image_position")]
            if _unique(v):
                order = _by_value(v)
                return "geometry", order, along(order)
    for name, c in (("frame-increment-pointer", "vector_value"), ("slice-location", "slice_location")):
        v = col(c)
        if all(x is not None for x in v) and _unique(v):
            order = _by_value(v)
            return name, order, _gap(v[i] for i in order)
    return "raw", list(range(n)), stated


# ---------------------------------------------------------------- preparing frames


def needs_flip(ds: dicom.Dataset) -> bool:
    """Expected orientations of breast tomosynthesis views; a volume in the inverse of its own is turned."""
    if "1.2.840.10008.5.1.4.1.1.13.1.3" not in (ds.text("SOPClassUID"), ds.text("MediaStorageSOPClassUID")):
        return False
    side = (ds.text("ImageLaterality") or ds.text("Laterality") or "").upper()
    want = {("L", "CC"): ["A", "R"], ("R", "CC"): ["A", "L"], ("L", "MLO"): ["A", "FR"], ("R", "MLO"): ["A", "FL"]}.get((side, (ds.text("ViewPosition") or "").upper()))
    have = [p.strip().upper() for p in (ds.text("PatientOrientation") or "").split("\\") if p.strip()]
    return want is not None and have == [w.translate(str.maketrans("APRLFH", "PALRHF")) for w in want]


def resolution_of(ds: dicom.Dataset, spacing: float | None) -> tuple[float, float, float | None] | None:
    s = dicom.header_row(ds)["PixelSpacing"]
    if not s or min(s[:2]) <= 0:
        return None
    z = next((v for v in (spacing, ds.number("SpacingBetweenSlices"), ds.number("SliceThickness")) if v is not None), None)
    return float(np.float32(1) / np.float32(s[1])), float(np.float32(1) / np.float32(s[0])), float(np.float32(1) / np.float32(z)) if z else None


def handled(frames: Iterable[np.ndarray], n: int, h: Handler) -> Iterator[np.ndarray]:
    """What the handler makes of n frames that come one by one. A volume of one frame is kept whatever the handler."""
    if not n:
        raise ImageError("EMPTY_VOLUME", "no frames")
    if n == 1 or h.kind == "keep":
        yield from frames
    elif h.kind == "central-slice":
        yield from (f for i, f in enumerate(frames) if i == n // 2)
    elif h.kind == "max-intensity":
        kept = V.trim(n, h.skip_start, h.skip_end)
        yield V.max_intensity(f for i, f in enumerate(frames) if i in kept)
    elif h.kind == "interpolate":
        yield from V.interpolated(frames, n, h.target_frames)
    else:
        yield V.laplacian_mip((K.convert(f, "u16") for f in frames), n=n, mip_weight=h.mip_weight, skip_start=h.skip_start, skip_end=h.skip_end, central=h.projection)


def handle(frames: list[np.ndarray], h: Handler) -> list[np.ndarray]:
    return list(handled(frames, len(frames), h))


def depth_target(n: int, cfg: Preprocessor, resolution) -> int | None:
    """Frames that n are resampled to for the wanted distance, where there is one."""
    if not (cfg.spacing and cfg.spacing[2] and resolution and resolution[2] and n > 1):
        return None
    target = int(np.floor(float(np.float32((n - 1) / np.float32(resolution[2])) / np.float32(cfg.spacing[2])) + 0.5)) + 1
    return target if target > 1 and target != n else None


def resampled(resolution, n: int, target: int):
    return resolution[0], resolution[1], float(np.float32(resolution[2]) * np.float32(target - 1) / np.float32(n - 1))


def size_plan(w: int, h: int, cfg: Preprocessor, resolution):
    """(scale, size, resolution) of a cropped frame; scale and size are None where it keeps its own."""
    scale = size = None
    if cfg.size:
        sx, sy, ow, oh = K.fit_size(w, h, *cfg.size, exact=not cfg.use_padding)
        scale, size = (sx, sy), (max(1, ow), max(1, oh))
    elif cfg.spacing and resolution:
        sx, sy = (np.float32(np.float32(1) / np.float32(s)) / np.float32(r) for s, r in zip(cfg.spacing, resolution[:2]))
        size = tuple(max(1, int(np.floor(float(np.float32(n) * s) + 0.5))) for n, s in ((w, sx), (h, sy)))
        scale = (sx, sy)
    if scale and resolution:
        resolution = (float(np.float32(resolution[0]) * scale[0]), float(np.float32(resolution[1]) * scale[1]), resolution[2])
    return scale, size, resolution


def shape_frames(frames: list[np.ndarray], cfg: Preprocessor, resolution, flip: bool = False) -> tuple[list[np.ndarray], Preparation]:
    """Depth resampling, flip, common crop, resize, padding; with what was done."""
    record = None
    if flip:
        h, w = frames[0].shape[:2]
        frames, record = [K.flip(f, True, True) for f in frames], (w, h, True, True)
    n = len(frames)
    if target := depth_target(n, cfg, resolution):
        frames, resolution = V.interpolate(frames, target), resampled(resolution, n, target)
    crop = None
    if cfg.crop:
        box = K.common_box(frames, components=cfg.components, check_max=cfg.crop_max, border=cfg.border)
        frames, crop = [box.cut(f) for f in frames], (box.left, box.top, box.width, box.height)
    h, w = frames[0].shape[:2]
    scale, size, resolution = size_plan(w, h, cfg, resolution)
    if scale:
        frames = [K.resize(f, *size, cfg.filter) for f in frames]
    padding = None
    if cfg.size and cfg.use_padding:
        padding = K.padding_of(frames[0], *cfg.size, cfg.padding)
        frames = [K.pad(f, padding) for f in frames]
    done = Preparation(record, crop, (float(scale[0]), float(scale[1])) if scale else None, padding, resolution, len(frames))
    return frames, done


def needed_frames(order: list[int], h: Handler) -> list[int]:
    """Only what the handler reads is decoded."""
    return [order[len(order) // 2]] if h.kind == "central-slice" and order else order


def prepare_file(content: bytes, cfg: Preprocessor) -> tuple[list[np.ndarray], Preparation, str, list[int], dicom.Dataset]:
    ds = dicom.parse(content)
    strategy, order, spacing = order_frames(dicom.frame_rows(ds))
    frames = [np.ascontiguousarray(dicom.rendered_frame(ds, i, cfg.voi)) for i in needed_frames(order, cfg.handler)]
    resolution = resolution_of(ds, spacing)
    frames, done = shape_frames(handle(frames, cfg.handler), cfg, resolution, needs_flip(ds))
    return frames, done, strategy, order, ds


def _row(path, ds, frames, done: Preparation, strategy, order, dtype, compression) -> tuple:
    arr = tiff.to_array(frames, dtype)
    name = lambda n: (ds.text(n) or None) if ds is not None else None
    return (
        path, name("StudyInstanceUID"), name("SeriesInstanceUID"), name("SOPInstanceUID"), list(arr.shape), str(arr.dtype), arr.tobytes(), tiff.encode(frames, done, compression) if compression else None, strategy, list(order),
        list(done.crop) if done.crop else None, list(done.resize) if done.resize else None, list(done.padding) if done.padding else None, done.flip is not None, list(done.resolution) if done.resolution else None, done.num_frames, None, None,
    )


def _failed(path, e: ImageError) -> tuple:
    return (path, *[None] * 15, e.code, e.message)


def preprocess(files: DataFrame, cfg: Preprocessor | None = None, *, dtype: str | None = None, compression: str | None = None) -> DataFrame:
    """Prepared volume of every file (path, content): shape, samples, what was done, and a TIFF if a compression is given."""
    cfg = cfg or Preprocessor()
    schema = schema_of(OUT)

    def run(it):
        def rows():
            for b in it:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    try:
                        with typed("INVALID_DICOM"):
                            frames, done, strategy, order, ds = prepare_file(content, cfg)
                            row = _row(path, ds, frames, done, strategy, order, dtype, compression)
                        yield row
                    except ImageError as e:
                        if cfg.strict:
                            raise
                        yield _failed(path, e)

        yield from to_batches(rows(), schema, 8)

    return files.select("path", "content").mapInArrow(run, OUT)


def preprocess_series(files: DataFrame, cfg: Preprocessor | None = None, *, series: str = "series", position: str = "position", spacing: str | None = None, dtype: str | None = None, compression: str | None = None) -> DataFrame:
    """One row a series: its files (series, position, path, content) in order, prepared together with a common crop, size and padding.

    spacing: a column of the distance between files, which the order found.
    """
    cfg = cfg or Preprocessor()

    def one(key, t):
        t = t.sort_by(position)
        path = t.column("path")[0].as_py()
        try:
            frames, first, flip, res = [], None, False, None
            stated = t.column(spacing)[0].as_py() if spacing else None
            for i, c in enumerate(t.column("content")):
                try:
                    with typed("INVALID_DICOM"):
                        ds = dicom.parse(c.as_py())
                        _, order, own = order_frames(dicom.frame_rows(ds))
                        frames += [np.ascontiguousarray(dicom.rendered_frame(ds, f, cfg.voi)) for f in order]
                except ImageError as e:
                    raise ImageError(e.code, f"input {i}: {e.message}", input_index=i) from e
                if first is None:
                    first, flip, res = ds, needs_flip(ds), resolution_of(ds, stated if stated is not None else own)
            with typed("INVALID_DICOM"):
                V.same_shape(frames)
                shaped, done = shape_frames(handle(frames, cfg.handler), cfg, res, flip)
                row = _row(path, first, shaped, done, "series", range(t.num_rows), dtype, compression)
        except ImageError as e:
            if cfg.strict:
                raise
            row = _failed(path, e)
        return pa.Table.from_batches(to_batches(iter([row]), schema))

    schema = schema_of(OUT)
    columns = [series, position, "path", "content", *([spacing] if spacing else [])]
    return files.select(*columns).groupBy(series).applyInArrow(one, OUT)


def headers(files: DataFrame) -> DataFrame:
    """Header columns of every file (path, content) for validation, naming and ordering; parse errors become columns."""
    names = [n for n, (_, _, vr) in dicom.ATTRIBUTES.items() if vr not in ("SQ", "OW", "AT") and n != "PixelSpacing"]
    ddl = "path string, " + ", ".join(f"{n} string" for n in names) + ", PixelSpacing array<double>, PixelDataLength long, VOILUTSequenceItems int, present array<string>, error_code string, error_message string"
    schema = schema_of(ddl)

    def run(it):
        def rows():
            for b in it:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    try:
                        with typed("INVALID_DICOM"):
                            h = dicom.header_row(dicom.parse(content))
                        yield (path, *[h[n] for n in names], h["PixelSpacing"], h["PixelDataLength"], h["VOILUTSequenceItems"], h["present"], None, None)
                    except ImageError as e:
                        yield (path, *[None] * (len(names) + 4), e.code, e.message)

        yield from to_batches(rows(), schema, 256)

    return files.select("path", "content").mapInArrow(run, ddl)


def decode_checks(files: DataFrame) -> DataFrame:
    """(path, decoded, code, error, expected_bytes): whether frame 0 decodes. Run it on the files that passed the rules only."""
    ddl = "path string, decoded boolean, code string, error string, expected_bytes long"
    schema = schema_of(ddl)

    def run(it):
        def rows():
            for b in it:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    expected = None
                    try:
                        with typed("INVALID_DICOM"):
                            ds = dicom.parse(content)
                            expected = dicom.frame_bytes(ds)
                            dicom.rendered_frame(ds, 0)
                        yield path, True, None, None, expected
                    except ImageError as e:
                        yield path, False, e.code, str(e), expected

        yield from to_batches(rows(), schema, 256)

    return files.select("path", "content").mapInArrow(run, ddl)


def tiff_info(files: DataFrame) -> DataFrame:
    """width, height, channels, num_frames (0 where unreadable) and the recorded preparation of TIFF files."""
    ddl = "path string, width long, height long, channels long, num_frames long, crop array<int>, scale array<float>, padding array<int>, flip array<int>, resolution array<float>"
    schema = schema_of(ddl)

    def run(it):
        def rows():
            for b in it:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    try:
                        t = tiff.Tiff(content)
                        p = t.preparation()
                        w, h = t.page(0).size
                        lists = [list(map(int, v)) if v else None for v in (p.crop,)] + [list(p.resize) if p.resize else None] + [list(v) if v else None for v in (p.padding,)]
                        yield path, w, h, t.page(0).channels, p.num_frames, *lists, list(map(int, p.flip)) if p.flip else None, list(p.resolution[:2]) if p.resolution else None
                    except Exception:  # noqa: BLE001 - files of any content may lie here
                        yield path, 0, 0, 0, 0, None, None, None, None, None

        yield from to_batches(rows(), schema, 256)

    return files.select("path", "content").mapInArrow(run, ddl)


def frame_moments(f: np.ndarray, normalize: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """Samples a channel, means and squared deviations of one frame."""
    x = (f[:, :, None] if f.ndim == 2 else f).reshape(-1, 1 if f.ndim == 2 else f.shape[2]).astype(np.float64)
    if normalize and f.dtype.kind in "ui":
        x /= float(np.iinfo(f.dtype).max)
    mean = x.mean(0)
    return len(x), mean, ((x - mean) ** 2).sum(0)


def merged_moments(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    if len(a[1]) != len(b[1]):
        raise ImageError("CHANNEL_MISMATCH", f"frames of {len(a[1])} and {len(b[1])} channels")
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n)


def tiff_stats(files: DataFrame, normalize: bool = False) -> DataFrame:
    """(path, channel, n, mean, m2) of every TIFF, frame by frame; merge with operators.relational.merge_stats."""
    ddl = "path string, channel int, n long, mean double, m2 double"
    schema = schema_of(ddl)

    def run(it):
        def rows():
            for b in it:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    with typed("INVALID_TIFF", path):
                        t = tiff.Tiff(content)
                        moments = None
                        for i in range(t.count()):
                            moments = merged_moments(moments, frame_moments(t.frame(i), normalize))
                    for c, (mean, m2) in enumerate(zip(*moments[1:])):
                        yield path, c, moments[0], float(mean), float(m2)

        yield from to_batches(rows(), schema, 256)

    return files.select("path", "content").mapInArrow(run, ddl)


def load_tiffs(files: DataFrame, frames: list[int] | None = None, dtype: str | None = None) -> DataFrame:
    """(path, shape, dtype, data) of TIFF files, all frames or those asked for."""
    ddl = "path string, shape array<int>, dtype string, data binary"
    schema = schema_of(ddl)

    def run(it):
        def rows():
            for b in it:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    with typed("INVALID_TIFF", path):
                        a = tiff.to_array(tiff.decode(content, frames), dtype)
                    yield path, list(a.shape), str(a.dtype), a.tobytes()

        yield from to_batches(rows(), schema, 8)

    return files.select("path", "content").mapInArrow(run, ddl)


def batches(loaded: DataFrame, size: int, order: str = "path"):
    """Arrays of `size` files at a time on the driver, by a column of `loaded` (such as the place in a caller's list); one partition is held, the next is fetched ahead."""
    held = []
    for r in loaded.orderBy(order).toLocalIterator(prefetchPartitions=True):
        held.append(to_numpy(r))
        if len(held) == size:
            yield np.stack(held)
            held = []
    if held:
        yield np.stack(held)


def to_numpy(row) -> np.ndarray:
    return np.frombuffer(row["data"], np.dtype(row["dtype"])).reshape(row["shape"])


def resize_tiff(content: bytes, scale: float, kind: str = "nearest", compression: str = "packbits", cumulative_resolution: bool = True) -> bytes:
    """A TIFF resized by a factor, its record composed: scale times the earlier one, padding scaled and rounded.

    cumulative_resolution multiplies the resolution by the composed scale, as existing files have it; False uses the new factor only.
    """
    if not scale > 0:
        raise ValueError("a scale is above 0")
    t = tiff.Tiff(content)
    p = t.preparation()
    frames = [f if f.ndim == 2 else f[:, :, :3] for f in (t.frame(i) for i in range(t.count()))]
    h, w = frames[0].shape[:2]
    s = np.float32(scale)
    out = [K.resize(f, max(1, int(np.floor(float(np.float32(w) * s) + 0.5))), max(1, int(np.floor(float(np.float32(h) * s) + 0.5))), kind) for f in frames]
    sx, sy = (float(np.float32(v) * s) for v in (p.resize or (1.0, 1.0)))
    by = (sx, sy) if cumulative_resolution else (scale, scale)
    res = (p.resolution[0] * by[0], p.resolution[1] * by[1], p.resolution[2]) if p.resolution else None
    pad = tuple(int(np.floor(v * scale + 0.5)) for v in p.padding) if p.padding else None
    return tiff.encode(out, Preparation(p.flip, p.crop, (sx, sy), pad, res, len(out)), compression)


def preview(frames: list[np.ndarray], boxes: list[tuple[int, int, int, int]], border: int = 2) -> np.ndarray:
    """The largest sample over frames as RGB, with red borders of (x_min, x_max, y_min, y_max) boxes."""
    top = K.to_u8(V.max_intensity(frames))
    rgb = np.repeat(top[:, :, None], 3, 2) if top.ndim == 2 else top.copy()
    for x0, x1, y0, y1 in boxes:
        area = np.zeros(rgb.shape[:2], bool)
        area[y0 : y1 + 1, x0 : x1 + 1] = True
        area[y0 + border : max(y0 + border, y1 + 1 - border), x0 + border : max(x0 + border, x1 + 1 - border)] = False
        rgb[area] = (255, 0, 0)
    return rgb


def previews(files: DataFrame) -> DataFrame:
    """(path, content) of TIFF pictures from (path, content, boxes) of TIFFs and their boxes."""
    ddl = "path string, content binary"
    schema = schema_of(ddl)

    def run(it):
        def rows():
            for b in it:
                for path, content, boxes in zip(*(c.to_pylist() for c in b.columns)):
                    with typed("INVALID_TIFF", path):
                        picture = preview(tiff.decode(content), [(x["x_min"], x["x_max"], x["y_min"], x["y_max"]) for x in boxes])
                    yield path, tiff.encode([picture])

        yield from to_batches(rows(), schema, 8)

    return files.select("path", "content", "boxes").mapInArrow(run, ddl)


def frame_plan(order: list[int], h: Handler) -> list[int | None]:
    """For each frame shown the stored frame it is, or None for one that is derived from several."""
    if len(order) <= 1 or h.kind == "keep":
        return list(order)
    if h.kind == "central-slice":
        return needed_frames(order, h)
    if h.kind == "interpolate":
        n, t = len(order), h.target_frames
        if t <= 1:
            return [order[0]]
        at = [float(np.float32(np.float32(i) / np.float32(t - 1)) * np.float32(n - 1)) for i in range(t)]
        return [order[int(p)] if p.is_integer() else None for p in at]
    return [None]


def stored_of(plan: list[int | None], index: int) -> int:
    """The stored frame behind a shown one."""
    if not 0 <= index < len(plan):
        raise ImageError("FRAME_OUT_OF_RANGE", f"frame {index} of {len(plan)}", frame_index=index)
    if plan[index] is None:
        raise ImageError("DERIVED_FRAME", f"frame {index} is made of several stored ones", frame_index=index)
    return plan[index]


def frame_plans(files: DataFrame, h: Handler | None = None) -> DataFrame:
    """(path, strategy, shown, stored, derived) of every file's frames, with error columns."""
    h = h or Handler()
    ddl = "path string, strategy string, shown int, stored int, derived boolean, error_code string, error_message string"
    schema = schema_of(ddl)

    def run(it):
        def rows():
            for b in it:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    try:
                        with typed("INVALID_DICOM"):
                            strategy, order, _ = order_frames(dicom.frame_rows(dicom.parse(content)))
                        for n, stored in enumerate(frame_plan(order, h)):
                            yield path, strategy, n, stored, stored is None, None, None
                    except ImageError as e:
                        yield path, None, None, None, None, e.code, e.message

        yield from to_batches(rows(), schema, 4096)

    return files.select("path", "content").mapInArrow(run, ddl)


def render_displays(files: DataFrame, cfg: Preprocessor | None = None) -> DataFrame:
    """(path, shown, shape, dtype, data) of every frame shown of every file, one row each; errors become columns."""
    cfg = cfg or Preprocessor()
    ddl = "path string, shown int, shape array<int>, dtype string, data binary, error_code string, error_message string"
    schema = schema_of(ddl)

    def run(it):
        def rows():
            for b in it:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    try:
                        with typed("INVALID_DICOM"):
                            for n, x in enumerate(displayed(content, cfg)):
                                yield path, n, list(x.shape), str(x.dtype), np.ascontiguousarray(x).tobytes(), None, None
                    except ImageError as e:
                        yield path, None, None, None, None, e.code, e.message

        yield from to_batches(rows(), schema, 8)

    return files.select("path", "content").mapInArrow(run, ddl)


def displayed(content: bytes, cfg: Preprocessor):
    """The frames shown, one at a time; the volume is held only where frames are derived."""
    ds = dicom.parse(content)
    _, order, _ = order_frames(dicom.frame_rows(ds))
    plan, turn = frame_plan(order, cfg.handler), needs_flip(ds)
    if None in plan:
        shown = iter(handle([dicom.rendered_frame(ds, i, cfg.voi) for i in order], cfg.handler))
    else:
        shown = (dicom.rendered_frame(ds, i, cfg.voi) for i in plan)
    for x in shown:
        yield K.flip(x, True, True) if turn else x


def render_display(content: bytes, index: int, cfg: Preprocessor | None = None) -> np.ndarray:
    """Frame `index` of the ordered, handled volume; a stored frame is decoded alone."""
    cfg = cfg or Preprocessor()
    ds = dicom.parse(content)
    _, order, _ = order_frames(dicom.frame_rows(ds))
    plan, turn = frame_plan(order, cfg.handler), needs_flip(ds)
    if None not in plan:
        out = dicom.rendered_frame(ds, stored_of(plan, index), cfg.voi)
    else:
        frames = handle([dicom.rendered_frame(ds, i, cfg.voi) for i in order], cfg.handler)
        if not 0 <= index < len(frames):
            raise ImageError("FRAME_OUT_OF_RANGE", f"frame {index} of {len(frames)}", frame_index=index)
        out = frames[index]
    return K.flip(out, True, True) if turn else out
