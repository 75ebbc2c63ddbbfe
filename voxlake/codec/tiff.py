"""A TIFF reader and writer for grey and RGB frames, one strip a page."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from voxlake.errors import ImageError
from voxlake.kernels.images import convert
from voxlake.kernels.volumes import same_shape

#: TIFF tag numbers, types and compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
XRES, YRES, PLANAR, UNIT, PAGE, SOFTWARE, PREDICTOR, FORMAT = 282, 283, 284, 296, 297, 305, 317, 339
SCALE, CROP_ORIGIN, CROP_SIZE, ACTIVE_AREA, FLIP = 50718, 50719, 50720, 50829, 65000
CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


# ---------------------------------------------------------------- compression


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        c = data[i]
        i += 1
        if c < 128:
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128:
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, the width growing one code early."""
    out, acc, held = bytearray(), 0, 0

    def put(code, width):
        nonlocal acc, held
        acc, held = (acc << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append((acc >> held) & 255)
        acc &= (1 << held) - 1

    fresh = {bytes((i,)): i for i in range(256)}
    table, nxt, width = dict(fresh), 258, 9
    put(256, 9)
    w = b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in table:
            w += c
            continue
        put(table[w], width)
        table[w + c] = nxt
        nxt += 1
        if nxt == 4095:
            put(256, width)
            table, nxt, width = dict(fresh), 258, 9
        elif nxt + 1 > 1 << width:
            width += 1
        w = c
    if w:
        put(table[w], width)
        nxt += 1
        if nxt + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if held:
        out.append((acc << (8 - held)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, acc, held, at = bytearray(), 0, 0, 0
    table: list[bytes] = []
    width, prev = 9, None
    while len(out) < size:
        while held < width and at < len(data):
            acc, held, at = (acc << 8) | data[at], held + 8, at + 1
        if held < width:
            break
        code = (acc >> (held - width)) & ((1 << width) - 1)
        held -= width
        acc &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, prev = 9, None
            continue
        if prev is None:
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(prev + entry[:1])
        else:
            entry = prev + prev[:1]
            table.append(entry)
        out += entry
        prev = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out[:size])


def compress(data: bytes, kind: str, row: int) -> bytes:
    if kind == "packbits":
        return b"".join(pack_bits(data[i : i + row]) for i in range(0, len(data), row))
    return {"none": bytes, "lzw": lzw_encode, "deflate": zlib.compress}[kind](data)


def expand(data: bytes, code: int, size: int) -> bytes:
    if code == 1:
        return data[:size]
    if code == 32773:
        return unpack_bits(data, size)
    if code == 5:
        return lzw_decode(data, size)
    if code in (8, 32946):
        return zlib.decompress(data)[:size]
    raise ImageError("UNSUPPORTED_COMPRESSION", f"TIFF compression {code}")


# ---------------------------------------------------------------- metadata


@dataclass(frozen=True)
class Preparation:
    """What was done to a volume. None: not done. Sizes are pixels, scales 32-bit floats, resolution pixels per mm."""

    flip: tuple[int, int, bool, bool] | None = None
    crop: tuple[int, int, int, int] | None = None
    resize: tuple[float, float] | None = None
    padding: tuple[int, int, int, int] | None = None
    resolution: tuple[float, float, float | None] | None = None
    num_frames: int = 1

    def tags(self) -> dict[int, tuple[int, list]]:
        """Tag -> (type, values). The crop's origin tag holds its centre, the active area its padding amounts."""
        out: dict[int, tuple[int, list]] = {}
        if self.resize:
            out[SCALE] = (11, [float(v) for v in self.resize])
        if self.crop:
            left, top, w, h = self.crop
            out[CROP_ORIGIN] = (4, [left + w // 2, top + h // 2])
            out[CROP_SIZE] = (4, [w, h])
        if self.padding:
            out[ACTIVE_AREA] = (4, list(self.padding))
        if self.flip:
            w, h, hor, ver = self.flip
            out[FLIP] = (4, [w, h, int(hor), int(ver)])
        if self.resolution:
            for tag, v in ((XRES, self.resolution[0]), (YRES, self.resolution[1])):
                out[tag] = (5, [(max(0, int(np.float32(v) * np.float32(10))), 1)])
            out[UNIT] = (3, [3])
        return out

    @classmethod
    def of(cls, tags: dict[int, list]) -> Preparation:
        """Read back; a tag of the wrong number of values counts as absent. The resampling filter isn't stored."""

        def four(tag, n):
            v = tags.get(tag)
            return v if v is not None and len(v) == n else None

        crop = None
        if (c := four(CROP_ORIGIN, 2)) and (s := four(CROP_SIZE, 2)):
            crop = (max(0, c[0] - s[0] // 2), max(0, c[1] - s[1] // 2), s[0], s[1])
        scale, area, fl = four(SCALE, 2), four(ACTIVE_AREA, 4), four(FLIP, 4)
        if fl and (fl[2] not in (0, 1) or fl[3] not in (0, 1)):
            fl = None
        res = None
        if XRES in tags and YRES in tags:
            per = {3: 10.0, 2: 25.4}.get((tags.get(UNIT) or [2])[0], 1.0)
            res = (float(np.float32(tags[XRES][0]) / np.float32(per)), float(np.float32(tags[YRES][0]) / np.float32(per)), None)
        return cls(
            flip=(fl[0], fl[1], bool(fl[2]), bool(fl[3])) if fl else None, crop=crop, resize=tuple(scale) if scale else None, padding=tuple(area) if area else None, resolution=res,
            num_frames=frame_total(tags) or 1,
        )


def frame_total(tags: dict[int, list]) -> int | None:
    page = tags.get(PAGE)
    return page[1] if page and len(page) == 2 and page[1] else None


# ---------------------------------------------------------------- writing


def encode(frames: list[np.ndarray], meta: Preparation | None = None, compression: str = "packbits") -> bytes:
    """Frames of u8, u16 (rows, columns) or u8 (rows, columns, 3), each with all metadata tags."""
    pages = Pages(len(frames), meta, compression)
    return b"".join(map(pages.add, frames))


class Pages:
    """A TIFF page by page: add() gives the bytes that follow, tags before samples, so no page is kept."""

    def __init__(self, total: int, meta: Preparation | None = None, compression: str = "packbits") -> None:
        if not total:
            raise ImageError("EMPTY_VOLUME", "no frame to write")
        if total > 65535:
            raise ImageError("TOO_MANY_FRAMES", "a page number holds 16 bits")
        self.total, self.meta = total, meta or Preparation(num_frames=total)
        self.compression = compression if compression in CODES else "none"
        self.done = self.at = 0

    def add(self, f: np.ndarray) -> bytes:
        if f.ndim == 3 and f.shape[2] == 1:
            f = f[:, :, 0]
        rgb = f.ndim == 3
        if not (f.dtype == np.uint8 and (not rgb or f.shape[2] == 3)) and not (f.dtype == np.uint16 and not rgb):
            raise ImageError("UNSUPPORTED_COLOR_TYPE", f"{f.dtype} with shape {f.shape}")
        h, w = f.shape[:2]
        n = 3 if rgb else 1
        data = compress(np.ascontiguousarray(f.astype(f.dtype.newbyteorder("<"))).tobytes(), self.compression, w * f.itemsize * n)
        head = b"" if self.at else struct.pack("<2sHI", b"II", 42, 8)
        ifd = self.at + len(head)
        tags = {
            WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [f.itemsize * 8] * n), COMPRESSION: (3, [CODES[self.compression]]), PHOTOMETRIC: (3, [2 if rgb else 1]), OFFSETS: (4, [0]), SAMPLES: (3, [n]),
            ROWS: (4, [h]), COUNTS: (4, [len(data)]), PLANAR: (3, [1]), PAGE: (3, [0, self.total]), SOFTWARE: (2, [b"voxlake\0"]), FORMAT: (3, [1] * n), **self.meta.tags(),
        }
        size = len(_directory(tags, ifd, 0))
        tags[OFFSETS] = (4, [ifd + size])
        data += b"\0" * (len(data) % 2)
        self.done += 1
        self.at = ifd + size + len(data)
        return head + _directory(tags, ifd, self.at if self.done < self.total else 0) + data


def _directory(tags: dict[int, tuple[int, list]], at: int, following: int) -> bytes:
    """Tags at a place of the file, with the place of the next directory and of values that don't fit into 4 bytes."""
    body, tail = bytearray(struct.pack("<H", len(tags))), bytearray()
    base = at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        kind, values = tags[tag]
        if kind == 2:
            blob, count = values[0], len(values[0])
        elif kind == 5:
            blob, count = b"".join(struct.pack("<II", *v) for v in values), len(values)
        else:
            blob, count = struct.pack(f"<{len(values)}{FORMATS[kind]}", *values), len(values)
        if len(blob) <= 4:
            where = blob.ljust(4, b"\0")
        else:
            where = struct.pack("<I", base + len(tail))
            tail += blob + b"\0" * (len(blob) % 2)
        body += struct.pack("<HHI", tag, kind, count) + where
    return bytes(body + struct.pack("<I", following) + tail)


# ---------------------------------------------------------------- reading


@dataclass
class Page:
    tags: dict[int, list] = field(default_factory=dict)

    @property
    def size(self) -> tuple[int, int]:
        return self.tags[WIDTH][0], self.tags[HEIGHT][0]

    @property
    def channels(self) -> int:
        return self.tags.get(SAMPLES, [1])[0]


class Tiff:
    """Pages of a classic TIFF of either byte order; content may be anything that gives bytes for a slice."""

    def __init__(self, content: bytes) -> None:
        if content[:4] not in (b"II*\0", b"MM\0*"):
            raise ImageError("NOT_TIFF", "no TIFF header")
        self.content, self.order = content, "<" if content[:2] == b"II" else ">"
        self._pages: list[Page] = []
        (self._next,) = self._values("I", 4)
        self._seen: set[int] = set()

    def _values(self, kinds: str, at: int) -> tuple:
        kinds = self.order + kinds
        return struct.unpack(kinds, self.content[at : at + struct.calcsize(kinds)])

    def _read(self) -> bool:
        if not self._next or self._next in self._seen:
            return False
        self._seen.add(self._next)
        c, at = self.content, self._next
        (n,) = self._values("H", at)
        page = Page()
        for i in range(n):
            tag, kind, count = self._values("HHI", at + 2 + 12 * i)
            size = SIZES.get(kind, 1) * count
            p = at + 10 + 12 * i
            if size > 4:
                (p,) = self._values("I", p)
            if kind == 2:
                page.tags[tag] = [c[p : p + count]]
            elif kind in (5, 10):
                v = self._values(f"{2 * count}{'I' if kind == 5 else 'i'}", p)
                page.tags[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2])]
            elif kind in FORMATS:
                page.tags[tag] = list(self._values(f"{count}{FORMATS[kind]}", p))
        self._pages.append(page)
        (self._next,) = self._values("I", at + 2 + 12 * n)
        return True

    def page(self, i: int) -> Page:
        while len(self._pages) <= i:
            if not self._read():
                raise ImageError("FRAME_OUT_OF_RANGE", f"frame {i} of {len(self._pages)}", frame_index=i)
        return self._pages[i]

    def count(self) -> int:
        """From the page number tag if it is there, else by walking all pages."""
        if total := frame_total(self.page(0).tags):
            return total
        while self._read():
            pass
        return len(self._pages)

    def preparation(self) -> Preparation:
        p = Preparation.of(self.page(0).tags)
        return Preparation(p.flip, p.crop, p.resize, p.padding, p.resolution, self.count())

    def frame(self, i: int) -> np.ndarray:
        t = self.page(i).tags
        (w, h), n = self.page(i).size, self.page(i).channels
        bits = t.get(BITS, [8])
        if len(set(bits)) != 1 or bits[0] not in (8, 16, 32, 64) or t.get(PLANAR, [1])[0] != 1 and n > 1:
            raise ImageError("UNSUPPORTED_COLOR_TYPE", f"bits {bits}, planar {t.get(PLANAR)}")
        kind = {1: "u", 2: "i", 3: "f"}.get(t.get(FORMAT, [1])[0])
        if kind is None:
            raise ImageError("UNSUPPORTED_COLOR_TYPE", f"sample format {t.get(FORMAT)}")
        dtype = np.dtype(f"{self.order}{kind}{bits[0] // 8}")
        rows, row = t.get(ROWS, [h])[0], w * n * dtype.itemsize
        parts = []
        for s, (at, size) in enumerate(zip(t[OFFSETS], t[COUNTS], strict=True)):
            parts.append(expand(self.content[at : at + size], t.get(COMPRESSION, [1])[0], min(rows, h - s * rows) * row))
        img = np.frombuffer(b"".join(parts), dtype)[: h * w * n].reshape(h, w, n)
        if t.get(PREDICTOR, [1])[0] == 2:
            img = np.cumsum(img, axis=1, dtype=dtype.newbyteorder("="))
        img = img.astype(dtype.newbyteorder("="))
        if t.get(PHOTOMETRIC, [1])[0] == 0:
            img = (np.iinfo(img.dtype).max - img).astype(img.dtype)
        return img[:, :, 0] if n == 1 else img


def decode(content: bytes, frames: list[int] | None = None) -> list[np.ndarray]:
    """All frames, or those asked for, in that order and as often; alpha is dropped."""
    t = Tiff(content)
    if frames is not None and not frames:
        raise ImageError("NO_FRAMES", "an empty list of frames")
    total = t.count()
    for i in frames or ():
        if not 0 <= i < total:
            raise ImageError("FRAME_OUT_OF_RANGE", f"frame {i} of {total}", frame_index=i)
    out = [t.frame(i) for i in (frames if frames is not None else range(total))]
    return [f if f.ndim == 2 else f[:, :, 0] if f.shape[2] == 2 else f[:, :, :3] for f in out]


def to_array(frames: list[np.ndarray], dtype: str | None = None) -> np.ndarray:
    """frames, rows, columns, channels."""
    same_shape(frames)
    out = [convert(f, dtype) if dtype else f for f in frames]
    return np.stack([f[:, :, None] if f.ndim == 2 else f for f in out])
