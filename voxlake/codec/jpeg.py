"""JPEG: baseline and extended sequential (8 and 12 bits) and lossless (processes 14), after ITU-T T.81.

Grey and three-component images; sampling factors are undone by repetition. YCbCr
is turned into RGB where the file's marker or its component numbers don't say otherwise.
"""

from __future__ import annotations

import struct

import numpy as np

from voxlake.errors import ImageError

#: Fixed value of the standard: the place of each coefficient in zigzag order.
ZIGZAG = np.array([y * 8 + x for s in range(15) for y, x in ((i, s - i) if s % 2 else (s - i, i) for i in range(s + 1)) if y < 8 and x < 8])
RGB_NAMES = (ord("R"), ord("G"), ord("B"))


def _basis() -> np.ndarray:
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    c = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


BASIS = _basis()


def _error(message: str) -> ImageError:
    return ImageError("INVALID_JPEG", message)


class Huffman:
    """Codes of up to 16 bits as one table by the next 16 bits: length and symbol."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.length, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = at = 0
        for bits in range(1, 17):
            for _ in range(counts[bits - 1]):
                a, z = code << (16 - bits), (code + 1) << (16 - bits)
                if z > 1 << 16 or at >= len(symbols):
                    raise _error("a Huffman table has too many codes")
                self.length[a:z], self.symbol[a:z] = bits, symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.length, self.symbol = self.length.tolist(), self.symbol.tolist()


class Bits:
    """The bits of an entropy-coded segment, stuffing removed; zeros follow its end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n, self.padded = data, 0, 0, 0, 0

    def fill(self) -> None:
        chunk = self.data[self.at : self.at + 32]
        if not chunk:
            self.check()
            chunk = b"\0" * 32
            self.padded += 8 * len(chunk)
        self.at += 32
        self.held = (self.held & ((1 << self.n) - 1)) << (8 * len(chunk)) | int.from_bytes(chunk, "big")
        self.n += 8 * len(chunk)

    def check(self) -> None:
        """Looking ahead may need zeros behind the end; using them up is an error."""
        if self.n < self.padded:
            raise _error("the data end too early")

    def code(self, table: Huffman) -> int:
        if self.n < 16:
            self.fill()
        top = (self.held >> (self.n - 16)) & 0xFFFF
        bits = table.length[top]
        if not bits:
            raise _error("an unknown Huffman code")
        self.n -= bits
        return table.symbol[top]

    def value(self, size: int) -> int:
        """A signed value of `size` bits."""
        if not size:
            return 0
        if self.n < size:
            self.fill()
        self.n -= size
        v = (self.held >> self.n) & ((1 << size) - 1)
        return v if v >> (size - 1) else v - (1 << size) + 1


class Component:
    def __init__(self, number: int, h: int, v: int, table: int) -> None:
        self.number, self.h, self.v, self.quant = number, h, v, table
        self.dc = self.ac = 0


def _segments(data: bytes):
    """(marker, body, end of the body) of each marker segment up to the scan's data."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise _error("no marker where one must be")
        m = data[at + 1]
        if m == 0xFF:
            at += 1
            continue
        if m == 0xD9:
            return
        (n,) = struct.unpack_from(">H", data, at + 2)
        yield m, data[at + 4 : at + 2 + n], at + 2 + n
        at += 2 + n


def _scan_data(data: bytes, at: int) -> list[bytes]:
    """The restart intervals of a scan, without stuffing."""
    out, start, i = [], at, at
    while True:
        i = data.find(b"\xff", i)
        if i < 0 or i + 1 >= len(data):
            out.append(data[start:])
            break
        m = data[i + 1]
        if m == 0:
            i += 2
        elif 0xD0 <= m <= 0xD7:
            out.append(data[start:i])
            start = i = i + 2
        elif m == 0xFF:
            i += 1
        else:
            out.append(data[start:i])
            break
    return [s.replace(b"\xff\x00", b"\xff") for s in out]


def decode(data: bytes, rgb: bool = False) -> np.ndarray:
    """(rows, columns) or (rows, columns, 3); uint8, or uint16 for more than 8 bits. rgb: the components are RGB as stored."""
    if data[:2] != b"\xff\xd8":
        raise _error("no start of image")
    try:
        return _decode(data, rgb)
    except (struct.error, IndexError, KeyError, ValueError, StopIteration) as e:
        raise _error(str(e)) from e


def _decode(data: bytes, rgb: bool) -> np.ndarray:
    quant, huff, comps, interval, transform, frame = {}, {}, [], 0, None, None
    for marker, body, end in _segments(data):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide, t = body[at] >> 4, body[at] & 15
                quant[t] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.float64)
                at += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            at = 0
            while at < len(body):
                counts = body[at + 1 : at + 17]
                huff[body[at]] = Huffman(counts, body[at + 17 : at + 17 + sum(counts)])
                at += 17 + sum(counts)
        elif marker in (0xC0, 0xC1, 0xC3):
            frame = (marker, *struct.unpack_from(">BHHB", body))
            comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(frame[4])]
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ImageError("UNSUPPORTED_JPEG", f"process of marker {marker:02X}")
        elif marker == 0xDD:
            (interval,) = struct.unpack_from(">H", body)
        elif marker == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif marker == 0xDA:
            if frame is None or body[0] != len(comps):
                raise ImageError("UNSUPPORTED_JPEG", "one scan must hold all components")
            for i in range(body[0]):
                c = next(c for c in comps if c.number == body[1 + 2 * i])
                c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            select, shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
            parts = _scan_data(data, end)
            kind, bits, rows, cols, _ = frame
            if not rows or not cols or len(comps) not in (1, 3):
                raise ImageError("UNSUPPORTED_JPEG", "a size of 0, or neither one nor three components")
            if kind == 0xC3:
                return _lossless(parts, comps, huff, bits, rows, cols, interval, select, shift)
            img = _sequential(parts, comps, quant, huff, bits, rows, cols, interval)
            if len(comps) == 3 and not rgb and transform != 0 and tuple(c.number for c in comps) != RGB_NAMES:
                img = _to_rgb(img, bits)
            top = (1 << bits) - 1
            img = np.clip(np.floor(img + 0.5), 0, top).astype(np.uint8 if bits <= 8 else np.uint16)
            return img[:, :, 0] if len(comps) == 1 else img
    raise _error("no scan")


def _to_rgb(x: np.ndarray, bits: int) -> np.ndarray:
    y, cb, cr = x[..., 0], x[..., 1] - (1 << (bits - 1)), x[..., 2] - (1 << (bits - 1))
    return np.stack((y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb), -1)


def _sequential(parts, comps, quant, huff, bits, rows, cols, interval) -> np.ndarray:
    hm, vm = max(c.h for c in comps), max(c.v for c in comps)
    alone = len(comps) == 1
    if alone:
        comps[0].h = comps[0].v = hm = vm = 1
    across, down = -(-cols // (8 * hm)), -(-rows // (8 * vm))
    blocks = {c.number: np.zeros((down * c.v, across * c.h, 64)) for c in comps}
    total, mcu = across * down, 0
    for part in parts:
        b, last = Bits(part), dict.fromkeys((c.number for c in comps), 0)
        for _ in range(min(interval or total, total - mcu)):
            my, mx = divmod(mcu, across)
            for c in comps:
                dc, ac = huff[c.dc], huff[16 + c.ac]
                for i in range(c.v):
                    for j in range(c.h):
                        out = blocks[c.number][my * c.v + i, mx * c.h + j]
                        last[c.number] += b.value(b.code(dc))
                        out[0] = last[c.number]
                        k = 1
                        while k < 64:
                            rs = b.code(ac)
                            run, size = rs >> 4, rs & 15
                            if not size:
                                if run != 15:
                                    break
                                k += 16
                                continue
                            k += run
                            if k > 63:
                                raise _error("too many coefficients in a block")
                            out[ZIGZAG[k]] = b.value(size)
                            k += 1
            mcu += 1
        b.check()
    if mcu < total:
        raise _error("the data end too early")
    planes = []
    for c in comps:
        table = np.empty(64)
        table[ZIGZAG] = quant[c.quant]
        x = (blocks[c.number] * table).reshape(*blocks[c.number].shape[:2], 8, 8)
        x = BASIS.T @ x @ BASIS + (1 << (bits - 1))
        plane = x.transpose(0, 2, 1, 3).reshape(x.shape[0] * 8, x.shape[1] * 8)
        planes.append(plane.repeat(vm // c.v, 0).repeat(hm // c.h, 1)[:rows, :cols])
    return np.stack(planes, -1)


def _lossless(parts, comps, huff, bits, rows, cols, interval, select, shift) -> np.ndarray:
    if any((c.h, c.v) != (1, 1) for c in comps) or not 1 <= select <= 7:
        raise ImageError("UNSUPPORTED_JPEG", "sampling or prediction of a lossless image")
    n = len(comps)
    tables = [huff[c.dc] for c in comps]
    diff = np.zeros((rows * cols, n), np.int64)
    starts, at = [], 0
    for part in parts:
        b = Bits(part)
        starts.append(at)
        for i in range(at, min(rows * cols, at + (interval or rows * cols))):
            for j in range(n):
                size = b.code(tables[j])
                diff[i, j] = 32768 if size == 16 else b.value(size)
        b.check()
        at = min(rows * cols, at + (interval or rows * cols))
    if at < rows * cols:
        raise _error("the data end too early")
    if any(s % cols for s in starts):
        raise ImageError("UNSUPPORTED_JPEG", "a restart inside a row")
    first = {s // cols for s in starts}
    d = diff.reshape(rows, cols, n)
    out = np.zeros((rows, cols, n), np.int64)
    start, mask = 1 << (bits - shift - 1), 0xFFFF
    for y in range(rows):
        if y in first:
            out[y] = (np.cumsum(d[y], 0) + start) & mask
            continue
        up = out[y - 1]
        left = (up[0] + d[y, 0]) & mask
        if select == 1:
            out[y] = (np.cumsum(np.concatenate((left[None], d[y, 1:])), 0)) & mask
        elif select in (2, 3):
            out[y, 0] = left
            out[y, 1:] = (d[y, 1:] + (up[1:] if select == 2 else up[:-1])) & mask
        elif select == 4:
            out[y] = np.cumsum(np.concatenate((left[None], d[y, 1:] + up[1:] - up[:-1])), 0) & mask
        else:
            for j in range(n):
                a, u, row = int(left[j]), up[:, j].tolist(), d[y, :, j].tolist()
                line = [a]
                for x in range(1, cols):
                    b_, c_ = u[x], u[x - 1]
                    p = a + ((b_ - c_) >> 1) if select == 5 else b_ + ((a - c_) >> 1) if select == 6 else (a + b_) >> 1
                    a = (p + row[x]) & mask
                    line.append(a)
                out[y, :, j] = line
    out = (out << shift).astype(np.uint8 if bits <= 8 else np.uint16)
    return out[:, :, 0] if n == 1 else out
