"""Array kernels over frames shaped (rows, columns[, channels]); no Spark here."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .resample import weights

THUMBNAIL = 512


@dataclass(frozen=True)
class Box:
    left: int
    top: int
    width: int
    height: int

    def union(self, o: Box) -> Box:
        left, top = min(self.left, o.left), min(self.top, o.top)
        return Box(left, top, max(self.left + self.width, o.left + o.width) - left, max(self.top + self.height, o.top + o.height) - top)

    def cut(self, img: np.ndarray) -> np.ndarray:
        return img[self.top : self.top + self.height, self.left : self.left + self.width]


def top_of(dtype: np.dtype) -> float:
    return 1.0 if np.issubdtype(dtype, np.floating) else float(np.iinfo(dtype).max)


def luma(img: np.ndarray) -> np.ndarray:
    """Intensity: grey (with or without alpha) itself, colour by integer weights, alpha ignored."""
    if img.ndim == 2:
        return img
    c = img.shape[2]
    if c <= 2:
        return img[:, :, 0]
    r, g, b = (img[:, :, i].astype(np.float64 if img.dtype.kind == "f" else np.int64) for i in range(3))
    y = r * 2126 + g * 7152 + b * 722
    return (y / 10000).astype(img.dtype) if img.dtype.kind == "f" else (y // 10000).astype(img.dtype)


def foreground(img: np.ndarray, check_max: bool = False) -> np.ndarray:
    y = luma(img)
    fg = y != 0
    return fg & (y != top_of(img.dtype)) if check_max else fg


def crop_box(img: np.ndarray, check_max: bool = False, border: float | None = None) -> Box:
    """The box around the foreground; a border fraction is left out of the search and given back around the result."""
    h, w = img.shape[:2]
    x0, y0, x1, y1, gx, gy = 0, 0, w, h, 0, 0
    if border is not None:
        b = np.float32(border)
        gx, gy = int(np.float32(w) * b), int(np.float32(h) * b)
        x0, y0, x1, y1 = gx, gy, int(np.float32(w) * (np.float32(1) - b)), int(np.float32(h) * (np.float32(1) - b))
    fg = foreground(img, check_max)[y0:y1, x0:x1]
    xs, ys = np.flatnonzero(fg.any(0)), np.flatnonzero(fg.any(1))
    left, right = (int(xs[0]) + x0, int(xs[-1]) + x0) if len(xs) else (0, w - 1)
    top, bottom = (int(ys[0]) + y0, int(ys[-1]) + y0) if len(ys) else (0, h - 1)
    left, top, right, bottom = max(0, left - gx), max(0, top - gy), min(w - 1, right + gx), min(h - 1, bottom + gy)
    return Box(left, top, right - left + 1, bottom - top + 1)


def label_components(mask: np.ndarray) -> np.ndarray:
    """For each set place the smallest row-major index of its 4-connected component, else -1.

    Rows and columns are swept in turn; a sweep gives every run of set places its smallest label.
    """
    h, w = mask.shape
    big = h * w
    lab = np.where(mask, np.arange(big).reshape(h, w), big)

    def starts_of(m):
        flat = m.ravel()
        first = np.ones(flat.size, bool)
        first[1:] = flat[1:] != flat[:-1]
        first[:: m.shape[1]] = True
        return np.flatnonzero(first)

    rows, cols = starts_of(mask), starts_of(np.ascontiguousarray(mask.T))
    while True:
        before = lab
        for starts, turn in ((rows, False), (cols, True)):
            x = np.ascontiguousarray(lab.T if turn else lab)
            low = np.minimum.reduceat(x.ravel(), starts)
            x = np.repeat(low, np.diff(np.append(starts, big))).reshape(x.shape)
            lab = np.where(mask, x.T if turn else x, big)
        if (lab == before).all():
            return np.where(mask, lab, -1)


def to_u8(img: np.ndarray) -> np.ndarray:
    if img.dtype == np.uint8:
        return img
    if img.dtype == np.uint16:
        return ((img.astype(np.uint32) * 255 + 32767) // 65535).astype(np.uint8)
    return np.floor(np.clip(img, 0, 1) * 255 + 0.5).astype(np.uint8)


def component_box(img: np.ndarray, check_max: bool = False, border: float | None = None) -> Box:
    """The box of the largest 4-connected component inside the foreground box; of equal ones the last in row-major order.

    Sides above 512 are reduced (nearest) for labelling and the result mapped back outwards.
    """
    box = crop_box(img, check_max, border)
    thumb = to_u8(luma(box.cut(img)))
    if max(box.width, box.height) > THUMBNAIL:
        s = min(THUMBNAIL / box.width, THUMBNAIL / box.height)
        tw, th = max(1, int(np.floor(box.width * s + 0.5))), max(1, int(np.floor(box.height * s + 0.5)))
        thumb = resize(thumb, tw, th, "nearest")
    th, tw = thumb.shape
    lab = label_components(thumb > 1)
    kinds, counts = np.unique(lab[lab >= 0], return_counts=True)
    if len(kinds):
        best = kinds[len(kinds) - 1 - int(np.argmax(counts[::-1]))]
        ys, xs = np.nonzero(lab == best)
        left, right, top, bottom = int(xs.min()), int(xs.max()), int(ys.min()), int(ys.max())
    else:
        left, right, top, bottom = 0, tw - 1, 0, th - 1
    left, top = min(left * box.width // tw, box.width - 1), min(top * box.height // th, box.height - 1)
    right = max(min(-(-(right + 1) * box.width // tw), box.width), left + 1)
    bottom = max(min(-(-(bottom + 1) * box.height // th), box.height), top + 1)
    return Box(left + box.left, top + box.top, right - left, bottom - top)


def common_box(frames: list[np.ndarray], *, components: bool = False, check_max: bool = False, border: float | None = None) -> Box:
    boxes = [(component_box if components else crop_box)(f, check_max, border) for f in frames]
    out = boxes[0]
    for b in boxes[1:]:
        out = out.union(b)
    return out


def resize(img: np.ndarray, tw: int, th: int, kind: str = "nearest") -> np.ndarray:
    """To tw x th. kinds: nearest, triangle, catmull-rom, gaussian, lanczos3, max-pool."""
    h, w = img.shape[:2]
    if (w, h) == (tw, th):
        return img
    if kind == "nearest":
        ys, xs = np.minimum((2 * np.arange(th) + 1) * h // (2 * th), h - 1), np.minimum((2 * np.arange(tw) + 1) * w // (2 * tw), w - 1)
        return img[ys][:, xs]
    if kind == "max-pool":

        def bounds(n, t):
            a = np.minimum(np.arange(t) * n // t, n - 1)
            return a, np.maximum(a + 1, np.minimum((np.arange(t) + 1) * n // t, n))

        (ya, yz), (xa, xz) = bounds(h, th), bounds(w, tw)
        rows = np.stack([img[a:z].max(0) for a, z in zip(ya, yz)])
        return np.stack([rows[:, a:z].max(1) for a, z in zip(xa, xz)], 1)
    wx, wy = weights(w, tw, kind), weights(h, th, kind)
    out = np.tensordot(wy, np.tensordot(img.astype(np.float64), wx, ([1], [1])), ([1], [0])) if img.ndim == 2 else np.einsum("ay,yxc,bx->abc", wy, img.astype(np.float64), wx)
    if img.dtype.kind == "f":
        return np.clip(out, 0, 1).astype(img.dtype)
    return np.clip(np.floor(out + 0.5), 0, np.iinfo(img.dtype).max).astype(img.dtype)


def fit_size(w: int, h: int, tw: int, th: int, exact: bool = False) -> tuple[np.float32, np.float32, int, int]:
    """(scale x, scale y, width, height) in 32-bit floats."""
    sx, sy = np.float32(tw) / np.float32(w), np.float32(th) / np.float32(h)
    if not exact:
        sx = sy = min(sx, sy)
    return sx, sy, int(np.floor(float(np.float32(w) * sx) + 0.5)), int(np.floor(float(np.float32(h) * sy) + 0.5))


def padding_of(img: np.ndarray, tw: int, th: int, direction: str = "zero") -> tuple[int, int, int, int]:
    """(left, top, right, bottom) to reach tw x th."""
    h, w = img.shape[:2]
    px, py = max(0, tw - w), max(0, th - h)
    if direction == "top-left":
        return px, py, 0, 0
    if direction == "bottom-right":
        return 0, 0, px, py
    if direction == "center":
        return px // 2, py // 2, px - px // 2, py - py // 2
    if direction != "zero":
        raise ValueError(f"unknown padding direction {direction!r}")
    z = luma(img) == 0
    left = 0 if z[:, 0].sum() < z[:, -1].sum() else px
    top = 0 if z[0].sum() < z[-1].sum() else py
    return left, top, px - left, py - top


def pad(img: np.ndarray, p: tuple[int, int, int, int]) -> np.ndarray:
    return np.pad(img, ((p[1], p[3]), (p[0], p[2])) + ((0, 0),) * (img.ndim - 2))


def flip(img: np.ndarray, horizontal: bool, vertical: bool) -> np.ndarray:
    return img[:: -1 if vertical else 1, :: -1 if horizontal else 1]


def convert(img: np.ndarray, dtype: str) -> np.ndarray:
    """u8, u16 or f32 from any of them."""
    if dtype == "u8":
        return to_u8(img)
    if dtype == "u16":
        return img if img.dtype == np.uint16 else img.astype(np.uint16) * np.uint16(257) if img.dtype == np.uint8 else np.floor(np.clip(img, 0, 1) * 65535 + 0.5).astype(np.uint16)
    if dtype == "f32":
        return img.astype(np.float32) if img.dtype.kind == "f" else img.astype(np.float32) / np.float32(np.iinfo(img.dtype).max)
    raise ValueError(f"unknown sample type {dtype!r}")
