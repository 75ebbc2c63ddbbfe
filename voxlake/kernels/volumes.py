"""Array kernels over volumes: projections, frame resampling, pyramid fusion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

from voxlake.errors import ImageError

BINS = 2048


def same_shape(frames: Sequence[np.ndarray]) -> None:
    for i, f in enumerate(frames):
        if f.shape != frames[0].shape or f.dtype != frames[0].dtype:
            raise ImageError("INCOMPATIBLE_FRAMES", f"frame {i} differs from the first", frame_index=i)


def trim(n: int, skip_start: int = 0, skip_end: int = 0) -> range:
    return range(min(n, skip_start), max(0, n - skip_end))


def max_intensity(frames: Iterable[np.ndarray]) -> np.ndarray:
    """Running maximum; one frame alive besides the result."""
    out = None
    for i, f in enumerate(frames):
        if out is None:
            out = f.copy()
        elif f.shape != out.shape or f.dtype != out.dtype:
            raise ImageError("INCOMPATIBLE_FRAMES", f"frame {i} differs from the first", frame_index=i)
        else:
            np.maximum(out, f, out=out)
    if out is None:
        raise ImageError("EMPTY_VOLUME", "no frame is left to project")
    return out


def interpolated(frames: Iterable[np.ndarray], n: int, target: int) -> Iterator[np.ndarray]:
    """Linear resampling of n frames to `target`; integer samples are truncated. Two frames are alive at a time."""
    if n <= 1 or target <= 1:
        yield from (f for i, f in enumerate(frames) if n <= 1 or i == 0)
        return
    out, before = 0, None
    for j, f in enumerate(alike(frames)):
        while out < target:
            pos = np.float32(np.float32(out) / np.float32(target - 1)) * np.float32(n - 1)
            lo, hi = int(np.floor(pos)), min(int(np.ceil(pos)), n - 1)
            if hi > j:
                break
            a = np.float32(pos - np.float32(lo))
            wide = np.float64 if f.dtype == np.uint16 else np.float32
            x = f if lo == j else before
            yield (x.astype(wide) * (wide(1) - wide(a)) + f.astype(wide) * wide(a)).astype(f.dtype)
            out += 1
        before = f


def interpolate(frames: Sequence[np.ndarray], target: int) -> list[np.ndarray]:
    return list(interpolated(frames, len(frames), target))


def alike(frames: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """The frames, as long as they are like the first."""
    shape = dtype = None
    for i, f in enumerate(frames):
        if i and (f.shape != shape or f.dtype != dtype):
            raise ImageError("INCOMPATIBLE_FRAMES", f"frame {i} differs from the first", frame_index=i)
        shape, dtype = f.shape, f.dtype
        yield f


def blur(x: np.ndarray) -> np.ndarray:
    """[1 4 6 4 1] / 16 in both directions, edges repeated."""
    k = np.array([1, 4, 6, 4, 1], x.dtype) / x.dtype.type(16)
    for axis in (0, 1):
        p = np.pad(x, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = x.shape[axis]
        x = sum(k[i] * (p[i : i + n] if axis == 0 else p[:, i : i + n]) for i in range(5))
    return x


def upsample(x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear with the corners of both grids aligned."""
    for axis in (0, 1):
        n, t = x.shape[axis], shape[axis]
        p = np.arange(t, dtype=x.dtype) * x.dtype.type((n - 1) / (t - 1)) if t > 1 else np.zeros(1, x.dtype)
        lo = np.minimum(np.floor(p).astype(int), n - 1)
        hi = np.minimum(lo + 1, n - 1)
        f = p - lo
        f = (f[:, None] if axis == 0 else f[None]).astype(x.dtype)
        x = np.take(x, lo, axis) * (1 - f) + np.take(x, hi, axis) * f
    return x


def bilateral(x: np.ndarray, sigma_s: float = 3.0, sigma_r: float = 0.015) -> np.ndarray:
    """Edge-keeping blur of values in 0..1; the range weight is read from 2048 steps of the squared difference, taken in f32. Sums are f64."""
    radius = int(np.ceil(2 * sigma_s))
    lut = np.exp(-(np.arange(BINS) / (BINS - 1)) / (2 * sigma_r * sigma_r))
    x = x.astype(np.float32)
    p = np.pad(x, radius, mode="edge")
    h, w = x.shape
    total, norm = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            v = p[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
            d = np.minimum((v - x) * (v - x), np.float32(1))
            wgt = np.exp(-(dx * dx + dy * dy) / (2 * sigma_s * sigma_s)) * lut[np.floor(d * np.float32(BINS - 1) + np.float32(0.5)).astype(int)]
            total += v * wgt
            norm += wgt
    return np.where(norm > 0, total / norm, x)


def fuse(mip: np.ndarray, centre: np.ndarray, mip_weight: float = 1.5) -> np.ndarray:
    """Adds the fine detail of both images, weighted by the centre's coarse level; u16 out. Only the finest level counts."""
    if min(mip.shape) <= 2:
        raise ImageError("TOO_SMALL", "a side of 2 or less has no pyramid")
    m, c = bilateral(mip), bilateral(centre)
    em = upsample(blur(m)[::2, ::2], m.shape)
    ec = upsample(blur(c)[::2, ::2], c.shape)
    return combine(m, c, em, ec, mip_weight)


def combine(m: np.ndarray, c: np.ndarray, em: np.ndarray, ec: np.ndarray, mip_weight: float = 1.5) -> np.ndarray:
    """Both images and what their coarse levels say of them, as u16."""
    out = ec + 2 * ec * ((c - ec) + mip_weight * (m - em))
    return (np.clip(out, 0, 1) * 65535).astype(np.uint16)


def laplacian_mip(frames: Iterable[np.ndarray], *, n: int | None = None, mip_weight: float = 1.5, skip_start: int = 0, skip_end: int = 0, central: str = "parallel-beam") -> np.ndarray:
    """Pyramid fusion of the maximum and a central image of u16 frames, of which one is alive besides these two; n: their number."""
    if central not in ("central-slice", "parallel-beam"):
        raise ValueError(f"unknown projection {central!r}")
    n = len(frames) if n is None else n
    kept = trim(n, skip_start, skip_end)
    if not kept:
        raise ImageError("EMPTY_VOLUME", "no frame is left to project")
    top = total = middle = None
    for i, f in enumerate(alike(f for i, f in enumerate(frames) if i in kept)):
        top = f if top is None else np.maximum(top, f)
        if central == "parallel-beam":
            total = f.astype(np.uint64) if total is None else np.add(total, f, out=total)
        elif i == len(kept) // 2:
            middle = f
    if len(kept) == 1:
        return top
    if central == "central-slice":
        centre = np.asarray(middle, np.float32) / np.float32(65535)
    else:
        centre = total.astype(np.float32)
        centre = centre / centre.max() if centre.max() > 0 else centre
    return fuse(np.asarray(top, np.float32) / np.float32(65535), centre, mip_weight)
