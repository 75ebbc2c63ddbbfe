"""Weight tables of separable resampling filters."""

from __future__ import annotations

import numpy as np


def _sinc(x):
    return np.sinc(x)


#: (support, kernel) of each filter.
FILTERS = {
    "triangle": (1.0, lambda x: np.maximum(0, 1 - np.abs(x))),
    "catmull-rom": (2.0, lambda x: _cubic(np.abs(x))),
    "gaussian": (3.0, lambda x: np.exp(-(x**2) / (2 * 0.5**2)) / (np.sqrt(2 * np.pi) * 0.5)),
    "lanczos3": (3.0, lambda x: np.where(np.abs(x) < 3, _sinc(x) * _sinc(x / 3), 0)),
}


def _cubic(a):
    """The Catmull-Rom spline (b = 0, c = 1/2)."""
    near = 1.5 * a**3 - 2.5 * a**2 + 1
    far = -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2
    return np.where(a < 1, near, np.where(a < 2, far, 0))


def weights(src: int, dst: int, kind: str) -> np.ndarray:
    """dst x src weights, rows summing to one; on reduction the kernel is widened by the ratio."""
    if kind == "nearest":
        out = np.zeros((dst, src))
        out[np.arange(dst), np.minimum((2 * np.arange(dst) + 1) * src // (2 * dst), src - 1)] = 1
        return out
    support, kernel = FILTERS[kind]
    ratio = src / dst
    wide = max(ratio, 1.0)
    out = np.zeros((dst, src))
    for i in range(dst):
        centre = (i + 0.5) * ratio
        lo = max(0, min(int(np.floor(centre - support * wide)), src - 1))
        hi = max(lo + 1, min(int(np.ceil(centre + support * wide)), src))
        j = np.arange(lo, hi)
        w = kernel((j + 0.5 - centre) / wide)
        out[i, lo:hi] = w / w.sum()
    return out
