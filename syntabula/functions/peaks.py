"""Peak finding and kernel sums on one short curve or one batch of values (numpy)."""

from __future__ import annotations

import numpy as np


def local_maxima(y: np.ndarray) -> np.ndarray:
    """Indices of strict maxima; a plateau gives its middle. Curve ends never count."""
    if len(y) < 3:
        return np.empty(0, dtype=int)
    runs = np.flatnonzero(np.diff(y) != 0)
    first, last = np.r_[0, runs + 1], np.r_[runs, len(y) - 1]
    level = y[first]
    inner = np.arange(1, len(level) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    return (first[top] + last[top]) // 2


def keep_distant(peaks: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Drop peaks nearer than distance to a higher kept one."""
    keep = np.ones(len(peaks), dtype=bool)
    for j in np.argsort(height, kind="stable")[::-1]:
        if keep[j]:
            near = np.abs(peaks - peaks[j]) < distance
            near[j] = False
            keep &= ~near
    return peaks[keep]


def prominence(y: np.ndarray, peak: int) -> float:
    """Height above the higher of the two lowest points before higher ground or the end."""
    left = np.flatnonzero(y[:peak] > y[peak])
    right = np.flatnonzero(y[peak + 1 :] > y[peak])
    lo = left[-1] + 1 if len(left) else 0
    hi = peak + 1 + right[0] if len(right) else len(y)
    return float(y[peak] - max(y[lo : peak + 1].min(), y[peak:hi].min()))


def find_peaks(y: np.ndarray, distance: int, min_prominence: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices and prominences: distance rule first, prominence rule last."""
    peaks = local_maxima(y)
    peaks = keep_distant(peaks, y[peaks], distance)
    found = np.array([prominence(y, p) for p in peaks])
    ok = found >= min_prominence if len(found) else np.zeros(0, dtype=bool)
    return peaks[ok], found[ok]


def kernel_sum(grid: np.ndarray, x: np.ndarray, weight: np.ndarray, width: float, rows: int = 1024) -> np.ndarray:
    """Sum over x of weight * exp(-((grid - x) / width)^2 / 2)."""
    total = np.zeros(len(grid))
    for i in range(0, len(x), rows):
        z = (grid[:, None] - x[None, i : i + rows]) / width
        np.multiply(z, z, out=z)
        z *= -0.5
        np.exp(z, out=z)
        total += z @ weight[i : i + rows]
    return total
