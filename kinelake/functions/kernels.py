"""One-dimensional filters and detectors on numpy arrays, written from their published definitions.

A series is an array with NaN for missing values.  ``zero_missing`` also treats
exact zeros as missing, as trajectories padded with zeros need.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def runs(valid: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of consecutive true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], valid.astype(np.int8), [0]])))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def on_runs(x: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray], longer_than: int, zero_missing: bool = False) -> np.ndarray:
    """``kernel`` applied to each run of valid values with more than ``longer_than``; the rest stays."""
    x = np.asarray(x, dtype=float)
    valid = np.isfinite(x) & ((x != 0) if zero_missing else True)
    out = x.copy()
    for a, b in runs(valid):
        if b - a > longer_than:
            out[a:b] = kernel(x[a:b])
    return out


def butterworth_sections(order: int, cutoff: float, rate: float, high: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Transfer function b, a of a digital Butterworth filter (bilinear transform with pre-warping)."""
    if not 0 < cutoff < rate / 2:
        raise ValueError("the cutoff must lie between zero and half the sampling rate")
    warped = 2 * rate * math.tan(math.pi * cutoff / rate)
    unit = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    poles = warped / unit if high else warped * unit
    digital = (2 * rate + poles) / (2 * rate - poles)
    b = np.poly(np.full(order, 1.0 if high else -1.0))
    a = np.poly(digital).real
    at = (-1.0) ** np.arange(order + 1) if high else np.ones(order + 1)
    return b * ((a @ at) / (b @ at)), a


def recursive_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed."""
    z, y = state.astype(float).copy(), np.empty(len(x))
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:-1] * v - a[1:-1] * y[i]
        z[-1] = b[-1] * v - a[-1] * y[i]
    return y


def settled_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State of the filter after a long input of ones."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension and settled start."""
    pad = 3 * max(len(a), len(b))
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    zi = settled_state(b, a)
    y = recursive_filter(b, a, ext, zi * ext[0])[::-1]
    return recursive_filter(b, a, y, zi * y[0])[::-1][pad:-pad]


def butterworth(x: np.ndarray, rate: float, cutoff: float = 6.0, order: int = 4, high: bool = False, zero_missing: bool = True) -> np.ndarray:
    """Zero-phase Butterworth: half the order forward, half backward, on runs longer than the padding."""
    b, a = butterworth_sections(max(1, order // 2), cutoff, rate, high)
    return on_runs(x, lambda v: zero_phase(b, a, v), 3 * max(len(a), len(b)), zero_missing)


def butterworth_on_speed(x: np.ndarray, rate: float, cutoff: float = 10.0, order: int = 4) -> np.ndarray:
    """Butterworth on the differences, added up again from the first value."""
    x = np.asarray(x, dtype=float)
    if len(x) < 2:
        return x.copy()
    d = np.diff(x, prepend=np.nan)
    d = np.where(np.isnan(d), (d[1] if len(d) > 1 else 0.0) / 2, d)
    return np.cumsum(butterworth(d, rate, cutoff, order)) + x[0]


def gaussian(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with mirrored edges; the kernel ends at four sigmas."""
    x = np.asarray(x, dtype=float)
    radius = int(4 * sigma + 0.5)
    if not len(x) or not radius:
        return x.copy()
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, radius, mode="symmetric"), k / k.sum(), mode="valid")


def median(x: np.ndarray, size: int = 3) -> np.ndarray:
    """Running median over an odd window with zeros beyond the ends."""
    half = size // 2
    padded = np.pad(np.asarray(x, dtype=float), half)
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, size), axis=-1) if len(x) else padded[:0]


def lowess(x: np.ndarray, size: int = 5) -> np.ndarray:
    """Local linear regression over the ``size`` nearest samples with tricube weights, on runs longer than that."""

    def smooth(v: np.ndarray) -> np.ndarray:
        n, t, out = len(v), np.arange(len(v), dtype=float), np.empty(len(v))
        k = min(n, max(2, int(size / n * n + 1e-10)))
        left = 0
        for i in range(n):
            while left + k < n and t[left + k] - t[i] < t[i] - t[left]:
                left += 1
            at = slice(left, left + k)
            reach = max(t[i] - t[left], t[left + k - 1] - t[i])
            u = np.abs(t[at] - t[i]) / reach
            w = np.where(u < 0.999, (1 - u**3) ** 3, 0.0)
            w = np.where(u <= 0.001, 1.0, w)
            w /= w.sum()
            mean = w @ t[at]
            spread = w @ (t[at] - mean) ** 2
            slope = (w * (t[at] - mean)) @ v[at] / spread if spread > 1e-12 else 0.0
            out[i] = w @ v[at] + slope * (t[i] - mean)
        return out

    return on_runs(x, smooth, size)


def kalman(x: np.ndarray, rate: float, trust: float = 500.0, measurement: float = 20.0, smooth: bool = True) -> np.ndarray:
    """Constant-acceleration Kalman filter with optional Rauch-Tung-Striebel smoothing, on runs of three or more."""
    dt = 1 / rate
    f = np.array([[1, dt, dt * dt / 2], [0, 1, dt], [0, 0, 1]])
    g = np.array([dt * dt / 2, dt, 1])
    q = np.outer(g, g) * (measurement * trust) ** 2
    h, r = np.array([1.0, 0, 0]), measurement**2

    def run(v: np.ndarray) -> np.ndarray:
        s = np.array([v[0], (v[1] - v[0]) / dt, (v[2] - 2 * v[1] + v[0]) / dt**2])
        p = np.eye(3) * measurement
        kept, spreads = np.empty((len(v), 3)), np.empty((len(v), 3, 3))
        for i, z in enumerate(v):
            s, p = f @ s, f @ p @ f.T + q
            gain = p @ h / (h @ p @ h + r)
            s = s + gain * (z - h @ s)
            m = np.eye(3) - np.outer(gain, h)
            p = m @ p @ m.T + np.outer(gain, gain) * r
            kept[i], spreads[i] = s, p
        if smooth:
            for i in range(len(v) - 2, -1, -1):
                ahead = f @ spreads[i] @ f.T + q
                c = np.linalg.solve(ahead, f @ spreads[i]).T
                kept[i] += c @ (kept[i + 1] - f @ kept[i])
                spreads[i] += c @ (spreads[i + 1] - ahead) @ c.T
        return kept[:, 0]

    return on_runs(x, run, 2, zero_missing=True)


def one_euro(x: np.ndarray, rate: float, cutoff: float = 4.0, beta: float = 1.5, d_cutoff: float = 1.0) -> np.ndarray:
    """Zero-phase One-Euro filter: forward, then backward, on runs of two or more."""

    def alpha(c: float) -> float:
        r = 2 * math.pi * c / rate
        return r / (r + 1)

    def sweep(v: np.ndarray) -> np.ndarray:
        out, speed = v.copy(), 0.0
        for i in range(1, len(v)):
            a = alpha(d_cutoff)
            speed = a * (v[i] - out[i - 1]) * rate + (1 - a) * speed
            a = alpha(cutoff + beta * abs(speed))
            out[i] = a * v[i] + (1 - a) * out[i - 1]
        return out

    return on_runs(x, lambda v: sweep(sweep(v)[::-1])[::-1], 1)


def smoothing_spline(y: np.ndarray, smoothing: float) -> np.ndarray:
    """Natural cubic smoothing spline at unit steps: minimises |y - s|^2 + smoothing times the integral of s''^2."""
    values, vectors = _bending_modes(len(y))
    return vectors @ (vectors.T @ y / (1 + smoothing * values))


_modes: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _bending_modes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the bending energy of the natural cubic spline through n values."""
    if n not in _modes:
        d = np.diff(np.eye(n), 2, axis=0)
        r = (4 * np.eye(n - 2) + np.eye(n - 2, k=1) + np.eye(n - 2, k=-1)) / 6
        if len(_modes) > 8:
            _modes.clear()
        values, vectors = np.linalg.eigh(d.T @ np.linalg.solve(r, d))
        _modes[n] = np.maximum(values, 0.0), vectors
    return _modes[n]


def gcv_spline(x: np.ndarray, rate: float, cutoff: float | None = None, factor: float = 1.0) -> np.ndarray:
    """Smoothing spline on runs of five or more; the amount minimises generalised cross-validation, or follows a cutoff.

    With a cutoff the smoothing is (rate / (2 pi cutoff))^4; otherwise the run is
    first put on a robust scale (median, 1.4826 median deviations).
    """

    def run(v: np.ndarray) -> np.ndarray:
        if cutoff:
            return smoothing_spline(v, (rate / (2 * math.pi * cutoff)) ** 4 * factor)
        centre = np.median(v)
        spread = 1.4826 * np.median(np.abs(v - centre)) or 1.0
        y = (v - centre) / spread
        values, vectors = _bending_modes(len(y))
        z = vectors.T @ y
        score = lambda e: _gcv(values, z, 10.0**e)
        best = 10.0 ** _least(score, min(np.arange(-6, 8.01, 0.25), key=score), 0.25)
        return vectors @ (z / (1 + best * factor * values)) * spread + centre

    return on_runs(x, run, 4, zero_missing=True)


def _least(f: Callable[[float], float], at: float, reach: float) -> float:
    """Where ``f`` is least within ``reach`` of ``at``, by golden sections."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = at - reach, at + reach
    while b - a > 1e-7:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if f(c) < f(d) else (c, b)
    return (a + b) / 2


def _gcv(values: np.ndarray, z: np.ndarray, smoothing: float) -> float:
    keep = 1 / (1 + smoothing * values)
    n = len(z)
    return float(n * ((1 - keep) * z @ ((1 - keep) * z)) / max(n - keep.sum(), 1e-9) ** 2)


def hampel(x: np.ndarray, size: int = 7, sigmas: float = 2.0, skip_missing: bool = False) -> np.ndarray:
    """Outliers replaced by the window's median; by default windows with a gap and the ends stay."""
    x = np.asarray(x, dtype=float)
    out, half = x.copy(), size // 2
    for i in range(half, len(x) - half):
        w = x[i - half : i + half + 1]
        if skip_missing:
            w = w[np.isfinite(w)]
        if not len(w) or not np.isfinite(w).all():
            continue
        m = np.median(w)
        spread = np.median(np.abs(w - m))
        if spread > 0 and abs(0.6745 * (x[i] - m) / spread) > sigmas:
            out[i] = m
    return out


def interpolate(x: np.ndarray, most: int | None = None, kind: str = "linear") -> np.ndarray:
    """Gaps of up to ``most`` samples filled; missing are NaN and zero, and at least five good samples are needed."""
    x = np.asarray(x, dtype=float)
    good = np.isfinite(x) & (x != 0)
    if good.sum() <= 4:
        return x.copy()
    t = np.arange(len(x), dtype=float)
    at = np.flatnonzero(good)
    if kind in ("linear", "slinear"):
        filled = np.interp(t, t[at], x[at], left=np.nan, right=np.nan)
    else:
        filled = _spline(t[at], x[at], t, 2 if kind == "quadratic" else 3)
    out = np.where(good, x, filled)
    for a, b in runs(~good):
        if most is not None and b - a > most:
            out[a:b] = np.nan
    return out


def _spline(t: np.ndarray, y: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """Interpolating spline of degree 2 or 3 through all points, NaN outside them."""
    n = len(t)
    if degree == 2:
        inner = (t[1:-2] + t[2:-1]) / 2
    else:
        inner = t[2:-2]
    knots = np.concatenate([np.full(degree + 1, t[0]), inner, np.full(degree + 1, t[-1])])
    c = np.linalg.solve(_basis(knots, degree, t, n), y)
    inside = (at >= t[0]) & (at <= t[-1])
    out = np.full(len(at), np.nan)
    out[inside] = _basis(knots, degree, at[inside], n) @ c
    return out


def _basis(knots: np.ndarray, degree: int, t: np.ndarray, n: int) -> np.ndarray:
    """B-spline basis values by the Cox-de Boor recursion."""
    b = ((knots[:-1] <= t[:, None]) & (t[:, None] < knots[1:])).astype(float)
    last = np.flatnonzero(knots[:-1] < knots[1:])[-1]
    b[t == knots[-1], last] = 1.0
    for d in range(1, degree + 1):
        left, right = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.where(left > 0, (t[:, None] - knots[: -d - 1]) / left, 0.0)
            v = np.where(right > 0, (knots[d + 1 :] - t[:, None]) / right, 0.0)
        b = u * b[:, :-1] + v * b[:, 1:]
    return b[:, :n]


def peaks(x: np.ndarray, prominence: float) -> list[int]:
    """Local maxima (middle of a plateau) that rise at least ``prominence`` above the higher of their valleys."""
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j
        i += 1

    def base(step: int, k: int) -> float:
        low, m = x[k], k
        while 0 <= m < n and x[m] <= x[k]:
            low = min(low, x[m])
            m += step
        return low

    return [k for k in out if x[k] - max(base(-1, k), base(1, k)) >= prominence]


def alternate(on: list[float], off: list[float], keep: str = "last") -> tuple[list[float], list[float]]:
    """Two event lists that take turns: of several events of a kind in a row, the first or last stays."""
    events = sorted([(t, 0) for t in on] + [(t, 1) for t in off])
    out: list[tuple[float, int]] = []
    for e in events:
        if out and out[-1][1] == e[1]:
            if keep == "last":
                out[-1] = e
            continue
        out.append(e)
    return [t for t, k in out if k == 0], [t for t, k in out if k == 1]
