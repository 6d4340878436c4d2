"""Small numpy routines: filter design, smoothing weights, splines and least squares."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SHAPES = {"flat": np.ones, "hanning": np.hanning, "hamming": np.hamming, "bartlett": np.bartlett, "blackman": np.blackman}


def smoothing_weights(shape: str, length: int) -> list[float]:
    w = SHAPES[shape](length)
    return (w / w.sum()).tolist()


def slope_weights(length: int, at: int = 0) -> list[float]:
    """Weights of a quadratic least-squares slope over `length` samples, `at` samples from the centre."""
    if length < 3 or length % 2 == 0:
        raise ValueError("the window has an odd length of 3 or more")
    k = np.arange(length) - length // 2
    fit = np.linalg.pinv(np.stack([np.ones(length), k, k * k], 1))
    return (fit[1] + 2 * at * fit[2]).tolist()


def butterworth(order: int, cutoff: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital low-pass: analogue prototype poles, prewarped and mapped."""
    warped = 2 * fs * np.tan(np.pi * cutoff / fs)
    k = np.arange(1, order + 1)
    poles = warped * np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    z = (2 * fs + poles) / (2 * fs - poles)
    a = np.real(np.poly(z))
    b = np.poly(-np.ones(order))
    return np.real(b * a.sum() / b.sum()), a


def decay(a: np.ndarray, to: float = 1e-12) -> int:
    """Samples until the filter's response has died down to `to` of its size."""
    r = np.abs(np.roots(a)).max(initial=0.0)
    return 1 if r <= 0 else int(np.ceil(np.log(to) / np.log(min(r, 1 - 1e-9)))) + len(a)


def impulse(b: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
    """The first n values of the filter's impulse response."""
    out = np.zeros(n)
    for k in range(n):
        out[k] = (b[k] if k < len(b) else 0.0) - sum(a[j] * out[k - j] for j in range(1, min(k, len(a) - 1) + 1))
    return out


@lru_cache(256)
def _response(b: tuple, a: tuple) -> np.ndarray:
    """The impulse response till it has died down, once a filter."""
    return impulse(np.array(b), np.array(a), decay(np.array(a)))


def _causal(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x through the response h, as if x[0] had stood for ever before: one product of spectra."""
    long = np.concatenate([np.full(len(h), x[0]), x])
    n = 1 << (len(long) + len(h)).bit_length()
    return np.fft.irfft(np.fft.rfft(long, n) * np.fft.rfft(h, n), n)[len(h) : len(long)]


def zero_phase(b, a, x) -> np.ndarray:
    """Forward and backward pass with odd extension and steady-state starts."""
    n = len(a) - 1
    pad = min(3 * (n + 1), len(x) - 1)
    if pad < 1:
        return np.array(x, float)
    h = _response(tuple(map(float, b)), tuple(map(float, a)))
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = _causal(h, _causal(h, long)[::-1])[::-1]
    return y[pad : len(y) - pad]


def lowpass(x, cutoff, fs, order=2) -> np.ndarray:
    return zero_phase(*butterworth(order, cutoff, fs), np.asarray(x, float))


def lowpass_gaps(x, cutoff, fs, order=2, rounds=5, mean=None) -> np.ndarray:
    """Low-pass of a signal with NaN gaps, filled with the mean and refilled from the last result each round."""
    x = np.asarray(x, float)
    gap = np.isnan(x)
    if gap.all() and mean is None:
        return x.copy()
    y = np.where(gap, x[~gap].mean() if mean is None else mean, x)
    for _ in range(rounds if gap.any() else 0):
        y = np.where(gap, lowpass(y, cutoff, fs, order), x)
    return lowpass(y, cutoff, fs, order)


def pupil_kernel(t, npar=10.1, tmax=930.0) -> np.ndarray:
    """Erlang-gamma response with peak 1 at tmax."""
    u = np.maximum(np.asarray(t, float), 0) / tmax
    return u**npar * np.exp(npar * (1 - u))


@lru_cache(4096)
def kernel_duration(npar, tmax, least=1e-8, step=1.0) -> float:
    t = tmax
    while pupil_kernel(np.array([t]), npar, tmax)[0] > least:
        t += step
    return t


def local_basis(t, knots, degree=3) -> tuple[np.ndarray, np.ndarray]:
    """(first, values): of each t the degree + 1 B-splines that aren't zero there, from column `first` on."""
    t, knots = np.asarray(t, float), np.asarray(knots, float)
    n = len(knots) - degree - 1
    j = np.clip(np.searchsorted(knots, t, "right") - 1, degree, n - 1)
    v = np.zeros((len(t), degree + 1))
    v[:, 0] = 1
    for k in range(1, degree + 1):
        carry = np.zeros(len(t))
        for r in range(k):
            lo, hi = knots[j + r + 1 - k], knots[j + r + 1]
            w = np.divide(v[:, r], hi - lo, out=np.zeros(len(t)), where=hi > lo)
            v[:, r] = carry + (hi - t) * w
            carry = (t - lo) * w
        v[:, k] = carry
    return j - degree, v


def bspline_basis(t, knots, degree=3) -> np.ndarray:
    """Basis matrix; knots with repeated ends."""
    first, v = local_basis(t, knots, degree)
    out = np.zeros((len(v), len(knots) - degree - 1))
    for k in range(degree + 1):
        out[np.arange(len(v)), first + k] += v[:, k]
    return out


def clamped_knots(lo, hi, per_second=1.0) -> np.ndarray:
    """At least two knots between the ends, evenly spaced, and each end four times."""
    n = max(int(np.ceil((hi - lo) / 1000 * per_second)), 2)
    return np.concatenate([[lo] * 4, np.linspace(lo, hi, n + 2)[1:-1], [hi] * 4])


def banded_normal(first, v, weight, y, n) -> tuple[np.ndarray, np.ndarray]:
    """(diagonals 0..degree of the weighted normal matrix, right side) of a local basis."""
    width = v.shape[1]
    band, rhs = np.zeros((width, n)), np.zeros(n)
    for a in range(width):
        rhs += np.bincount(first + a, v[:, a] * weight * y, n)[:n]
        for b in range(a, width):
            band[b - a] += np.bincount(first + a, v[:, a] * v[:, b] * weight, n)[:n]
    return band, rhs


def banded_solve(band, rhs) -> np.ndarray:
    """Solves a symmetric positive system given by its diagonals 0, 1, ... (band[d][i] is entry (i, i + d))."""
    width, n = band.shape
    low, x = np.zeros((n, width)), np.array(rhs, float)
    for i in range(n):
        for d in range(min(width - 1, i), -1, -1):
            k = i - d
            first = max(0, i - width + 1, k - width + 1)
            s = band[d][k] - sum(low[i, i - m] * low[k, k - m] for m in range(first, k))
            low[i, d] = np.sqrt(max(s, 1e-300)) if d == 0 else s / low[k, 0]
        x[i] = (x[i] - sum(low[i, d] * x[i - d] for d in range(1, min(width - 1, i) + 1))) / low[i, 0]
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - sum(low[i + d, d] * x[i + d] for d in range(1, min(width - 1, n - 1 - i) + 1))) / low[i, 0]
    return x


def banded_solve_many(band, rhs) -> np.ndarray:
    """banded_solve of many systems of one size at once: band (systems, diagonals, n), rhs (systems, n)."""
    many, width, n = band.shape
    low, x = np.zeros((n, width, many)), np.array(rhs, float).T.copy()
    band = np.ascontiguousarray(np.moveaxis(band, 0, -1))
    for i in range(n):
        for d in range(min(width - 1, i), -1, -1):
            k = i - d
            s = band[d][k].copy()
            for m in range(max(0, i - width + 1, k - width + 1), k):
                s -= low[i, i - m] * low[k, k - m]
            low[i, d] = np.sqrt(np.maximum(s, 1e-300)) if d == 0 else s / low[k, 0]
        for d in range(1, min(width - 1, i) + 1):
            x[i] -= low[i, d] * x[i - d]
        x[i] /= low[i, 0]
    for i in range(n - 1, -1, -1):
        for d in range(1, min(width - 1, n - 1 - i) + 1):
            x[i] -= low[i + d, d] * x[i + d]
        x[i] /= low[i, 0]
    return x.T


def banded_mean(first, v, coef) -> np.ndarray:
    """Values of the spline."""
    return sum(v[:, k] * coef[first + k] for k in range(v.shape[1]))


def nonnegative(a, y) -> np.ndarray:
    """Non-negative least squares of a dense matrix."""
    a = np.asarray(a, float)
    return nonnegative_gram([{j: float(v) for j, v in enumerate(row)} for row in a.T @ a], a.T @ y)


def nonnegative_gram(gram: list[dict[int, float]], b, rounds: int = 5000, tolerance: float = 1e-12) -> np.ndarray:
    """Non-negative least squares from the sparse rows of the normal matrix, one coordinate at a time."""
    x = np.zeros(len(gram))
    for _ in range(rounds):
        moved = 0.0
        for j, row in enumerate(gram):
            if row.get(j, 0.0) > 0:
                new = max(0.0, x[j] + (b[j] - sum(v * x[k] for k, v in row.items())) / row[j])
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved <= tolerance * max(1.0, np.abs(x).max(initial=0.0)):
            break
    return x


def response_fit(t, y, onsets, npar, tmax) -> tuple[np.ndarray, np.ndarray]:
    """(weights, prediction): non-negative weights of a response to each onset.

    A response is only worked out while it lasts, and only overlapping ones meet.
    """
    last, order = kernel_duration(npar, tmax), np.argsort(onsets, kind="stable")
    on = np.asarray(onsets, float)[order]
    lo, hi = np.searchsorted(t, on, "left"), np.searchsorted(t, on + last, "right")
    h = [pupil_kernel(t[a:b] - o, npar, tmax) for a, b, o in zip(lo, hi, on, strict=True)]
    rhs, gram = np.array([k @ y[a:b] for k, a, b in zip(h, lo, hi, strict=True)]), [{} for _ in on]
    for i in range(len(on)):
        j = i
        while j < len(on) and (lo[j] < hi[i] or j == i):
            a, b = lo[j], min(hi[i], hi[j])
            gram[i][j] = gram[j][i] = float(h[i][a - lo[i] : b - lo[i]] @ h[j][: b - a]) if b > a else 0.0
            j += 1
    x, pred = nonnegative_gram(gram, rhs), np.zeros(len(t))
    for w, k, a, b in zip(x, h, lo, hi, strict=True):
        pred[a:b] += w * k
    out = np.zeros(len(on))
    out[order] = x
    return out, pred


def shrinking_grid(f, lo, hi, sizes, rounds=6, at_once=False) -> np.ndarray:
    """The place of the least f in a box, on a grid that shrinks around its best point; `at_once`: f takes all points, a row each."""
    lo, hi = np.array(lo, float), np.array(hi, float)
    low, high, best = lo.copy(), hi.copy(), None
    for _ in range(rounds):
        axes = [np.linspace(a, b, n) if b > a else np.array([a]) for a, b, n in zip(low, high, sizes, strict=True)]
        points = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, len(axes))
        best = points[int(np.argmin(f(points) if at_once else [f(*p) for p in points]))]
        half = (high - low) / 6
        low, high = np.maximum(best - half, lo), np.minimum(best + half, hi)
    return best


def golden(f, lo, hi, rounds=40) -> float:
    g = (np.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def troughs(x) -> tuple[np.ndarray, np.ndarray]:
    """(index, prominence) of local minima, plateaus at their middle."""
    x = np.asarray(x, float)
    found = []
    i = 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if j < len(x) - 1 and x[i - 1] > x[i] < x[j + 1]:
            found.append((i + j) // 2)
        i = j + 1
    # how high the signal rises on each side before it falls below the trough: stacks of falling values
    k = np.array(found, int)
    return k, np.minimum(_rise(x, k), _rise(x[::-1], len(x) - 1 - k)) - x[k] if len(k) else np.zeros(0)


def _rise(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each place the largest value to its left, back to the last smaller one."""
    want, out, stack = set(at.tolist()), {}, []
    for i, v in enumerate(x.tolist()):
        top = -np.inf
        while stack and stack[-1][0] >= v:
            low, high = stack.pop()
            top = max(top, low, high)
        if i in want:
            out[i] = top
        stack.append((v, top))
    return np.array([out[i] for i in at.tolist()])


def cubic_moments(x, y) -> np.ndarray:
    """Second derivatives at the knots of cubic_spline; up to three points lie on one polynomial."""
    x, y = (np.asarray(v, float) for v in (x, y))
    n, h = len(x), np.diff(x)
    if n < 4:
        return np.full(n, 2 * np.polyfit(x - x[0], y, 2)[0] if n == 3 else 0.0)
    rhs = 6 * np.diff(np.diff(y) / h)
    low, mid, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    for e, o, off in ((0, 1, up), (-1, -2, low)):
        mid[e] += h[e] * (1 + h[e] / h[o])
        off[e] -= h[e] * h[e] / h[o]
    for i in range(1, n - 2):
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        rhs[i] -= f * rhs[i - 1]
    c = np.zeros(n)
    for i in range(n - 3, -1, -1):
        c[i + 1] = (rhs[i] - (up[i] * c[i + 2] if i < n - 3 else 0)) / mid[i]
    c[0] = c[1] + (c[1] - c[2]) * h[0] / h[1]
    c[-1] = c[-2] + (c[-2] - c[-3]) * h[-1] / h[-2]
    return c


def cubic_spline(x, y, at) -> np.ndarray:
    """Cubic spline through (x, y) whose third derivative goes on at the second and the last but one knot."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    n, h = len(x), np.diff(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    c = cubic_moments(x, y)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * c[k] + (b**3 - b) * c[k + 1]) * h[k] ** 2 / 6
