"""Scalar measures of windows: NumPy functions for what SQL cannot express, applied in Arrow batches of whole windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_window(samples: DataFrame, key: list[str], measures: dict[str, Callable[[np.ndarray], float]]) -> DataFrame:
    """``key`` and one double per measure; a measure that fails or is undefined is NaN (attempted), never null."""
    lists = samples.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("_xs"))
    schema = ", ".join([f"{k} {dict(lists.dtypes)[k]}" for k in key] + [f"{m} double" for m in measures])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column("_xs")
            at, flat = np.asarray(xs.offsets), np.asarray(xs.values, dtype=float)
            cols = [batch.column(k) for k in key]
            for f in measures.values():
                vals = []
                for a, z in zip(at[:-1], at[1:]):
                    try:
                        vals.append(float(f(flat[a:z])))
                    except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError):
                        vals.append(math.nan)
                cols.append(pa.array(vals, pa.float64()))
            yield pa.RecordBatch.from_arrays(cols, names=[*key, *measures])

    return lists.mapInArrow(run, schema)


def bits(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def spectral_entropy(x: np.ndarray) -> float:
    """Bits over the power of the one-sided spectrum, the constant term included."""
    power = np.abs(np.fft.rfft(x)) ** 2
    return bits(power / power.sum()) if power.sum() > 0 else math.nan


def svd_entropy(x: np.ndarray, order: int = 3) -> float:
    """Bits over the singular values of the matrix of ``order`` delays."""
    if len(x) < order or np.isnan(x).any():
        return math.nan
    s = np.linalg.svd(np.lib.stride_tricks.sliding_window_view(x, order), compute_uv=False)
    return bits(s / s.sum()) if s.sum() > 0 else math.nan


def matches(x: np.ndarray, m: int, count: int, r: float) -> np.ndarray:
    """For each of ``count`` templates of length m, how many lie within r in every element, itself included."""
    t = np.lib.stride_tricks.sliding_window_view(x, m)[:count]
    near = np.ones((count, count), bool)
    for k in range(m):
        near &= np.abs(t[:, k, None] - t[None, :, k]) <= r
    return near.sum(1)


def approximate_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """The logarithm of the mean match count, at m less at m + 1; self-matches count."""
    n = len(x)
    if n < m + 2:
        return math.nan
    tol = r * x.std()

    def phi(k: int) -> float:
        c = n - k + 1
        return math.log(matches(x, k, c, tol).sum() / c)

    return phi(m) - phi(m + 1)


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """-ln(A / B) without self-matches, of n - m templates for B and n - m - 1 for A."""
    n = len(x)
    if n < m + 3:
        return math.nan
    tol = r * x.std()
    b = matches(x, m, n - m, tol).sum() - (n - m)
    a = matches(x, m + 1, n - m - 1, tol).sum() - (n - m - 1)
    return -math.log(a / b) if a > 0 and b > 0 else math.nan


def lz76(bits_: np.ndarray) -> int:
    """Number of components of the exhaustive history of a sequence."""
    s = "".join("1" if b else "0" for b in bits_)
    n, i, c = len(s), 0, 0
    while i < n:
        k = 1
        while i + k <= n and s[i : i + k] in s[: i + k - 1]:
            k += 1
        c, i = c + 1, i + k
    return c


def lempel_ziv(x: np.ndarray) -> float:
    """Components of the sequence x > median, over n / log2 n."""
    n = len(x)
    return lz76(x > np.median(x)) / (n / math.log2(n)) if n > 1 else math.nan


def train_complexity(spans: list[tuple[int, int]], n: int) -> float:
    """Components of the sequence of ``n`` samples that is 1 within the spans (ends included), over n / log2 n; 0 for one sample or none."""
    if n <= 1:
        return 0.0
    edge = np.zeros(n + 1, np.int64)
    for a, z in spans:
        a, z = max(a, 0), min(z + 1, n)
        if z > a:
            edge[a] += 1
            edge[z] -= 1
    return lz76(np.cumsum(edge[:-1]) > 0) / (n / math.log2(n))


def kolmogorov(lz: float) -> float:
    """The same in nats."""
    return lz * math.log(2)


def per_entropy(lz: float, entropy: float) -> float:
    """Complexity over entropy, NaN where there is none."""
    return math.nan if abs(entropy) < 1e-10 else lz / entropy


def prominences(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strict local maxima and how far each stands above the higher of its two surrounding lows."""
    peaks = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1
    out = []
    for p in peaks:
        above = np.flatnonzero(x > x[p])
        left, right = above[above < p], above[above > p]
        lo = x[(left[-1] + 1 if len(left) else 0) : p + 1].min()
        hi = x[p : (right[0] if len(right) else len(x))].min()
        out.append(x[p] - max(lo, hi))
    return peaks, np.array(out)


def half_width(x: np.ndarray) -> float:
    """Samples from the most prominent peak to half its prominence, on the steeper side; NaN without a peak."""
    peaks, prom = prominences(x)
    if not len(peaks):
        return math.nan
    k = int(np.argmax(prom))
    p, level = peaks[k], x[peaks[k]] - prom[k] / 2
    sides = []
    for step in (-1, 1):
        i = p
        while 0 <= i + step < len(x) and x[i + step] > level:
            i += step
        j = i + step
        if 0 <= j < len(x):
            sides.append(abs(i - p) + (x[i] - level) / (x[i] - x[j]))
    return min(sides) if sides else math.nan


def stft_log_spectrum(x: np.ndarray, window: int, hop: int, bands: int = 64) -> np.ndarray:
    """Mean power in log-spaced, half-open bands of a Hann short-time spectrum without padding."""
    if len(x) < window:
        raise ValueError("shorter than the window")
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop]
    power = (np.abs(np.fft.rfft(frames * w, axis=1)) / w.sum()) ** 2
    f = np.fft.rfftfreq(window)
    edges = np.geomspace(f[1], f[-1], bands + 1)
    which = np.searchsorted(edges, f, side="right") - 1
    out = np.zeros(bands)
    for b in range(bands):
        if (which == b).any():
            out[b] = power[:, which == b].mean()
    return out


FAST = {"spectral_entropy": spectral_entropy, "svd_entropy": svd_entropy, "lempel_ziv": lempel_ziv, "half_width": half_width}
SLOW = {"approximate_entropy": approximate_entropy, "sample_entropy": sample_entropy}
