"""Whole-signal transforms and detectors in NumPy, one recording per task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_recording(signal: DataFrame, f: Callable[[np.ndarray], np.ndarray], name: str = "x") -> DataFrame:
    """``recording_id, idx, name``: ``f`` maps a recording's values to as many values."""
    lists = signal.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("pts"))
    kind = dict(signal.dtypes)["recording_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                pts = batch.column("pts")[k].values
                y = np.asarray(f(np.asarray(pts.field("x"), dtype=float)), dtype=float)
                yield pa.RecordBatch.from_arrays([batch.column("recording_id").take(pa.array(np.full(len(y), k))), pts.field("idx"), pa.array(y)], names=["recording_id", "idx", name])

    return lists.mapInArrow(run, f"recording_id {kind}, idx long, {name} double")


def marks(signal: DataFrame, f: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """``recording_id`` and the columns of ``schema``: ``f`` maps a recording's values to rows."""
    lists = signal.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("xs"))
    kind = dict(signal.dtypes)["recording_id"]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(rec, *row) for rec, xs in zip(pdf["recording_id"], pdf["xs"]) for row in f(np.asarray(xs, dtype=float))]
            yield pd.DataFrame(rows, columns=["recording_id", *names])

    return lists.mapInPandas(run, f"recording_id {kind}, {schema}")


# ---------------------------------------------------------------- filters


def butterworth(order: int, low: float | None, high: float | None, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital Butterworth low-, high- or band-pass by the bilinear transform."""
    for cut in (low, high):
        if cut is not None and not 0 < cut < fs / 2:
            raise ValueError(f"cut-off {cut} is not between 0 and {fs / 2}")
    poles = np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    zeros, gain = np.zeros(0, complex), 1.0
    warp = lambda f: 2 * math.tan(math.pi * f / fs)
    if low is None and high is not None:
        w = warp(high)
        poles, gain = poles * w, w**order
    elif high is None and low is not None:
        w = warp(low)
        gain = float(np.real(1 / np.prod(-poles)))
        poles, zeros = w / poles, np.zeros(order, complex)
    else:
        w1, w2 = warp(low), warp(high)
        bw, w0 = w2 - w1, math.sqrt(w1 * w2)
        half = poles * bw / 2
        root = np.sqrt(half**2 - w0**2)
        poles, zeros, gain = np.r_[half + root, half - root], np.zeros(order, complex), bw**order
    gain *= float(np.real(np.prod(2 - zeros) / np.prod(2 - poles)))
    z = np.r_[(2 + zeros) / (2 - zeros), -np.ones(len(poles) - len(zeros))]
    p = (2 + poles) / (2 - poles)
    return np.real(gain * np.poly(z)), np.real(np.poly(p))


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed."""
    b, a = b / a[0], a / a[0]
    z = state.copy()
    y = np.empty_like(x)
    for k, v in enumerate(x):
        out = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:-1] * v - a[1:-1] * out
        z[-1] = b[-1] * v - a[-1] * out
        y[k] = out
    return y


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering, with odd extension and a steady initial state."""
    n = max(len(a), len(b))
    pad = min(3 * n, len(x) - 1)
    if pad < 1:
        return x.copy()
    ext = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    companion = np.eye(n - 1, k=-1)
    companion[0] = -a[1:] / a[0]
    steady = np.linalg.solve(np.eye(n - 1) - companion.T, b[1:] / a[0] - a[1:] / a[0] * b[0] / a[0])
    y = lfilter(b, a, ext, steady * ext[0])[::-1]
    y = lfilter(b, a, y, steady * y[0])[::-1]
    return y[pad : pad + len(x)]


def filtered(signal: DataFrame, fs: float, low: float | None = None, high: float | None = None, order: int = 4) -> DataFrame:
    b, a = butterworth(order, low, high, fs)
    return per_recording(signal, lambda x: zero_phase(b, a, x))


# ---------------------------------------------------------------- wavelets and envelopes


def morse_energy(x: np.ndarray, scales: int = 64, beta: float = 20.0, gamma: float = 3.0) -> np.ndarray:
    """Summed magnitude over log-spaced scales of a generalised Morse wavelet transform, each scale brought to [0, 1]."""
    n = len(x)
    if n < 4:
        return np.zeros(n)
    w = 2 * np.pi * np.fft.rfftfreq(n)
    peak = (beta / gamma) ** (1 / gamma)
    total = np.zeros(n)
    spectrum = np.fft.rfft(x - x.mean())
    for s in np.geomspace(peak / np.pi, peak * n / (4 * np.pi), scales):
        sw = s * w
        with np.errstate(divide="ignore"):
            psi = np.where(sw > 0, np.exp(beta * np.log(np.maximum(sw, 1e-300)) - sw**gamma - beta * math.log(peak) + peak**gamma), 0.0)
        mag = np.abs(np.fft.irfft(spectrum * psi, n))
        spread = mag.max() - mag.min()
        total += (mag - mag.min()) / spread if spread > 0 else 0.0
    return total


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal of the mean-free values."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x - x.mean()) * h))


# ---------------------------------------------------------------- change points


def pelt_l2(x: np.ndarray, penalty: float, min_size: int = 2, jump: int = 5) -> list[int]:
    """Breakpoints of the least-squares segmentation with a penalty per break; candidates at multiples of ``jump``."""
    n = len(x)
    s, q = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]
    ends = [k for k in range(0, n, jump) if k >= min_size] + [n]
    best, back = {0: -penalty}, {0: 0}
    alive = [0]
    for e in ends:
        starts = np.array([a for a in alive if e - a >= min_size], int)
        if not len(starts):
            continue
        cost = q[e] - q[starts] - (s[e] - s[starts]) ** 2 / (e - starts)
        total = np.array([best[a] for a in starts]) + cost + penalty
        k = int(total.argmin())
        best[e], back[e] = float(total[k]), int(starts[k])
        dead = {int(a) for a, t in zip(starts, total) if t - penalty > best[e]}
        alive = [a for a in alive if a not in dead] + [e]
    out, e = [], n
    while e in back and e > 0:
        e = back[e]
        if e > 0:
            out.append(e)
    return out[::-1]


class Cost:
    """Cost of a stretch [a, z) by running sums: ``l2``, squared deviations from its mean; ``normal``, its length times the logarithm of its variance."""

    def __init__(self, x: np.ndarray, kind: str = "l2") -> None:
        if kind not in ("l2", "normal"):
            raise ValueError(f"no cost {kind}")
        self.kind, self.s, self.q = kind, np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]

    def __call__(self, a, z):
        n = np.maximum(np.subtract(z, a), 1)
        rest = np.maximum(self.q[z] - self.q[a] - (self.s[z] - self.s[a]) ** 2 / n, 0)
        return rest if self.kind == "l2" else n * np.log(rest / n + 1e-6)


def best_cut(cost: Cost, a: int, z: int, min_size: int, jump: int) -> tuple[float, int]:
    """The largest gain of cutting [a, z) at a multiple of ``jump``, and where; minus infinity if it is too short."""
    at = np.arange(-(-(a + min_size) // jump) * jump, z - min_size + 1, jump)
    if not len(at):
        return -np.inf, -1
    gain = cost(a, z) - cost(np.full(len(at), a), at) - cost(at, np.full(len(at), z))
    k = int(gain.argmax())
    return float(gain[k]), int(at[k])


def binary_cuts(x: np.ndarray, penalty: float | None = None, breaks: int | None = None, kind: str = "l2", min_size: int = 2, jump: int = 5) -> list[int]:
    """Top down: the best cut of any stretch, again and again, until there are ``breaks`` or the gain is below ``penalty``."""
    cost = Cost(x, kind)
    todo = {(0, len(x)): best_cut(cost, 0, len(x), min_size, jump)}
    out: list[int] = []
    while todo and (breaks is None or len(out) < breaks):
        (a, z), (gain, at) = max(todo.items(), key=lambda s: s[1][0])
        if not np.isfinite(gain) or (penalty is not None and gain < penalty):
            break
        del todo[a, z]
        for side in ((a, at), (at, z)):
            todo[side] = best_cut(cost, *side, min_size, jump)
        out.append(at)
    return sorted(out)


def merged_cuts(x: np.ndarray, penalty: float | None = None, breaks: int | None = None, kind: str = "l2", min_size: int = 2, jump: int = 5) -> list[int]:
    """Bottom up: from a fine grid the cut of least worth is taken out until ``breaks`` are left or the least worth is above ``penalty``."""
    cost, step = Cost(x, kind), -(-max(min_size, jump) // jump) * jump
    edges = [0, *range(step, len(x) - min_size + 1, step), len(x)]
    while len(edges) > 2 and (breaks is None or len(edges) - 2 > breaks):
        e = np.array(edges)
        worth = cost(e[:-2], e[2:]) - cost(e[:-2], e[1:-1]) - cost(e[1:-1], e[2:])
        k = int(worth.argmin())
        if penalty is not None and worth[k] > penalty:
            break
        del edges[k + 1]
    return edges[1:-1]


def window_cuts(x: np.ndarray, penalty: float | None = None, breaks: int | None = None, kind: str = "l2", min_size: int = 2, jump: int = 5, width: int = 100) -> list[int]:
    """By a sliding window: places whose two half windows differ most, the best first, none within half a window of a better one."""
    cost, half = Cost(x, kind), max(width // 2, min_size)
    at = np.arange(-(-half // jump) * jump, len(x) - half + 1, jump)
    if not len(at):
        return []
    score = cost(at - half, at + half) - cost(at - half, at) - cost(at, at + half)
    out: list[int] = []
    for k in np.argsort(-score, kind="stable"):
        if breaks is not None and len(out) == breaks or penalty is not None and score[k] < penalty:
            break
        if score[k] > 0 and all(abs(int(at[k]) - other) > half for other in out):
            out.append(int(at[k]))
    return sorted(out)


ALGORITHMS = {"binary": binary_cuts, "bottom_up": merged_cuts, "window": window_cuts}


def change_points(signal: DataFrame, penalty: float | None = None, min_size: int = 2, jump: int = 5, algorithm: str = "exact", breaks: int | None = None, kind: str = "l2") -> DataFrame:
    """``recording_id, idx``: breakpoints without the recording's end. Either ``penalty`` or ``breaks`` says how many; ``exact`` takes a penalty and the l2 cost."""
    if (penalty is None) == (breaks is None):
        raise ValueError("give a penalty or a number of breaks")
    if algorithm == "exact":
        if penalty is None or kind != "l2":
            raise ValueError("the exact search takes a penalty and the l2 cost")
        return marks(signal, lambda x: [(int(b),) for b in pelt_l2(x, penalty, min_size, jump)], "idx long")
    find = ALGORITHMS[algorithm]
    return marks(signal, lambda x: [(int(b),) for b in find(x, penalty, breaks, kind, min_size, jump)], "idx long")


# ---------------------------------------------------------------- surrogates


def surrogate(x: np.ndarray, seed: int, kind: str = "fourier", block: int = 32, rounds: int = 50) -> np.ndarray:
    """A seeded signal of the same spectrum (``fourier``), spectrum and values (``iaaft``) or local blocks (``bootstrap``)."""
    rng = np.random.default_rng(seed)
    n = len(x)
    if kind == "bootstrap":
        starts = rng.integers(0, max(1, n - block + 1), -(-n // block))
        return np.concatenate([x[s : s + block] for s in starts])[:n]
    mag = np.abs(np.fft.rfft(x))
    phase = np.exp(2j * np.pi * rng.random(len(mag)))
    phase[0] = 1
    if kind == "fourier":
        spec = mag * phase
        spec[0] = x.sum()
        if n % 2 == 0:
            spec[-1] = np.fft.rfft(x)[-1]
        return np.fft.irfft(spec, n)
    if kind != "iaaft":
        raise ValueError(kind)
    ordered, y = np.sort(x), rng.permutation(x)
    for _ in range(rounds):
        spec = np.fft.rfft(y)
        y = np.fft.irfft(mag * np.exp(1j * np.angle(spec)), n)
        y = ordered[np.argsort(np.argsort(y))]
    return y


def edit_search(seed: list[int], text: np.ndarray, wildcard: int = -1) -> np.ndarray:
    """For each end position in ``text``, the least edit distance of ``seed`` to a stretch that ends there (free ends)."""
    col = np.arange(len(seed) + 1, dtype=float)
    out = np.empty(len(text))
    pattern = np.asarray(seed)
    for j, c in enumerate(text):
        new = np.empty_like(col)
        new[0] = 0
        sub = col[:-1] + ((pattern != c) & (pattern != wildcard))
        best = np.minimum(sub, col[1:] + 1)
        for i in range(len(pattern)):
            new[i + 1] = min(best[i], new[i] + 1)
        col = new
        out[j] = col[-1]
    return out
