"""Cut lines learned from a recording's segment means: Lloyd-Max levels and mean-shift modes, deterministic, in one dimension."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import frames, symbols
from tidemark.operators.spectral import marks


def robust_spread(v: np.ndarray) -> float:
    """The smaller of the sample deviation and the interquartile range over 1.34; the larger if that is 0, 1 if both are."""
    if len(v) < 2:
        return 1.0
    a, b = float(v.std(ddof=1)), float(np.subtract(*np.quantile(v, [0.75, 0.25]))) / 1.34
    return min(a, b) or max(a, b) or 1.0


def lloyd_max(v: np.ndarray, levels: int, rounds: int = 100) -> np.ndarray:
    """``levels - 1`` cut lines halfway between levels that are the means of their own cells, started from even quantiles.

    Cells of sorted values are index ranges, so a round is a sorted search and differences of one running sum.
    """
    v = np.sort(v)
    total = np.r_[0.0, np.cumsum(v)]
    level = np.unique(np.quantile(v, (np.arange(levels) + 0.5) / levels))
    for _ in range(rounds):
        cut = (level[1:] + level[:-1]) / 2
        at = np.r_[0, np.searchsorted(v, cut, side="left"), len(v)]
        n = np.diff(at)
        fresh = np.where(n > 0, (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1), level)
        if np.abs(fresh - level).max() <= 1e-9 * max(1.0, np.abs(level).max()):
            break
        level = np.unique(fresh)
    return (level[1:] + level[:-1]) / 2


def mean_shift(v: np.ndarray, bandwidth: float, rounds: int = 200) -> np.ndarray:
    """Modes of a flat kernel: every value climbs to the mean of the values within ``bandwidth`` until none moves; modes closer than half of it are one."""
    v = np.sort(v)
    total = np.r_[0.0, np.cumsum(v)]
    here = np.unique(v)
    for _ in range(rounds):
        lo, hi = np.searchsorted(v, here - bandwidth, "left"), np.searchsorted(v, here + bandwidth, "right")
        fresh = (total[hi] - total[lo]) / np.maximum(hi - lo, 1)
        done = np.abs(fresh - here).max() <= 1e-3 * bandwidth
        here = np.unique(fresh)
        if done:
            break
    group = np.r_[0, np.cumsum(np.diff(here) > bandwidth / 2)]
    return np.bincount(group, here) / np.bincount(group)


def mode_cuts(v: np.ndarray) -> np.ndarray:
    """Cut lines halfway between mean-shift modes; the bandwidth is halved until there are two, else normal cut lines for ten symbols."""
    width = robust_spread(v) * 2.3449 * len(v) ** -0.2
    for _ in range(12):
        modes = mean_shift(v, width)
        if len(modes) > 1:
            return (modes[1:] + modes[:-1]) / 2
        width /= 2
    return np.array(symbols.cutlines(10))


def learned_symbols(signal: DataFrame, per_segment: int, how: str = "levels", alphabet: int = 5) -> DataFrame:
    """``recording_id, seg, symbol``: segment means of the scaled recording, cut at learned lines (``levels`` or ``modes``)."""
    means = symbols.paa(frames.z_normalise(signal), per_segment)

    def encode(v: np.ndarray) -> list[tuple]:
        cuts = lloyd_max(v, alphabet) if how == "levels" else mode_cuts(v)
        return [(k, int(s)) for k, s in enumerate(np.searchsorted(cuts, v, side="right"))]

    rows = means.select("recording_id", F.col("seg").alias("idx"), F.col("mean").alias("x"))
    return marks(rows, encode, "seg long, symbol int")
