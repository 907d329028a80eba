"""Ward clustering of a bounded number of rows (centres, shapes), in NumPy on the driver.

All pairs of n rows are needed, so n is limited (``MOST``); for more rows cluster their centres.
"""

from __future__ import annotations

import numpy as np

MOST = 5000


def ward(x: np.ndarray) -> np.ndarray:
    """Merges ``(a, b, height, size)`` in order of height by nearest-neighbour chains; rows are 0 .. n-1, the k-th merge is n + k."""
    n = len(x)
    if n < 2:
        raise ValueError("at least two rows")
    if n > MOST:
        raise ValueError(f"{n} rows are more than {MOST}; cluster their centres instead")
    gap = x[:, None] - x[None]
    d = np.einsum("ijk,ijk->ij", gap, gap) if n * n * x.shape[1] < 5e7 else ((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T).clip(0)
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    alive = np.ones(n, bool)
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        keep, gone = min(a, b), max(a, b)
        merges.append((keep, gone, float(np.sqrt(d[a, b]))))
        other = alive.copy()
        other[[a, b]] = False
        na, nb, no = size[a], size[b], size[other]
        d[keep, other] = ((na + no) * d[a, other] + (nb + no) * d[b, other] - no * d[a, b]) / (na + nb + no)
        d[other, keep] = d[keep, other]
        d[gone], d[:, gone], alive[gone] = np.inf, np.inf, False
        size[keep] = na + nb
    name, count, out = list(range(n)), [1] * n, []
    for k, j in enumerate(sorted(range(n - 1), key=lambda j: (merges[j][2], j))):
        keep, gone, height = merges[j]
        root = [r for r in (keep, gone)]
        count[keep] += count[gone]
        out.append((*sorted((name[root[0]], name[root[1]])), height, count[keep]))
        name[keep] = n + k
    return np.array(out)


def cut(merges: np.ndarray, k: int) -> np.ndarray:
    """Labels 0 .. k-1 in order of first row, after all but the last k - 1 merges."""
    n = len(merges) + 1
    root = list(range(2 * n - 1))
    for j, (a, b, *_) in enumerate(merges[: n - k]):
        root[int(a)] = root[int(b)] = n + j

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    names: dict[int, int] = {}
    return np.array([names.setdefault(top(i), len(names)) for i in range(n)])


def suggest(merges: np.ndarray) -> int:
    """The number of clusters before the largest step in height among the last ten merges."""
    h = merges[-10:, 2]
    return 2 if len(h) < 2 else int(len(h) - np.argmax(np.diff(h)))


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; rows alone in their cluster count 0."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    names = np.unique(labels)
    if len(names) < 2:
        return float("nan")
    mean = np.stack([d[:, labels == c].sum(1) / max(1, (labels == c).sum()) for c in names], 1)
    own = np.searchsorted(names, labels)
    n = np.bincount(own)[own]
    a = mean[np.arange(len(x)), own] * n / np.maximum(n - 1, 1)
    mean[np.arange(len(x)), own] = np.inf
    b = mean.min(1)
    return float(np.where(n > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())
