"""Clusters of alike vectors: density clustering over a spatial partition of reduced vectors.

1. Space is cut into cells by a tree of single-axis cuts, fitted on a bounded sample and placed where few vectors are near; where the tree's cells would still hold
   too many, a grid over the first principal axes cuts them further. A projection never lengthens a distance, so two alike vectors are at most ``eps`` apart on
   every axis. A vector within ``eps`` below a cut goes to both sides: two alike vectors meet in at least one cell. The sample shapes cells, not results.
2. A cell with many rows is cut into chunks of bounded size. In each chunk, balls of radius ``eps`` around pivots are taken in id order until every
   vector is in one; a pivot is a core point, all of its ball belongs to its cluster. A dense cell thus costs rows times pivots, not rows squared.
   Balls whose pivots are close enough for members to be alike are compared member by member.
3. Pivots of a cell's chunks are covered again in the same way, level by level, until a cell's pivots fit one chunk: a cell of many chunks costs its rows, not pairs
   of chunks. Only balls of the top level that lie close and are in different clusters are looked into, and of those only the members next to the other ball.
4. Local clusters merge where a vector lies in balls of several cells or chunks, or pivots are alike.

With every vector that has a neighbour counted as a core point, clusters are the connected groups of the alike relation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.operators.salting import salted_join
from tidemark.session import cut_lineage
from tidemark.tables import first_loaded

CHUNK = 8192
PER_CELL = 2048
MAX_AXES = 8
SAMPLE = 20_000
SAMPLE_NUMBERS = 1 << 22
LEAF = 48
CROWDED = 0.4


def usable(windows: DataFrame) -> DataFrame:
    """``window_id, features`` of windows whose features are all finite numbers; of an id delivered twice the first loaded row."""
    rows = first_loaded(windows, "window_id", ["features"]).filter(F.size("features") > 0)
    fine = F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.filter(fine).select("window_id", "features")


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Tree:
    """Cells for vectors of one dimension, fitted on a sample ``x`` of ``n`` vectors."""

    def __init__(self, x: np.ndarray, n: int, eps: float) -> None:
        self.eps = eps
        self.reach = eps * (1 + 1e-9) + 1e-9
        self.nodes: list[tuple] = []  # (axis, cut, lower child, upper child), or () for a leaf
        self._grow(x, n / max(len(x), 1))
        leaves = sum(not node for node in self.nodes)
        self._axes(x, n / leaves)

    def _grow(self, x: np.ndarray, each: float) -> int:
        here = len(self.nodes)
        self.nodes.append(())
        cut = self._cut(x) if len(x) > 2 * LEAF and len(x) * each > PER_CELL else None
        if cut is not None:
            axis, at = cut
            lower, upper = self._grow(x[x[:, axis] <= at], each), self._grow(x[x[:, axis] > at - self.reach], each)
            self.nodes[here] = (axis, at, lower, upper)
        return here

    def _cut(self, x: np.ndarray) -> tuple[int, float] | None:
        """The axis and place, between the quarters, with the fewest vectors within reach below it; None if there is none worth it."""
        v = np.sort(x, axis=0)
        k = np.arange(len(x) // 4, 3 * len(x) // 4)
        best = None
        for axis in range(x.shape[1]):
            at = (v[k, axis] + v[k + 1, axis]) / 2
            upper = len(x) - np.searchsorted(v[:, axis], at, "right")
            both = len(x) - upper - np.searchsorted(v[:, axis], at - self.reach, "right")
            # both sides must hold clearly less than the whole
            both = np.where((upper == 0) | (both > CROWDED * (len(x) - upper)), len(x), both)
            j = int(both.argmin())
            if both[j] < len(x) and (best is None or both[j] < best[0]):
                best = (int(both[j]), axis, float(at[j]))
        return best[1:] if best is not None else None

    def _axes(self, x: np.ndarray, n: float) -> None:
        """The grid that a leaf of about ``n`` vectors needs: principal axes of the sample, none if the leaf is small."""
        self.width = 4 * self.eps
        cells, k = 1.0, 0
        axes = np.zeros((x.shape[1], 0))
        if n > PER_CELL and self.eps > 0 and len(x):
            mean = x.mean(0)
            values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / len(x))
            order = np.argsort(-values)
            spread = np.sqrt(np.maximum(values[order], 0))
            while k < min(MAX_AXES, len(order)) and n / cells > PER_CELL and spread[k] > self.width / 8:
                cells *= max(1.0, 3 * spread[k] / self.width)
                k += 1
            axes = vectors[:, order[:k]]
        self.axes = axes

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cell keys; a row appears once for each cell it is in, also where two cells happen to have one key."""
        rows, keys, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            k, row = todo.pop()
            if not len(row):
                continue
            if self.nodes[k]:
                axis, at, lower, upper = self.nodes[k]
                v = x[row, axis]
                todo += [(lower, row[v <= at]), (upper, row[v > at - self.reach])]
            else:
                rows.append(row)
                keys.append(np.full(len(row), k, np.uint64))
        row, key = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((rows, np.int64), (keys, np.uint64)))
        y = x @ self.axes / self.width if self.axes.shape[1] else np.zeros((len(x), 0))
        base = np.floor(y)
        above = (base + 1 - y) * self.width <= self.reach
        mix = np.uint64(0x9E3779B97F4A7C15)
        key = (key + np.uint64(1)) * mix  # else leaf and first cell, both small, would often meet
        for j in range(y.shape[1]):
            here = base[row, j].astype(np.int64)
            more = np.flatnonzero(above[row, j])
            row, key, cell = np.r_[row, row[more]], np.r_[key, key[more]], np.r_[here, here[more] + 1].astype(np.uint64)
            key = (key ^ cell) * mix
            key ^= key >> np.uint64(29)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])][: len(row)]
        return row[new], key[new].view(np.int64)


def trees(rows: DataFrame, eps: float) -> dict[int, Tree]:
    """The tree per dimension. The driver gets counts and the SAMPLE rows of smallest hash, fewer where vectors are long."""
    counts = {r["d"]: r["n"] for r in rows.groupBy(F.size("features").alias("d")).agg(F.count("*").alias("n")).collect()}
    out = {}
    for d, n in counts.items():
        some = rows.filter(F.size("features") == d).orderBy(F.xxhash64("window_id"), "window_id").limit(max(256, min(SAMPLE, SAMPLE_NUMBERS // d)))
        out[d] = Tree(matrix(some.select("features").toArrow().column("features").combine_chunks()), n, eps)
    return out


def place_all(by_size: dict[int, Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column("features").offsets))
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                row, key = by_size[int(d)].place(matrix(part.column("features")))
                take = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(row), d), pa.int32()), take.column("window_id"), take.column("features")], names=["cell", "d", "window_id", "features"])

    return run


def cover(x: np.ndarray, eps2: float) -> np.ndarray:
    """For rows in id order, the row of the pivot whose ball each is in."""
    pivot = np.full(len(x), -1)
    free = np.arange(len(x))
    while len(free):
        p = free[0]
        gap = x[free] - x[p]
        inside = np.einsum("ij,ij->i", gap, gap) <= eps2
        inside[0] = True
        pivot[free[inside]] = p
        free = free[~inside]
    return pivot


def near_pairs(a: np.ndarray, b: np.ndarray, reach2: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs at most sqrt(reach2) apart and their squared distances, in blocks; with ``same`` only i < j."""
    out = []
    for at in range(0, len(a), 512):
        part = a[at : at + 512]
        rough = (part**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * part @ b.T
        i, j = np.nonzero(rough <= reach2 * (1 + 1e-6) + 1e-9)
        if same:
            later = j > i + at
            i, j = i[later], j[later]
        gap = part[i] - b[j]
        d2 = np.einsum("ij,ij->i", gap, gap)
        ok = d2 <= reach2
        out.append((i[ok] + at, j[ok], d2[ok]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def touching(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, eps2: float) -> bool:
    """Whether any member of ball a is alike to one of ball b; only members within two radii of the other pivot can be."""
    a = a[((a - pb) ** 2).sum(1) <= 4 * eps2 * (1 + 1e-9)]
    b = b[((b - pa_) ** 2).sum(1) <= 4 * eps2 * (1 + 1e-9)]
    return bool(len(a) and len(b) and len(near_pairs(a, b, eps2, False)[0]))


def covered_chunks(eps: float, kind: str):
    """Chunks of pivots -> the pivot of the next level for each, with features for those of the next level only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                pts = batch.column("pts")[k].values
                order = np.argsort(np.asarray(pts.field("pivot")), kind="stable")
                pts = pts.take(pa.array(order))
                ids, x = np.asarray(pts.field("pivot")), matrix(pts.field("features"))
                top = cover(x, eps * eps)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(np.full(len(ids), k))) for c in ("cell", "d")), pa.array(ids), pa.array(ids[top]), kept_lists(pts.field("features"), top == np.arange(len(ids)))],
                    names=["cell", "d", "pivot", "top", "features"],
                )

    return run, f"cell long, d int, pivot long, top long, features {kind}"


def kept_lists(lists: pa.Array, keep: np.ndarray, more: int = 0) -> pa.Array:
    """``lists`` with null where ``keep`` is false, and ``more`` nulls after them."""
    at = np.where(keep, np.arange(len(keep)), -1)
    return lists.take(pa.array(np.r_[at, np.full(more, -1)], mask=np.r_[~keep, np.ones(more, bool)]))


def local_balls(eps: float, kind: str):
    """Chunks (lists of vectors) -> the pivot of each vector, with features for pivots only, and ``link`` rows between pivots of touching balls."""
    eps2 = eps * eps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                pts = batch.column("pts")[k].values
                pts = pts.take(pa.array(np.argsort(np.asarray(pts.field("window_id")), kind="stable")))
                ids, x = np.asarray(pts.field("window_id")), matrix(pts.field("features"))
                pivot = cover(x, eps2)
                heads = np.flatnonzero(pivot == np.arange(len(x)))
                i, j, d2 = near_pairs(x[heads], x[heads], 9 * eps2, True)
                links = []
                if len(i):
                    by_pivot = np.argsort(pivot, kind="stable")
                    at = np.searchsorted(pivot[by_pivot], heads)
                    to = np.r_[at[1:], len(x)]
                    for a, b, gap in zip(i, j, d2):
                        if gap <= eps2 or touching(x[by_pivot[at[a] : to[a]]], x[by_pivot[at[b] : to[b]]], x[heads[a]], x[heads[b]], eps2):
                            links.append((ids[heads[a]], ids[heads[b]]))
                n, m = len(x), len(links)
                several = batch.column("chunks")[k].as_py() > 1
                link = np.array(links, np.int64).reshape(-1, 2)
                null = lambda v, before, after: pa.array(np.r_[np.zeros(before, np.int64), v, np.zeros(after, np.int64)], mask=np.r_[np.ones(before, bool), np.zeros(len(v), bool), np.ones(after, bool)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(np.full(n + m, k))) for c in ("cell", "chunks", "d")),
                        pa.array(np.r_[ids[pivot], link[:, 0]]),
                        null(ids, 0, m),
                        kept_lists(pts.field("features"), (pivot == np.arange(n)) & several, m),
                        null(link[:, 1], n, 0),
                    ],
                    names=["cell", "chunks", "d", "pivot", "window_id", "features", "link"],
                )

    return run, f"cell long, chunks int, d int, pivot long, window_id long, features {kind}, link long"


def close_pivots(eps: float, reach: float):
    """Lists of a cell's pivots, ``side`` 0 and 1 (or 0 alone, each with each) -> pairs that are alike (``sure``) or close enough for members to be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                pts = batch.column("pts")[k].values
                ids, side, x = np.asarray(pts.field("pivot")), np.asarray(pts.field("side")), matrix(pts.field("features"))
                first = side == 0
                one = first.all()
                a, b = (ids, ids) if one else (ids[first], ids[~first])
                i, j, d2 = near_pairs(x, x, reach * reach, True) if one else near_pairs(x[first], x[~first], reach * reach, False)
                yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j]), pa.array(d2 <= eps * eps)], names=["a", "b", "sure"])

    return run


def members_touch(eps: float):
    """Lists of members of two balls, ``side`` 0 and 1 -> the pair of pivots if any two members are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for k in range(len(batch)):
                pts = batch.column("pts")[k].values
                side, x = np.asarray(pts.field("side")), matrix(pts.field("features"))
                if 0 < side.sum() < len(side) and len(near_pairs(x[side == 0], x[side == 1], eps * eps, False)[0]):
                    hit.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(hit, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return run


def cluster(windows: DataFrame, eps: float = 0.25, chunk: int = CHUNK) -> DataFrame:
    """``window_id, cluster_id``: each usable window and the smallest window id of its cluster (its own, if it is alike to none).

    ``windows``: ``window_id, features, loaded_at``. Null ids, null or empty features and features with a null, NaN or infinite element are
    left out; vectors of different length are never alike; equal vectors are. No rows give no rows.
    """
    rows = cut_lineage(usable(windows))
    kind = dict(rows.dtypes)["features"]
    cells = cut_lineage(rows.mapInArrow(place_all(trees(rows, eps)), f"cell long, d int, window_id long, features {kind}"))
    counts = cells.groupBy("cell", "d").agg(F.count("*").alias("_n"))
    full = counts.filter(F.col("_n") > chunk).select("cell", "d", F.ceil(F.col("_n") / chunk).cast("int").alias("chunks"))
    cut = salted_join(cells, full, ["cell", "d"], ["window_id"], "left", counts=counts).withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    lists = chunked(cut, "window_id")
    balls = cut_lineage(lists.mapInArrow(*local_balls(eps, kind)))

    inside = balls.filter("link is not null").select(F.col("pivot").alias("a"), F.col("link").alias("b"))
    placed = balls.filter("link is null").select("cell", "chunks", "d", "pivot", "window_id")
    own = placed.groupBy("window_id").agg(F.min("pivot").alias("pivot"), F.max("pivot").alias("last"))
    # only windows in balls of different pivots link anything; in tight clusters the cells mostly agree on the pivot
    split = own.filter("pivot != last").select("window_id", F.col("pivot").alias("a"))
    edges = inside.unionByName(placed.join(split, "window_id").select("a", F.col("pivot").alias("b")).filter("a != b"))
    heads = balls.filter("link is null and chunks > 1 and pivot = window_id").select("cell", "d", "pivot", "features")
    if heads.isEmpty():
        root = components(edges)
    else:
        tops, pairs, sure = covered_levels(heads, eps, chunk, kind)
        edges = cut_lineage(edges.unionByName(sure))
        root = components(edges)
        later = cut_lineage(still_open(pairs, root))
        if not later.isEmpty():
            root = components(edges.unionByName(touching_pairs(later, placed, tops, rows, eps, chunk)))
    of = root.select(F.col("node").alias("pivot"), "root")
    return salted_join(own.drop("last"), of, ["pivot"], ["window_id"], "left").select("window_id", F.coalesce("root", "pivot").alias("cluster_id"))


def chunked(rows: DataFrame, key: str) -> DataFrame:
    """``cell, d, chunks, chunk, pts``: the rows of a cell in as many lists as ``chunks`` says."""
    cut = rows.withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))
    return cut.groupBy("cell", "d", "chunks", "chunk").agg(F.collect_list(F.struct(key, "features")).alias("pts"))


def covered_levels(heads: DataFrame, eps: float, chunk: int, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pivots of cells of several chunks, covered until a cell's fit one chunk.

    Gives ``pivot, top`` of every pivot, the ``a, b`` of tops whose balls may touch, and the ``a, b`` of pivots known to be in one cluster. A top's members are within
    ``level`` times ``eps`` of it. Should covering no longer halve the pivots of cells of more than one chunk, their chunks are compared pair by pair.
    """
    level, tops, sure = 1, heads.select("pivot", F.col("pivot").alias("top")), None
    while True:
        sized = heads.groupBy("cell", "d").agg(F.count("*").alias("n"))
        big = cut_lineage(sized.filter(F.col("n") > chunk))
        before = big.agg(F.sum("n")).first()[0] or 0
        if not before:
            break
        marked = salted_join(heads, big.select("cell", "d", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), ["cell", "d"], ["pivot"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        next_level = cut_lineage(chunked(marked, "pivot").mapInArrow(*covered_chunks(eps, kind)))
        step = next_level.filter("pivot != top").select(F.col("pivot").alias("a"), F.col("top").alias("b"))
        sure = step if sure is None else sure.unionByName(step)
        up = next_level.select(F.col("pivot").alias("top"), F.col("top").alias("up")).distinct()
        tops = cut_lineage(salted_join(tops, up, ["top"], ["pivot"]).select("pivot", F.col("up").alias("top")).distinct())
        heads = next_level.filter("pivot = top").select("cell", "d", "pivot", "features")
        level += 1
        left = heads.join(big.select("cell", "d"), ["cell", "d"], "left_semi").count()
        if 2 * left > before:
            break
    reach = (2 * level + 1) * eps
    sized = heads.groupBy("cell", "d").agg(F.count("*").alias("n")).select("cell", "d", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    cut = salted_join(heads, sized, ["cell", "d"], ["pivot"]).withColumn("chunk", F.pmod(F.xxhash64("pivot"), F.col("chunks")).cast("int"))
    one = F.struct("pivot", "features", F.lit(0).alias("side"))
    lists = cut.groupBy("cell", "d", "chunk").agg(F.collect_list(one).alias("pts")).select("pts")
    both = cut.filter("chunks > 1").select("cell", "d", "chunk", "pivot", "features", F.explode(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("chunk"))).alias("other"))
    two = F.struct("pivot", "features", (F.col("chunk") > F.col("other")).cast("int").alias("side"))
    across = both.groupBy("cell", "d", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")).agg(F.collect_list(two).alias("pts")).select("pts")
    found = cut_lineage(lists.unionByName(across).mapInArrow(close_pivots(eps, reach), "a long, b long, sure boolean"))
    alike = found.filter("sure").select("a", "b")
    return tops, found.filter("not sure").select("a", "b").distinct(), alike if sure is None else alike.unionByName(sure)


def still_open(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """Pairs whose ends are in different clusters so far."""
    for end in ("a", "b"):
        pairs = pairs.join(root.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    return pairs.filter("ra != rb").select("a", "b")


def touching_pairs(pairs: DataFrame, placed: DataFrame, tops: DataFrame, rows: DataFrame, eps: float, chunk: int) -> DataFrame:
    """Pairs of tops with alike members.

    On the line through both pivots, a member that has an alike one in the other ball is at most ``eps`` short of the other ball's nearest member. Most pairs
    are settled by that; the members left are compared in blocks.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("top")).distinct()
    vector = lambda name, end: rows.select(F.col("window_id").alias(end), F.col("features").alias(name))
    lines = pairs.join(vector("fa", "a"), "a").join(vector("fb", "b"), "b")
    member = placed.filter("chunks > 1").select("pivot", "window_id").distinct().join(tops.join(asked, "top", "left_semi"), "pivot").select("top", "window_id").distinct().join(rows, "window_id")
    sides = lines.select("*", F.inline(F.array(F.struct(F.col("a").alias("top"), F.lit(0).alias("side")), F.struct(F.col("b").alias("top"), F.lit(1).alias("side"))))).join(member, "top")
    plus = lambda s, v: s + v
    along = F.aggregate(F.zip_with(F.zip_with("fb", "fa", lambda q, p: q.cast("double") - p), F.zip_with("features", "fa", lambda x, p: x.cast("double") - p), lambda u, w: u * w), F.lit(0.0), plus)
    length = F.sqrt(F.aggregate(F.zip_with("fb", "fa", lambda q, p: (q.cast("double") - p) * (q.cast("double") - p)), F.lit(0.0), plus))
    at = cut_lineage(sides.select("a", "b", "side", "window_id", "features", (along / length).alias("at")))
    ends = at.groupBy("a", "b").agg(F.max(F.when(F.col("side") == 0, F.col("at"))).alias("top_a"), F.min(F.when(F.col("side") == 1, F.col("at"))).alias("low_b"))
    slack = eps * (1 + 1e-6) + 1e-9
    near = salted_join(at, ends.filter(F.col("low_b") - F.col("top_a") <= slack), ["a", "b"], ["window_id"])
    near = near.filter(F.when(F.col("side") == 0, F.col("at") >= F.col("low_b") - slack).otherwise(F.col("at") <= F.col("top_a") + slack))
    near = cut_lineage(near.select("a", "b", "side", "window_id", "features"))
    size = near.groupBy("a", "b").agg(*[F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("side") == k, 1)) / chunk)).cast("int").alias(f"n{k}") for k in (0, 1)])
    cut = salted_join(near, size, ["a", "b"], ["window_id"])
    mine = F.pmod(F.xxhash64("window_id"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int")
    cut = cut.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0")) - 1)))
    block = [F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other")).alias("ca"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine")).alias("cb")]
    lists = cut.groupBy("a", "b", *block).agg(F.collect_list(F.struct("side", "features")).alias("pts"))
    return lists.mapInArrow(members_touch(eps), "a long, b long").distinct()


def grouped(labels: DataFrame) -> DataFrame:
    """``first_window_id, window_id``: a row for each window other than the smallest of its cluster."""
    return labels.filter("window_id != cluster_id").select(F.col("cluster_id").alias("first_window_id"), "window_id")


def describe(windows: DataFrame, labels: DataFrame, top: int = 3) -> DataFrame:
    """``first_window_id, size, medoid, typical``: each cluster's size and its ``top`` most typical windows, the medoid first.

    The medoid is the window with the least sum of squared distances to the others, which is the one nearest to the mean, so one
    aggregate finds it. Ties go to the smaller id. Clusters of one window are given too.
    """
    rows = usable(windows).join(labels, "window_id")
    element = rows.select("cluster_id", "window_id", F.posexplode("features").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    centre = element.groupBy("cluster_id", "i").agg(F.avg("v").alias("m")).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    size = labels.groupBy("cluster_id").agg(F.count("*").alias("size"))
    gap = F.aggregate(F.zip_with("features", "centre", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    near = salted_join(rows, centre, ["cluster_id"], ["window_id"]).select("cluster_id", "window_id", F.round(gap, 9).alias("gap"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("gap", "window_id"))
    best = near.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "window_id"))), lambda s: s["window_id"]).alias("typical"))
    return best.join(size, "cluster_id").select(F.col("cluster_id").alias("first_window_id"), "size", F.col("typical")[0].alias("medoid"), "typical")
