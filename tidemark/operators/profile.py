"""Matrix profiles: for every window of a recording, its nearest other window after z-normalisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spectral import marks
from tidemark.session import cut_lineage

TILE = 4096


def z_windows(x: np.ndarray, m: int) -> np.ndarray:
    """All windows of length m, z-normalised by the population deviation; zeros where it is 0."""
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    sd = w.std(axis=1, keepdims=True)
    return np.where(sd == 0, 0.0, (w - w.mean(axis=1, keepdims=True)) / np.where(sd == 0, 1.0, sd))


def tile_minima(m: int, exclusion: int):
    """Pairs of tiles -> for each window of the row tile, the nearest window to its left and right in the column tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec, idx, other, dist, side = [], [], [], [], []
            for k in range(len(batch)):
                rows, cols = batch.column("rows")[k].values, batch.column("cols")[k].values

                def load(p):
                    i = np.asarray(p.field("idx"))
                    o = np.argsort(i)
                    return int(i.min()), np.asarray(p.field("x"), dtype=float)[o]

                (a0, xa), (b0, xb) = load(rows), load(cols)
                if len(xa) < m or len(xb) < m:
                    continue
                za, zb = z_windows(xa, m), z_windows(xb, m)
                i, j = a0 + np.arange(len(za)), b0 + np.arange(len(zb))
                for here, there, zh, zt in ((i, j, za, zb), (j, i, zb, za)) if a0 != b0 else ((i, j, za, zb),):
                    for at in range(0, len(zh), 512):
                        part, ii = zh[at : at + 512], here[at : at + 512]
                        # rows of zeros (no variation) have no length of their own, so squares are summed
                        d2 = (part * part).sum(1)[:, None] + (zt * zt).sum(1)[None] - 2 * part @ zt.T
                        d2[np.abs(ii[:, None] - there[None]) <= exclusion] = np.inf
                        for s, mask in ((-1, there[None] >= ii[:, None]), (1, there[None] <= ii[:, None])):
                            masked = np.where(mask, np.inf, d2)
                            best = masked.argmin(1)
                            ok = np.isfinite(masked[np.arange(len(ii)), best])
                            rec += [batch.column("recording_id")[k].as_py()] * int(ok.sum())
                            idx.append(ii[ok])
                            other.append(there[best[ok]])
                            dist.append(np.sqrt(((part[ok] - zt[best[ok]]) ** 2).sum(1)))
                            side += [s] * int(ok.sum())
            cat = lambda v, t: np.concatenate(v) if v else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays([pa.array(rec, batch.schema.field("recording_id").type), pa.array(cat(idx, np.int64)), pa.array(cat(other, np.int64)), pa.array(cat(dist, float)), pa.array(side, pa.int32())], names=["recording_id", "idx", "other", "dist", "side"])

    return run


def matrix_profile(signal: DataFrame, m: int, exclusion: int | None = None, tile: int = TILE) -> DataFrame:
    """``recording_id, idx, dist, other, left, right``: distance to and place of the nearest window, and the nearest on either side.

    Windows at most ``exclusion`` (a quarter of m, rounded up) apart do not count. A recording is cut into tiles of ``tile`` samples with m - 1 more; each pair of tiles is one
    group, so a long recording is many tasks of bounded size; minima are combined afterwards.
    """
    zone = -(-m // 4) if exclusion is None else exclusion
    own = F.floor(F.col("idx") / tile).cast("long")
    at = F.pmod("idx", F.lit(tile))
    into = F.when((at < m - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    tiles = signal.select("recording_id", "idx", "x", F.explode(into).alias("t")).groupBy("recording_id", "t").agg(F.collect_list(F.struct("idx", "x")).alias("pts"))
    a = tiles.select("recording_id", F.col("t").alias("ta"), F.col("pts").alias("rows"))
    b = tiles.select("recording_id", F.col("t").alias("tb"), F.col("pts").alias("cols"))
    pairs = a.join(b, "recording_id").filter("ta <= tb").select("recording_id", "rows", "cols")  # each pair of tiles once, for both
    kind = dict(signal.dtypes)["recording_id"]
    found = pairs.mapInArrow(tile_minima(m, zone), f"recording_id {kind}, idx long, other long, dist double, side int")
    near = F.min(F.struct(F.round("dist", 9).alias("near"), "other", "dist"))
    g = found.groupBy("recording_id", "idx").agg(near.alias("n"), F.min(F.when(F.col("side") == -1, F.struct(F.round("dist", 9).alias("dist"), "other"))).alias("l"), F.min(F.when(F.col("side") == 1, F.struct(F.round("dist", 9).alias("dist"), "other"))).alias("r"))
    return g.select("recording_id", "idx", "n.dist", "n.other", F.col("l.other").alias("left"), F.col("r.other").alias("right"))


def links(profile: DataFrame) -> DataFrame:
    """``recording_id, idx, following``: links that hold both ways, a window's right neighbour whose left neighbour is the window."""
    back = profile.select("recording_id", F.col("idx").alias("right"), F.col("left").alias("back"))
    both = profile.filter("right is not null").select("recording_id", "idx", "right").join(back, ["recording_id", "right"]).filter("back = idx")
    return both.select("recording_id", "idx", F.col("right").alias("following"))


def chains(profile: DataFrame) -> DataFrame:
    """``recording_id, chain, pos, idx, length, longest``: links joined end to end; ``chain`` is the first window, ``pos`` counts from 0.

    A window has one link at most on either side, so chains do not branch; they are followed by doubling steps, a join for each power of
    two of the longest chain's length. ``longest`` marks the recording's longest chain, of equally long ones the first.
    """
    key = ["recording_id", "idx"]
    step = cut_lineage(links(profile))
    ends = step.select("recording_id", "idx").unionByName(step.select("recording_id", F.col("following").alias("idx"))).distinct()
    back = step.select("recording_id", F.col("following").alias("idx"), F.col("idx").alias("root"))
    at = cut_lineage(ends.join(back, key, "left").select(*key, F.coalesce("root", "idx").alias("root"), F.when(F.col("root").isNull(), 0).otherwise(1).cast("long").alias("pos")))
    while True:
        up = at.select("recording_id", F.col("idx").alias("root"), F.col("root").alias("up"), F.col("pos").alias("more"))
        at = cut_lineage(at.join(up, ["recording_id", "root"]).select(*key, F.col("up").alias("root"), (F.col("pos") + F.col("more")).alias("pos"), (F.col("more") > 0).alias("moved")))
        if at.filter("moved").isEmpty():
            break
        at = at.drop("moved")
    size = at.groupBy("recording_id", "root").agg(F.count("*").alias("length"))
    top = size.groupBy("recording_id").agg(F.min(F.struct((-F.col("length")).alias("l"), "root")).alias("t")).select("recording_id", F.col("t.root").alias("best"))
    return at.join(size, ["recording_id", "root"]).join(top, "recording_id").select("recording_id", F.col("root").alias("chain"), "pos", "idx", "length", (F.col("root") == F.col("best")).alias("longest"))


def distances_from(x: np.ndarray, at: int, m: int) -> np.ndarray:
    """Distance of every window of ``x`` to the window at ``at``, both z-normalised, in pieces of bounded size."""
    query = z_windows(x[at : at + m], m)[0]
    out = np.empty(len(x) - m + 1)
    for a in range(0, len(out), TILE * 4):
        part = z_windows(x[a : a + TILE * 4 + m - 1], m)
        out[a : a + len(part)] = np.sqrt(((part - query) ** 2).sum(1))
    return out


def nearest_first(d: np.ndarray, zone: int, most: int, limit: float) -> list[int]:
    """Positions by ascending distance, each more than ``zone`` from those before it."""
    d = d.copy()
    out: list[int] = []
    while len(out) < most:
        k = int(d.argmin())
        if not np.isfinite(d[k]) or d[k] > limit:
            break
        out.append(k)
        d[max(0, k - zone) : k + zone + 1] = np.inf
    return out


def sliced(profile: DataFrame, m: int, start: int, end: int) -> DataFrame:
    """The profile's windows that lie within [start, end) of the channel; a stretch shorter than one window is an error."""
    if end - start < m:
        raise ValueError(f"{end - start} samples hold no window of {m}")
    return profile.filter((F.col("idx") >= start) & (F.col("idx") < end - m + 1))


def seed_matches(signal: DataFrame, seed: list[float], most: int, limit: float | None = None) -> DataFrame:
    """``recording_id, idx, distance, rank``: the windows of every recording most like ``seed``, after z-normalisation, nearest first.

    Matches lie more than a quarter of the seed's length apart. ``limit`` bounds the distance over the square root of the length. A recording is in one task.
    """
    m = len(seed)
    bound = np.inf if limit is None else round(limit * m**0.5, 6)
    query = np.array(seed, float)

    def find(x: np.ndarray) -> list[tuple]:
        if len(x) < m:
            return []
        d = distances_from(np.r_[x, query], len(x), m)[: len(x) - m + 1]
        return [(k, float(d[k]), rank) for rank, k in enumerate(nearest_first(d, -(-m // 4), most, bound))]

    return marks(signal, find, "idx long, distance double, rank int")


def families(groups: DataFrame, limit: float, least: int) -> DataFrame:
    """Motif groups whose profile distance is at most ``limit`` and that have ``least`` members at least, the seed among them."""
    n = groups.filter(F.col("profile_distance") <= limit).groupBy("recording_id", "seed").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return groups.join(n.drop("n"), ["recording_id", "seed"], "left_semi")


def motif_groups(signal: DataFrame, profile: DataFrame, m: int, neighbours: int, most: int = 10, max_distance: float | None = None) -> DataFrame:
    """``recording_id, seed, profile_distance, member, distance, rank``: groups of alike windows by ascending profile.

    The free window of the least profile distance is a seed; its group is its ``neighbours`` nearest windows, itself first at distance 0, more than a quarter of m
    apart (taken ones included). The seed's and all members' surroundings of m // 2 positions are no seeds any more. At most ``most`` groups a recording.
    Choice is sequential in a recording, so its samples and profile are in one task; distances are made seed by seed.
    """
    kind = dict(signal.dtypes)["recording_id"]
    lists = signal.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("xs"))
    dists = profile.groupBy("recording_id").agg(F.collect_list(F.struct("idx", F.round("dist", 9).alias("dist"))).alias("mp"))
    zone = -(-m // 4)
    limit = np.inf if max_distance is None else max_distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("recording_id", "seed", "profile_distance", "member", "distance", "rank")}
            for row in range(len(batch)):
                rec = batch.column("recording_id")[row].as_py()
                x = np.asarray(batch.column("xs")[row].values, dtype=float)
                at, dist = (np.asarray(batch.column("mp")[row].values.field(c)) for c in ("idx", "dist"))
                free = np.ones(len(x), bool)
                groups = 0
                for k in np.lexsort((at, dist)):
                    seed = int(at[k])
                    if not free[seed] or not np.isfinite(dist[k]):
                        continue
                    d = distances_from(x, seed, m)
                    d[seed] = 0.0
                    members = nearest_first(d, zone, neighbours, limit)
                    for near in [seed, *members]:
                        free[max(0, near - m // 2) : near + m // 2 + 1] = False
                    for rank, j in enumerate(members):
                        for name, v in zip(out, (rec, seed, float(dist[k]), j, float(d[j]), rank)):
                            out[name].append(v)
                    groups += 1
                    if groups == most:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out["recording_id"], batch.schema.field("recording_id").type), pa.array(out["seed"], pa.int64()), pa.array(out["profile_distance"], pa.float64()), pa.array(out["member"], pa.int64()), pa.array(out["distance"], pa.float64()), pa.array(out["rank"], pa.int32())], names=list(out))

    return lists.join(dists, "recording_id").mapInArrow(run, f"recording_id {kind}, seed long, profile_distance double, member long, distance double, rank int")
