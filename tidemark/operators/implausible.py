"""Implausible values in measurements, judged by what is normal for their own source.

Readings are grouped once by (source, block of positions); a block carries a margin of its neighbours' readings, so
excursions are seen whole, and no task ever holds a whole source. Two passes read that one shuffle:

1. Each block makes weighted equal-depth quantile sketches: of the sizes of nonzero differences between successive
   readings, and (for the fences) of the readings per hour of the day of the recording. Sketches of a source are
   merged level by level; each merge keeps at most ``POINTS`` points, so no group grows with a hot source.
2. Each block flags its readings against its source's merged sketch: beyond the sensor's range or not finite
   (``range``), no variation for too long (``stuck``), a short excursion with an implausible rate of change on both
   sides (``spike``). Runs that touch a block's edge are joined to their continuation afterwards.

The median difference is exact for a source of one block; else its rank is off by at most 1/(2*POINTS) per level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import file_stem

BLOCK = 1 << 14
POINTS = 255
FAN_IN = 64


# ---------------------------------------------------------------- what holds for each source


def majority_rate(recordings: DataFrame) -> DataFrame:
    """``stem, fs``: the sampling rate of more than half the recordings (ids) of a source file; no row without one.

    A null or NaN rate counts as a recording but never as a majority. Removed recordings count.
    """
    each = recordings.filter("id is not null").select("id", file_stem(F.col("source_file")).alias("stem"), "fs").filter("stem is not null").distinct()
    by_rate = each.groupBy("stem", "fs").agg(F.count_distinct("id").alias("n"))
    total = each.groupBy("stem").agg(F.count_distinct("id").alias("total"))
    return by_rate.join(total, "stem").filter("2 * n > total and fs is not null and not isnan(fs)").select("stem", "fs")


def doubtful_rates(recordings: DataFrame) -> DataFrame:
    """``npy_path, idx`` (-1) of recordings whose ``fs`` is null, NaN or not their source file's majority."""
    named = recordings.filter("source_file is not null").select("npy_path", "fs", file_stem(F.col("source_file")).alias("stem"))
    major = majority_rate(recordings).withColumnRenamed("fs", "usual")
    odd = named.join(major, "stem", "left").filter("fs is null or isnan(fs) or usual is null or fs != usual")
    return odd.select("npy_path", F.lit(-1).cast("long").alias("idx")).distinct()


def source_limits(channel_files: DataFrame, loggers: DataFrame, recordings: DataFrame) -> DataFrame:
    """``npy_path, full_scale, fs`` of each file, by its latest written row; null where unknown."""
    latest = channel_files.groupBy("npy_path").agg(F.max(F.struct("written_at", "logger", "source_file")).alias("r")).select("npy_path", "r.logger", file_stem(F.col("r.source_file")).alias("stem"))
    scale = loggers.groupBy("logger").agg(F.max("full_scale").alias("full_scale"))
    return latest.join(scale, "logger", "left").join(majority_rate(recordings), "stem", "left").select("npy_path", "full_scale", "fs")


# ---------------------------------------------------------------- blocks and sketches


def blocks(samples: DataFrame, block: int, margin: int) -> DataFrame:
    """``npy_path, blk, pts``: the readings of each block and of ``margin`` positions on either side."""
    own = F.floor(F.col("idx") / block).cast("long")
    at = F.pmod(F.col("idx"), F.lit(block))
    into = F.when(at < margin, F.array(own, own - 1)).when(at >= block - margin, F.array(own, own + 1)).otherwise(F.array(own))
    rows = samples.filter("npy_path is not null and idx is not null and x is not null")
    return rows.select("npy_path", "idx", "x", F.explode(into).alias("blk")).filter("blk is not null").groupBy("npy_path", "blk").agg(F.collect_list(F.struct("idx", "x")).alias("pts"))


class Batch:
    """The readings of the blocks of one Arrow batch as flat arrays, sorted by (row, idx), each idx once."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        lists = batch.column("pts")
        at = np.asarray(lists.offsets)
        flat = lists.flatten()
        idx = np.asarray(flat.field("idx"))
        x = np.asarray(flat.field("x"))
        row = np.repeat(np.arange(len(batch)), np.diff(at))
        order = np.lexsort((x, idx, row))
        row, idx, x = row[order], idx[order], x[order]
        first = np.r_[True, (row[1:] != row[:-1]) | (idx[1:] != idx[:-1])] if len(row) else np.zeros(0, bool)
        self.row, self.idx, self.x = row[first], idx[first], x[first]
        self.blk = np.asarray(batch.column("blk"))

    def own(self, block: int) -> np.ndarray:
        return np.floor_divide(self.idx, block) == self.blk[self.row]


def equal_depth(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n_rows: int, points: int = POINTS):
    """Per row a sketch of at most ``points`` equally weighted values: offsets, values and the weight of one point.

    A row with no more than ``points`` equally weighted values keeps them all; else point j is the value at the middle of
    the j-th of ``points`` equal shares of the weight, which puts any quantile's rank off by at most 1/(2*points).
    """
    order = np.lexsort((value, row))
    row, value, weight = row[order], value[order], weight[order]
    count = np.bincount(row, minlength=n_rows)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    start = np.r_[0, np.cumsum(count)]
    low = np.full(n_rows, np.inf)
    high = np.zeros(n_rows)
    np.minimum.at(low, row, weight)
    np.maximum.at(high, row, weight)
    whole = (count <= points) & (low == high)
    size = np.where(whole, count, points) * (count > 0)
    to = np.r_[0, np.cumsum(size)]
    out_row = np.repeat(np.arange(n_rows), size)
    j = np.arange(to[-1]) - to[out_row]
    share = (j + 0.5) / np.maximum(size, 1)[out_row]
    # Weights are scaled to sum to 1 in each row, so one running sum serves all rows at once.
    running = np.cumsum(weight / total[row]) if len(row) else np.zeros(0)
    base = np.r_[0.0, running][start[:-1]]
    picked = np.searchsorted(running, base[out_row] + share - 1e-9, side="left")
    picked = np.clip(picked, start[out_row], np.maximum(start[out_row + 1] - 1, start[out_row]))
    picked = np.where(whole[out_row], start[out_row] + j, picked)
    return to, value[picked] if len(value) else np.zeros(0), total / np.maximum(size, 1)


def weighted_quantiles(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n_rows: int, shares: list[float]) -> np.ndarray:
    """``(n_rows, len(shares))`` quantiles, halfway between two values where the share falls on a boundary; NaN if empty."""
    order = np.lexsort((value, row))
    row, value, weight = row[order], value[order], weight[order]
    count = np.bincount(row, minlength=n_rows)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    start = np.r_[0, np.cumsum(count)]
    out = np.full((n_rows, len(shares)), np.nan)
    if not len(row):
        return out
    running = np.cumsum(weight / total[row])
    base = np.r_[0.0, running][start[:-1]]
    has = count > 0
    for k, share in enumerate(shares):
        at = [np.clip(np.searchsorted(running, base + share + e, side=s), start[:-1], np.maximum(start[1:] - 1, start[:-1])) for e, s in ((-1e-9, "left"), (1e-9, "right"))]
        both = [value[np.minimum(a, len(value) - 1)] for a in at]
        out[has, k] = ((both[0] + both[1]) / 2)[has]
    return out


SKETCH = "npy_path string, hour int, part long, blks array<long>, weight double, points array<double>"


def hour_of(idx: np.ndarray, fs: np.ndarray) -> np.ndarray:
    """Hour of the day since the recording's start; 0 where the rate is unknown."""
    with np.errstate(all="ignore"):
        hour = np.floor(idx / fs / 3600.0) % 24
    return np.where(np.isfinite(hour), hour, 0).astype(np.int64)


def block_sketches(block: int, hours: bool):
    """Arrow batches of blocks -> SKETCH rows: differences (hour -1) and, if ``hours``, readings per hour of the day."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            b = Batch(batch)
            own = b.own(block)
            with np.errstate(invalid="ignore"):
                size = np.abs(np.diff(b.x))
            ok = own[1:] & (b.row[1:] == b.row[:-1]) & (b.idx[1:] == b.idx[:-1] + 1) & np.isfinite(size) & (size > 0)
            yield sketch_rows(batch, np.full(len(batch), -1), np.arange(len(batch)), b.row[1:][ok], size[ok], block)
            if hours:
                fs = batch.column("fs").to_numpy(zero_copy_only=False).astype(float)
                fine = own & np.isfinite(b.x)
                group = b.row[fine] * 24 + hour_of(b.idx[fine], fs[b.row[fine]])
                keys, inverse = np.unique(group, return_inverse=True)
                if len(keys):
                    yield sketch_rows(batch, keys % 24, keys // 24, inverse, b.x[fine], block)

    return run


def sketch_rows(batch, hour, of_row, row, value, block) -> pa.RecordBatch:
    to, points, weight = equal_depth(row, value, np.ones(len(row)), len(of_row))
    blk = np.asarray(batch.column("blk"))[of_row]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("npy_path").take(pa.array(of_row)),
            pa.array(hour, pa.int32()),
            pa.array(blk // FAN_IN, pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(blk) + 1), pa.int32()), pa.array(blk, pa.int64())),
            pa.array(weight, pa.float64()),
            pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(points, pa.float64())),
        ],
        names=["npy_path", "hour", "part", "blks", "weight", "points"],
    )


def flat_sketches(batch: pa.RecordBatch):
    """Of rows with a list ``s`` of sketches: row of each sketch, its blocks, and row, value, weight of each point."""
    lists = batch.column("s")
    each = lists.flatten()
    row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(lists.offsets)))
    blks, points = each.field("blks"), each.field("points")
    n = np.diff(np.asarray(points.offsets))
    weight = np.repeat(np.asarray(each.field("weight")), n)
    return row, blks, np.repeat(row, n), np.asarray(points.flatten()), weight


def merge_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        row, blks, prow, value, weight = flat_sketches(batch)
        to, points, w = equal_depth(prow, value, weight, len(batch))
        n_blks = np.bincount(row, weights=np.diff(np.asarray(blks.offsets)), minlength=len(batch)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("npy_path"),
                batch.column("hour"),
                pa.array(np.asarray(batch.column("part")) // FAN_IN, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_blks)], pa.int32()), blks.flatten()),
                pa.array(w, pa.float64()),
                pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(points, pa.float64())),
            ],
            names=["npy_path", "hour", "part", "blks", "weight", "points"],
        )


def final_quantiles(shares: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            row, blks, prow, value, weight = flat_sketches(batch)
            q = weighted_quantiles(prow, value, weight, len(batch), shares)
            n_blks = np.bincount(row, weights=np.diff(np.asarray(blks.offsets)), minlength=len(batch)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("npy_path"),
                    batch.column("hour"),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_blks)], pa.int32()), blks.flatten()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(shares), pa.int32()), pa.array(q.ravel(), pa.float64())),
                ],
                names=["npy_path", "hour", "blks", "q"],
            )

    return run


def quantiles(sketches: DataFrame, shares: list[float], levels: int = 2) -> DataFrame:
    """``npy_path, hour, blks, q`` from SKETCH rows; before the last merge, ``levels`` merges of FAN_IN blocks each."""
    one = F.struct("blks", "weight", "points")
    for _ in range(levels):
        sketches = sketches.groupBy("npy_path", "hour", "part").agg(F.collect_list(one).alias("s")).mapInArrow(merge_sketches, SKETCH)
    return sketches.groupBy("npy_path", "hour").agg(F.collect_list(one).alias("s")).mapInArrow(final_quantiles(shares), "npy_path string, hour int, blks array<long>, q array<double>")


# ---------------------------------------------------------------- flags


def spikes(b: Batch, step: np.ndarray, longest: np.ndarray, factor: float) -> np.ndarray:
    """Which readings of the batch lie in a short excursion.

    An excursion is at most ``longest`` samples of its row, all more than ``factor`` steps off the readings just before
    and just after it. Those two must agree within ``factor`` steps, and each must be held: the reading beyond it, where there is
    one, agrees with it. Readings that are not finite are passed over.
    """
    flag = np.zeros(len(b.x), bool)
    keep = np.flatnonzero(np.isfinite(b.x))
    row, idx, x = b.row[keep], b.idx[keep], b.x[keep]
    if len(x) < 3:
        return flag
    far = factor * step[row]
    reach = np.maximum(longest, 1)[row]
    near = np.maximum(reach, 5)
    joined = (row[1:] == row[:-1]) & (idx[1:] - idx[:-1] <= near[1:])
    jump = np.abs(np.diff(x)) > far[1:]  # NaN step: no jump
    into = np.flatnonzero(joined & jump) + 1  # first reading after a jump
    held_before = np.r_[True, ~joined | ~jump]  # the reading before i agrees with i, or there is none
    held_after = np.r_[~joined | ~jump, True]
    hit = np.zeros(len(x), bool)
    level, bound = x[into - 1], far[into]
    end = into.copy()
    live = np.arange(len(into))
    while len(live):
        e = end[live]
        # e is off the level and within reach; look at the reading after it
        ok = (e + 1 < len(x))
        live, e = live[ok], e[ok]
        ok = joined[e] & (row[e + 1] == row[into[live]])
        live, e = live[ok], e[ok]
        off = np.abs(x[e + 1] - level[live]) > bound[live]
        back = live[~off]
        if len(back):
            eb = end[back]
            fits = (held_before[into[back] - 1] | held_after[eb + 1]) & (idx[eb] - idx[into[back]] + 1 <= reach[into[back]])
            both = np.array([np.all(np.abs(x[a : z + 1] - x[z + 1]) > lim) for a, z, lim in zip(into[back], eb, bound[back])], bool) & fits
            for a, z in zip(into[back][both], eb[both]):
                hit[a : z + 1] = True
        live = live[off]
        end[live] += 1
        live = live[idx[end[live]] - idx[into[live]] + 1 <= reach[into[live]]]
    flag[keep[hit]] = True
    return flag


def flag_blocks(block: int, seconds: float, factor: float, stuck_seconds: float):
    """Blocks with ``full_scale, fs, step`` -> ``npy_path, reason, idx, to_idx, x, least`` .

    ``range``, ``stuck`` and ``spike`` rows have one reading each. ``edge`` rows are equal runs idx..to_idx that touch
    their block's edge, to be joined to their continuation; ``least`` is the length from which a run is stuck.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            b = Batch(batch)
            full, fs, step = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("full_scale", "fs", "step"))
            own = b.own(block)
            usable = np.isfinite(fs) & (fs > 0)
            longest = np.where(usable, np.floor(seconds * np.where(usable, fs, 0) + 1e-9), 1).clip(1, 1 << 40).astype(np.int64)
            least = np.where(usable, np.ceil(stuck_seconds * np.where(usable, fs, 0) - 1e-9).clip(2, 1 << 40), 1 << 62).astype(np.int64)
            with np.errstate(invalid="ignore"):
                out_of_range = ~np.isfinite(b.x) | (np.abs(b.x) > full[b.row])
            spike = spikes(b, step, longest, factor)
            # runs of equal readings at successive positions, within the block itself
            row, idx, x = b.row[own], b.idx[own], b.x[own]
            new = np.r_[True, (row[1:] != row[:-1]) | (idx[1:] != idx[:-1] + 1) | (x[1:] != x[:-1])] if len(row) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            stop = np.r_[start[1:], len(row)] - 1 if len(start) else start
            edge = (idx[start] % block == 0) | (idx[stop] % block == block - 1) if len(start) else np.zeros(0, bool)
            edge &= np.isfinite(x[start]) & usable[row[start]]
            long = (stop - start + 1 >= least[row[start]]) & ~edge & np.isfinite(x[start])
            stuck = np.zeros(len(row), bool)
            for a, z in zip(start[long], stop[long]):
                stuck[a : z + 1] = True
            out, sp = out_of_range[own], spike[own]
            reason = np.where(out, 0, np.where(stuck, 1, np.where(sp, 2, 3)))
            pick = np.flatnonzero(reason < 3)
            s, z = start[edge], stop[edge]
            rows = np.r_[row[pick], row[s]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("npy_path").take(pa.array(rows, pa.int64())),
                    pa.array(np.array(["range", "stuck", "spike", "edge"], object)[np.r_[reason[pick], np.full(len(s), 3)]], pa.string()),
                    pa.array(np.r_[idx[pick], idx[s]], pa.int64()),
                    pa.array(np.r_[idx[pick], idx[z]], pa.int64()),
                    pa.array(np.r_[x[pick], x[s]], pa.float64()),
                    pa.array(least[rows], pa.int64()),
                ],
                names=["npy_path", "reason", "idx", "to_idx", "x", "least"],
            )

    return run


FLAGS = "npy_path string, reason string, idx long, to_idx long, x double, least long"


def margin_for(limits: DataFrame, seconds: float) -> int:
    """Positions a block needs of its neighbours: the longest excursion and the readings around it."""
    fastest = limits.filter("fs > 0 and fs < double('inf')").agg(F.max("fs")).first()[0] or 1.0
    longest = max(1, int(seconds * fastest))
    return 2 * max(longest, 5) + longest + 8


def blocked(samples: DataFrame, limits: DataFrame, seconds: float = 3.0) -> tuple[DataFrame, int]:
    margin = margin_for(limits, seconds)
    block = max(BLOCK, 8 * margin)
    return blocks(samples, block, margin), block


def implausible(samples: DataFrame, limits: DataFrame, *, seconds: float = 3.0, factor: float = 25.0, stuck_seconds: float = 60.0) -> DataFrame:
    """``npy_path, idx, reason``: each implausible reading once, the first reason of range, stuck, spike.

    ``samples``: ``npy_path, idx, x``; a null in any of them is no reading; a position delivered twice counts once (of
    different values the smallest, NaN last). ``limits``: ``npy_path, full_scale, fs``, one row a source; without ``full_scale`` only values
    that are not finite are out of range; without a usable ``fs`` nothing is stuck and an excursion has one reading. A source of
    constant readings has no step and no excursion. Extra columns are ignored; no rows give no rows.
    """
    parts, block = blocked(samples, limits, seconds)
    sketches = parts.mapInArrow(block_sketches(block, hours=False), SKETCH)
    steps = quantiles(sketches, [0.5]).select("npy_path", F.col("q")[0].alias("step"), "blks")
    # The limits travel to each block with the step, so the readings themselves are never joined or moved again.
    known = steps.join(limits, "npy_path", "left").select("npy_path", F.explode("blks").alias("blk"), "step", "full_scale", "fs")
    judged = parts.join(known.hint("shuffle_hash"), ["npy_path", "blk"])
    flags = judged.select("npy_path", "blk", "pts", "full_scale", "fs", "step").mapInArrow(flag_blocks(block, seconds, factor, stuck_seconds), FLAGS)
    return joined_edges(flags)


def joined_edges(flags: DataFrame) -> DataFrame:
    """Flags of single readings, and the readings of edge runs that are long enough with their continuation.

    Single readings pass through in lanes of their own, so the blocks are judged once; edge runs are two a block at most.
    """
    edge = F.col("reason") == "edge"
    lanes = flags.withColumn("lane", F.when(edge, -1).otherwise(F.pmod(F.xxhash64("idx"), F.lit(64)).cast("int")))
    order = Window.partitionBy("npy_path", "lane").orderBy("idx")
    cut = (F.col("idx") != F.lag("to_idx").over(order) + 1) | (F.col("x") != F.lag("x").over(order))
    runs = lanes.withColumn("island", F.sum(F.coalesce(cut, F.lit(True)).cast("long")).over(order))
    total = F.sum(F.col("to_idx") - F.col("idx") + 1).over(Window.partitionBy("npy_path", "lane", "island"))
    kept = runs.withColumn("total", total).filter(~edge | (F.col("total") >= F.col("least")))
    why = F.when(F.col("reason") == "range", 0).when(F.col("reason") == "spike", 2).otherwise(1)
    each = kept.select("npy_path", F.explode(F.sequence("idx", "to_idx")).alias("idx"), why.alias("why"))
    reason = F.element_at(F.array(F.lit("range"), F.lit("stuck"), F.lit("spike")), F.col("why") + 1)
    return each.groupBy("npy_path", "idx").agg(F.min("why").alias("why")).select("npy_path", "idx", reason.alias("reason"))


def hourly_fences(samples: DataFrame, limits: DataFrame, *, expand: float = 6.0, seconds: float = 3.0) -> DataFrame:
    """``npy_path, hour, q1, q2, q3, low, high, n_outside``: expanded interquartile fences of each source and hour context.

    The hour is that of the day since the recording's start. ``n_outside`` counts readings outside the fences. Sketches as above.
    """
    parts, block = blocked(samples, limits, seconds)
    spread = parts
    rates = limits.select("npy_path", "fs")
    blks = spread.select("npy_path", "blk").join(rates, "npy_path", "left")
    timed = spread.join(blks.hint("shuffle_hash"), ["npy_path", "blk"]).select("npy_path", "blk", "fs", "pts")
    sketches = timed.mapInArrow(block_sketches(block, hours=True), SKETCH).filter("hour >= 0")
    q = quantiles(sketches, [0.25, 0.5, 0.75]).select(
        "npy_path", "hour", "blks", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3")
    ).withColumn("low", F.col("q1") - expand * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + expand * (F.col("q3") - F.col("q1")))
    per_block = q.select("npy_path", F.explode("blks").alias("blk"), F.struct("hour", "low", "high").alias("f")).groupBy("npy_path", "blk").agg(F.collect_list("f").alias("fences"))
    counted = timed.join(per_block.hint("shuffle_hash"), ["npy_path", "blk"]).mapInArrow(count_outside(block), "npy_path string, hour int, n long")
    outside = counted.groupBy("npy_path", "hour").agg(F.sum("n").alias("n_outside"))
    return q.drop("blks").join(outside, ["npy_path", "hour"], "left").withColumn("n_outside", F.coalesce("n_outside", F.lit(0)))


def count_outside(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            b = Batch(batch)
            fs = batch.column("fs").to_numpy(zero_copy_only=False).astype(float)
            lists = batch.column("fences")
            each = lists.flatten()
            of = np.repeat(np.arange(len(batch)), np.diff(np.asarray(lists.offsets)))
            low, high = np.full((len(batch), 24), -np.inf), np.full((len(batch), 24), np.inf)
            hour = np.asarray(each.field("hour"))
            low[of, hour], high[of, hour] = np.asarray(each.field("low")), np.asarray(each.field("high"))
            fine = b.own(block) & np.isfinite(b.x)
            row, h = b.row[fine], hour_of(b.idx[fine], fs[b.row[fine]])
            out = (b.x[fine] < low[row, h]) | (b.x[fine] > high[row, h])
            keys, n = np.unique(row[out] * 24 + h[out], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("npy_path").take(pa.array(keys // 24, pa.int64())), pa.array(keys % 24, pa.int32()), pa.array(n, pa.int64())],
                names=["npy_path", "hour", "n"],
            )

    return run


def implausible_values(samples: DataFrame, recordings: DataFrame, channel_files: DataFrame, loggers: DataFrame) -> DataFrame:
    """``npy_path, idx``: each implausible reading, and (npy_path, -1) of each recording with a doubtful rate."""
    limits = source_limits(channel_files, loggers, recordings)
    return implausible(samples, limits).select("npy_path", "idx").unionByName(doubtful_rates(recordings))
