"""Neighbourhood operators on signals ``recording_id, idx, x`` (one row per sample, idx from 0 without holes).

A frame around each sample needs only its neighbours, so a recording is cut into blocks that carry a margin: a very long
recording is many tasks. Edge rules differ between operators and are stated at each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def with_margin(signal: DataFrame, before: int, after: int, block: int | None = None) -> DataFrame:
    """Each sample in its block ``blk`` and, with ``own`` false, in neighbouring blocks that look back or ahead at it."""
    size = max(block or BLOCK, 2 * (before + after) + 2)
    own = F.floor(F.col("idx") / size).cast("long")
    at = F.pmod(F.col("idx"), F.lit(size))
    copies = F.filter(F.array(F.struct(own.alias("blk"), F.lit(True).alias("own")), F.when(at >= size - before, F.struct((own + 1).alias("blk"), F.lit(False).alias("own"))), F.when(at < after, F.struct((own - 1).alias("blk"), F.lit(False).alias("own")))), lambda c: c.isNotNull())
    return signal.select("*", F.inline(copies))


def framed(signal: DataFrame, before: int, after: int, **made) -> DataFrame:
    """Adds columns made by functions of the ordered window of a block."""
    order = Window.partitionBy("recording_id", "blk").orderBy("idx")
    out = with_margin(signal, before, after)
    for name, f in made.items():
        out = out.withColumn(name, f(order))
    return out.filter("own").drop("blk", "own")


def lengths(signal: DataFrame) -> DataFrame:
    return signal.groupBy("recording_id").agg(F.count("*").alias("n"))


def ends(signal: DataFrame) -> DataFrame:
    """``recording_id, n, x0, xn``: length, first and last value."""
    return signal.groupBy("recording_id").agg(F.count("*").alias("n"), F.min_by("x", "idx").alias("x0"), F.max_by("x", "idx").alias("xn"))


def span(signal: DataFrame, start: int, end: int) -> DataFrame:
    """Samples of [start, end)."""
    return signal.filter((F.col("idx") >= start) & (F.col("idx") < end))


def first_share(signal: DataFrame, share: float) -> DataFrame:
    """The first floor(share * n) samples of each recording."""
    return signal.join(lengths(signal), "recording_id").filter(F.col("idx") < F.floor(F.lit(share) * F.col("n"))).drop("n")


def downsample(signal: DataFrame, fs_raw: float, fs_target: float) -> DataFrame:
    """Every k-th sample, renumbered; k = fs_raw / fs_target must be a whole number."""
    k = fs_raw / fs_target
    if k < 1 or abs(k - round(k)) > 1e-9:
        raise ValueError(f"{fs_raw} is no multiple of {fs_target}")
    k = int(round(k))
    return signal.filter(F.col("idx") % k == 0).withColumn("idx", F.floor(F.col("idx") / k).cast("long"))


def rolling_mean(signal: DataFrame, window: int) -> DataFrame:
    """Adds ``mean`` of [-h, h], h = max(1, window // 2); at the edges of what there is."""
    h = max(1, window // 2)
    return framed(signal, h, h, mean=lambda w: F.avg("x").over(w.rowsBetween(-h, h)))


def detrend(signal: DataFrame, mode: str = "rolling_mean", window: int = 600) -> DataFrame:
    """``x`` less its trend: ``rolling_mean``; ``rolling_z``, that over the rolling deviation (0 where it is at most 1e-12); ``linear``."""
    if mode == "linear":
        fit = signal.groupBy("recording_id").agg(F.regr_slope("x", "idx").alias("b"), F.regr_intercept("x", "idx").alias("a"), F.avg("x").alias("m"))
        line = F.coalesce(F.col("a") + F.col("b") * F.col("idx"), F.col("m"))
        return signal.join(fit, "recording_id").withColumn("x", F.col("x") - line).drop("a", "b", "m")
    flat = rolling_mean(signal, window).withColumn("x", F.col("x") - F.col("mean")).drop("mean")
    if mode == "rolling_mean":
        return flat
    if mode != "rolling_z":
        raise ValueError(mode)
    h = max(1, window // 2)
    spread = framed(flat, h, h, m=lambda w: F.avg("x").over(w.rowsBetween(-h, h)), q=lambda w: F.avg(F.col("x") * F.col("x")).over(w.rowsBetween(-h, h)))
    sd = F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))
    return spread.withColumn("x", F.when(sd <= 1e-12, 0.0).otherwise(F.col("x") / sd)).drop("m", "q")


def replicated_mean(signal: DataFrame, size: int) -> DataFrame:
    """Adds ``mean`` over ``size`` samples, edge samples repeated beyond the edges; an even size looks one further back."""
    left, right = size // 2, size - 1 - size // 2
    sums = framed(signal, left, right, s=lambda w: F.sum("x").over(w.rowsBetween(-left, right)))
    out = sums.join(ends(signal), "recording_id")
    short = F.greatest(F.lit(0), left - F.col("idx")) * F.col("x0") + F.greatest(F.lit(0), F.col("idx") + right - F.col("n") + 1) * F.col("xn")
    return out.withColumn("mean", (F.col("s") + short) / size).drop("s", "n", "x0", "xn")


def uniform_detrend(signal: DataFrame, window: int) -> DataFrame:
    """``x`` less its mean over max(3, window) samples with repeated edges; less the recording's mean where that is as long as it."""
    size = max(3, window)
    whole = signal.groupBy("recording_id").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    out = replicated_mean(signal, size).join(whole, "recording_id")
    return out.withColumn("x", F.col("x") - F.when(F.col("n") <= size, F.col("m")).otherwise(F.col("mean"))).drop("mean", "m", "n")


def rolling_median(signal: DataFrame, half: int) -> DataFrame:
    """``x`` as the median of 2 * half + 1 samples, edge samples repeated beyond the edges."""
    out = framed(signal, half, half, near=lambda w: F.collect_list("x").over(w.rowsBetween(-half, half)))
    at = out.join(ends(signal), "recording_id")
    pad = F.concat(F.array_repeat("x0", F.greatest(F.lit(0), half - F.col("idx")).cast("int")), "near", F.array_repeat("xn", F.greatest(F.lit(0), F.col("idx") + half - F.col("n") + 1).cast("int")))
    return at.withColumn("x", F.array_sort(pad)[half]).drop("near", "n", "x0", "xn")


def median_detrend(signal: DataFrame, half: int) -> DataFrame:
    base = rolling_median(signal, half).select("recording_id", "idx", F.col("x").alias("base"))
    return signal.join(base, ["recording_id", "idx"]).withColumn("x", F.col("x") - F.col("base")).drop("base")


def median_filter(signal: DataFrame, half: int, wide: int | None = None) -> DataFrame:
    """The median-smoothed signal less its own wider median."""
    return median_detrend(rolling_median(signal, half), wide or 2 * half)


def centre_on_median(signal: DataFrame) -> DataFrame:
    mid = signal.groupBy("recording_id").agg(F.percentile("x", 0.5).alias("mid"))
    return signal.join(mid, "recording_id").withColumn("x", F.col("x") - F.col("mid")).drop("mid")


def z_normalise(signal: DataFrame) -> DataFrame:
    """By the population deviation; zeros where that is 0."""
    s = signal.groupBy("recording_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return signal.join(s, "recording_id").withColumn("x", F.when(F.col("sd") == 0, 0.0).otherwise((F.col("x") - F.col("m")) / F.col("sd"))).drop("m", "sd")


def gradient(signal: DataFrame) -> DataFrame:
    """Adds ``dx``: central differences, one-sided at the ends (null for a single sample)."""
    out = framed(signal, 1, 1, p=lambda w: F.lag("x").over(w), q=lambda w: F.lead("x").over(w))
    return out.withColumn("dx", F.coalesce((F.col("q") - F.col("p")) / 2, F.col("q") - F.col("x"), F.col("x") - F.col("p"))).drop("p", "q")


def second_derivative(signal: DataFrame) -> DataFrame:
    """Adds ``d2`` = (next - 2x + previous) / 4, the ends repeated."""
    out = framed(signal, 1, 1, p=lambda w: F.lag("x").over(w), q=lambda w: F.lead("x").over(w))
    return out.withColumn("d2", (F.coalesce("q", "x") - 2 * F.col("x") + F.coalesce("p", "x")) / 4).drop("p", "q")


def spike_candidates(signal: DataFrame, width: int = 20, delta: float = 0.01) -> DataFrame:
    """Samples with abs(x) - abs(sum of [-2w, 2w] / 4w) > delta; the divisor is 4w at the edges too."""
    out = framed(signal, 2 * width, 2 * width, s=lambda w: F.sum("x").over(w.rowsBetween(-2 * width, 2 * width)))
    return out.filter(F.abs("x") - F.abs(F.col("s") / (4 * width)) > delta).drop("s")


def window_grid(signal: DataFrame, length: int, step: int, partial_tail: bool = False) -> DataFrame:
    """``recording_id, start_idx, length, is_full``: starts 0, step, ... of full windows, with ``partial_tail`` of ragged ones too."""
    last = F.col("n") - (1 if partial_tail else length)
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long")))
    return lengths(signal).select("recording_id", "n", F.explode(starts).alias("start_idx")).select("recording_id", "start_idx", F.lit(length).alias("length"), (F.col("start_idx") + length <= F.col("n")).alias("is_full"))


def windowed(signal: DataFrame, length: int, step: int) -> DataFrame:
    """Each sample once for every full window it is in: ``recording_id, start_idx, idx, x`` (no join: starts follow from idx)."""
    n = lengths(signal)
    last = F.least(F.floor(F.col("idx") / step), F.floor((F.col("n") - length) / step)).cast("long")
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - length) / step) + 1).cast("long")
    k = F.when((last >= first) & (F.col("n") >= length), F.sequence(first, last))
    return signal.join(n, "recording_id").select("recording_id", F.explode(k).alias("k"), "idx", "x").select("recording_id", (F.col("k") * step).alias("start_idx"), "idx", "x")


def decimate(signal: DataFrame, buckets: int) -> DataFrame:
    """Lowest and highest sample of each of ``buckets`` equal index ranges, in time order; of equal values the first."""
    b = signal.join(lengths(signal), "recording_id").withColumn("b", F.floor(F.col("idx") * buckets / F.col("n")).cast("long"))
    lo = F.min(F.struct("x", "idx"))
    hi = F.max(F.struct("x", (-F.col("idx")).alias("i")))
    both = b.groupBy("recording_id", "b").agg(lo.alias("lo"), hi.alias("hi"))
    pts = F.array_distinct(F.array(F.struct(F.col("lo.idx").alias("idx"), F.col("lo.x").alias("x")), F.struct((-F.col("hi.i")).alias("idx"), F.col("hi.x").alias("x"))))
    return both.select("recording_id", F.inline(pts))


def signed_bins(edges: list[float], value: Column) -> Column:
    """The number of edges at most ``value``."""
    out = F.lit(0)
    for e in edges:
        out = out + (value >= e).cast("int")
    return out
