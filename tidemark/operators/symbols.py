"""Symbolic encodings: segment means, level and trend symbols, letters, diagnostics and word distances."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cutlines(alphabet: int) -> list[float]:
    """Equiprobable cut lines of the standard normal distribution."""
    return [NormalDist().inv_cdf(k / alphabet) for k in range(1, alphabet)]


def quantise(value: Column, cuts: list[float]) -> Column:
    """The number of cut lines at most ``value``: 0 .. len(cuts)."""
    out = F.lit(0)
    for c in cuts:
        out = out + (value >= F.lit(c)).cast("int")
    return out


def recommended_symbols(n: Column) -> Column:
    """A twentieth of the samples, halves to even, between 16 and 256."""
    return F.greatest(F.lit(16), F.least(F.lit(256), F.bround(n / 20, 0))).cast("long")


def samples_asked(mode: str, value: float, fs: Column, n: Column) -> Column:
    """Samples per symbol that a way of asking comes to, at least 1; halves to even."""
    if mode == "seconds_per_symbol":
        asked = F.bround(F.lit(float(value)) * fs, 0)
    elif mode == "samples_per_symbol":
        asked = F.lit(round(value))
    elif mode == "target_symbol_count":
        asked = F.bround(n / max(1, round(value)), 0)
    elif mode == "dim_ratio":
        asked = F.lit(round(1.0 / value)) if value > 0 else n
    else:
        raise ValueError(f"no way to ask for segments: {mode}")
    return F.greatest(F.lit(1), asked)


def planned(rows: DataFrame, asked: Column, n: str) -> DataFrame:
    """Adds ``requested, symbols, trimmed, per_symbol, dim_ratio``: whole segments of equal length, the samples over cut from the end.

    ``dim_ratio`` times ``n``, rounded down, gives the number of symbols again: half a symbol is added against rounding.
    """
    out = rows.withColumn("requested", asked.cast("long"))
    out = out.withColumn("symbols", F.greatest(F.lit(1).cast("long"), F.floor(F.col(n) / F.col("requested"))))
    out = out.withColumn("trimmed", F.col(n) % F.col("symbols"))
    return out.withColumn("per_symbol", F.floor((F.col(n) - F.col("trimmed")) / F.col("symbols"))).withColumn("dim_ratio", (F.col("symbols") + 0.5) / F.col(n))


def paa(signal: DataFrame, per_segment: int) -> DataFrame:
    """``recording_id, seg, mean, n`` of full segments of ``per_segment`` samples; a shorter tail is left out."""
    seg = F.floor(F.col("idx") / per_segment).cast("long")
    return signal.groupBy("recording_id", seg.alias("seg")).agg(F.avg("x").alias("mean"), F.count("*").alias("n")).filter(F.col("n") == per_segment)


def fractional_paa(signal: DataFrame, segments: int) -> DataFrame:
    """``recording_id, seg, mean``: exactly ``segments`` equal parts; a sample on a boundary counts by its share."""
    n = signal.groupBy("recording_id").agg(F.count("*").alias("n"))
    low, high = F.col("idx") * segments / F.col("n"), (F.col("idx") + 1) * segments / F.col("n")
    s = signal.join(n, "recording_id").withColumn("lo", low).withColumn("hi", high)
    parts = s.select("recording_id", "x", "lo", "hi", F.explode(F.sequence(F.floor("lo").cast("long"), F.least(F.lit(segments - 1).cast("long"), F.floor(F.col("hi") - 1e-9).cast("long")))).alias("seg"))
    share = F.greatest(F.lit(0.0), F.least(F.col("hi"), F.col("seg") + 1) - F.greatest(F.col("lo"), F.col("seg")))
    return parts.withColumn("w", share).groupBy("recording_id", "seg").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"))


def trends(z: DataFrame, per_segment: int, how: str = "ols") -> DataFrame:
    """``recording_id, seg, delta``: the rise over each full segment: ``ols`` slope times length - 1, or ``endpoints``."""
    seg = F.floor(F.col("idx") / per_segment).cast("long")
    rise = F.regr_slope("x", "idx") * (per_segment - 1) if how == "ols" else F.max_by("x", "idx") - F.min_by("x", "idx")
    return z.groupBy("recording_id", seg.alias("seg")).agg(rise.alias("delta"), F.count("*").alias("n")).filter(F.col("n") == per_segment).drop("n")


def trend_symbols(deltas: DataFrame, same_fraction: float = 0.5) -> DataFrame:
    """Adds ``symbol`` (0 down, 1 same, 2 up): cut lines are symmetrised quantiles that leave ``same_fraction`` in the middle.

    A recording whose cut lines fall together is all same if its rises are zero, else down or up by their sign.
    """
    side = (1 - same_fraction) / 2
    q = deltas.groupBy("recording_id").agg(F.percentile("delta", side).alias("lo"), F.percentile("delta", 1 - side).alias("hi"))
    h = (F.col("hi") - F.col("lo")) / 2
    j = deltas.join(q.select("recording_id", h.alias("h")), "recording_id")
    split = (F.col("delta") >= -F.col("h")).cast("int") + (F.col("delta") >= F.col("h")).cast("int")
    flat = F.when(F.col("delta") > 0, 2).when(F.col("delta") < 0, 0).otherwise(1)
    return j.withColumn("symbol", F.when(F.col("h") > 0, split).otherwise(flat)).drop("h")


def letters(symbols: DataFrame, alphabet: str = "DSU") -> DataFrame:
    """``recording_id, word``: the symbols of a recording as one string."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seg", "symbol"))), lambda s: F.substring(F.lit(alphabet), s["symbol"].cast("int") + 1, F.lit(1)))
    return symbols.groupBy("recording_id").agg(F.array_join(ordered, "").alias("word"))


def find_shapes(words: DataFrame, pattern: str) -> DataFrame:
    """``recording_id, first_seg, last_seg``: matches of a regular expression in the words, from the left, without overlap."""
    # positions: each match is looked for after the end of the one before it
    folded = F.expr(
        f"aggregate(regexp_extract_all(word, '({pattern})', 1), named_struct('at', 0, 'out', cast(array() as array<struct<a: int, z: int>>)), "
        "(acc, h) -> named_struct('at', locate(h, word, acc.at + 1) - 1 + length(h), 'out', concat(acc.out, array(named_struct('a', locate(h, word, acc.at + 1) - 1, 'z', locate(h, word, acc.at + 1) - 2 + length(h))))), acc -> acc.out)"
    )
    return words.select("recording_id", F.inline(folded)).withColumnsRenamed({"a": "first_seg", "z": "last_seg"})


def diagnostics(symbols: DataFrame, alphabet: int) -> DataFrame:
    """``recording_id, n, entropy, ceiling, ratio, self_transitions``: occupancy entropy in bits and how often a symbol repeats."""
    import math

    w = Window.partitionBy("recording_id").orderBy("seg")
    counts = symbols.groupBy("recording_id", "symbol").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy("recording_id"))
    p = counts.withColumn("p", F.col("c") / total).groupBy("recording_id").agg(F.sum("c").alias("n"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    same = symbols.select("recording_id", (F.col("symbol") == F.lag("symbol").over(w)).cast("double").alias("same")).groupBy("recording_id").agg(F.coalesce(F.avg("same"), F.lit(0.0)).alias("self_transitions"))
    top = math.log2(alphabet)
    return p.join(same, "recording_id").select("recording_id", "n", "entropy", F.lit(top).alias("ceiling"), (F.col("entropy") / top).alias("ratio"), "self_transitions")


def cell_table(cuts: list[float]) -> list[list[float]]:
    """Distances between symbols: 0 for equal and neighbouring ones, else between the nearer cut lines."""
    k = len(cuts) + 1
    return [[0.0 if abs(a - b) <= 1 else cuts[max(a, b) - 1] - cuts[min(a, b)] for b in range(k)] for a in range(k)]


def cell_distance(a: Column, b: Column, cuts: list[float]) -> Column:
    lines = F.array(*[F.lit(c) for c in cuts])
    return F.when(F.abs(a - b) <= 1, 0.0).otherwise(F.element_at(lines, F.greatest(a, b)) - F.element_at(lines, F.least(a, b) + 1))
