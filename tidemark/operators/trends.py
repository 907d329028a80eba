"""Trend symbols beyond the usual three: estimators of a segment's rise, ways to set cut lines, and their health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THINNED = 200


def segment_lists(signal: DataFrame, per_segment: int) -> DataFrame:
    """``recording_id, seg, xs``: the samples of every full segment in order."""
    if per_segment < 2:
        raise ValueError("a trend needs two samples")
    seg = F.floor(F.col("idx") / per_segment).cast("long")
    lists = signal.groupBy("recording_id", seg.alias("seg")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda p: p["x"]).alias("xs"))
    return lists.filter(F.size("xs") == per_segment)


def middle(values: Column) -> Column:
    """The median of a list."""
    v, n = F.array_sort(values), F.size(values)
    return (F.element_at(v, F.floor((n + 1) / 2).cast("int")) + F.element_at(v, F.floor((n + 2) / 2).cast("int"))) / 2


def robust_endpoints(signal: DataFrame, per_segment: int, k: int = 1) -> DataFrame:
    """``recording_id, seg, delta``: median of the last less median of the first ``k`` samples, k at most half a segment."""
    k = min(max(1, k), per_segment // 2)
    return segment_lists(signal, per_segment).select("recording_id", "seg", (middle(F.slice("xs", -k, k)) - middle(F.slice("xs", 1, k))).alias("delta"))


def theil_sen(signal: DataFrame, per_segment: int) -> DataFrame:
    """``recording_id, seg, delta``: the median slope of all pairs of samples times length - 1; of longer segments THINNED samples, evenly spread."""
    n = per_segment
    at = list(range(n)) if n <= THINNED else sorted({round(j * (n - 1) / (THINNED - 1)) for j in range(THINNED)})
    idx = F.array(*[F.lit(i) for i in at])
    slope = lambda i: F.transform(F.filter(idx, lambda j: j > i), lambda j: (F.element_at("xs", j + 1) - F.element_at("xs", i + 1)) / (j - i))
    slopes = F.flatten(F.transform(idx, slope))
    return segment_lists(signal, per_segment).select("recording_id", "seg", (middle(slopes) * (n - 1)).alias("delta"))


def cut_lines(deltas: DataFrame, mode: str = "quantile", k: int = 3, same_fraction: float = 0.5, threshold: float | None = None, least_half: float | None = None, symmetric: bool = True) -> DataFrame:
    """``recording_id, cuts``: k - 1 ascending cut lines of each recording's rises.

    ``quantile``: for three symbols those that leave ``same_fraction`` in the middle, else equally filled classes, made symmetric about zero unless told otherwise;
    ``absolute``: plus and minus ``threshold``, for three symbols. ``least_half`` widens the middle class of an odd alphabet. Rises that are all zero have lines that call
    all of them the same, rises that are all equal lines that give their direction. Lines that coincide are forced apart.
    """
    if k < 2:
        raise ValueError("an alphabet has two symbols at least")
    if mode == "absolute":
        if k != 3 or not threshold or threshold <= 0:
            raise ValueError("absolute lines are for three symbols and a positive threshold")
        lines = F.array(F.lit(-float(threshold)), F.lit(float(threshold)))
    elif mode == "quantile":
        if not 0 < same_fraction < 1:
            raise ValueError("same_fraction lies between 0 and 1")
        shares = [(1 - same_fraction) / 2, (1 + same_fraction) / 2] if k == 3 else [j / k for j in range(1, k)]
        lines = F.percentile("delta", shares)
    else:
        raise ValueError(mode)
    g = deltas.groupBy("recording_id").agg(lines.alias("c") if mode == "quantile" else F.first(lines).alias("c"), F.max("delta").alias("hi"), F.min("delta").alias("lo"), F.avg("delta").alias("mean"), F.stddev_pop("delta").alias("sd"))
    if mode == "quantile":
        if symmetric:
            g = g.withColumn("c", F.zip_with("c", F.reverse("c"), lambda a, b: (a - b) / 2))
        big = F.greatest(F.abs("hi"), F.abs("lo"))
        tol = 1e-9 * F.greatest(big, F.lit(1.0))
        spread = lambda half, n, first: F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda j: -half + (j + first) * (2 * half / n))
        zero = F.array(F.lit(0.0)) if k == 2 else spread(2 * F.greatest(big, tol), k - 2, 0)
        g = g.withColumn("c", F.when(F.col("hi") - F.col("lo") > tol, F.col("c")).when(big <= tol, zero).otherwise(spread(F.abs("mean"), k, 1)))
    if least_half is not None and k % 2 and k > 2:
        w, m = abs(float(least_half)), (k - 1) // 2  # the middle class lies between lines m and m + 1, counted from 1
        eps = lambda v: F.abs(v) * 1e-9 + 1e-9
        up = F.aggregate(F.slice("c", m + 1, m), F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) == 0, F.greatest(v, F.lit(w))).when(v <= F.element_at(acc, -1), F.element_at(acc, -1) + eps(F.element_at(acc, -1))).otherwise(v))))
        down = F.aggregate(F.reverse(F.slice("c", 1, m)), F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) == 0, F.least(v, F.lit(-w))).when(v >= F.element_at(acc, -1), F.element_at(acc, -1) - eps(F.element_at(acc, -1))).otherwise(v))))
        g = g.withColumn("c", F.concat(F.reverse(down), up))
    step = 1e-9 * F.greatest(F.array_max(F.transform("c", lambda v: F.abs(v))), F.col("sd"), F.lit(1.0))
    g = g.withColumn("step", step)
    apart = F.aggregate("c", F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(F.when((F.size(acc) > 0) & (v <= F.element_at(acc, -1)), F.element_at(acc, -1) + F.col("step")).otherwise(v))))
    return g.select("recording_id", apart.alias("cuts"))


def symbols_of(deltas: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``symbol``: how many of the recording's cut lines are at most its rise."""
    return deltas.join(cuts, "recording_id").withColumn("symbol", F.size(F.filter("cuts", lambda c: c <= F.col("delta")))).drop("cuts")


# The letters of trend alphabets of three and five symbols.
LETTERS = {3: "DSU", 5: "dDSUu"}


def diagnostics(deltas: DataFrame, cuts: DataFrame) -> DataFrame:
    """``recording_id, half_width, same_share, mean_delta, suspect, drifting``: the middle class, how many rises are in it, and what speaks against the encoding.

    ``suspect``: 40 to 60 % of the rises in the middle class, which noise alone gives; ``drifting``: the mean rise is over a quarter of the class's half width. Null
    for an even number of symbols, which has no middle class.
    """
    n = F.size("cuts")
    half = F.when((n % 2 == 0) & (n >= 2), (F.element_at("cuts", (n / 2 + 1).cast("int")) - F.element_at("cuts", F.greatest(F.lit(1), (n / 2).cast("int")))) / 2)
    level = lambda v: F.size(F.filter("cuts", lambda c: c <= v))
    j = deltas.join(cuts, "recording_id").withColumn("same", (level(F.col("delta")) == level(F.lit(0.0))).cast("int")).withColumn("half", half)
    g = j.groupBy("recording_id").agg(F.first("half").alias("half_width"), F.avg("same").alias("same_share"), F.avg("delta").alias("mean_delta"))
    known = F.col("half_width").isNotNull()
    return g.select("recording_id", "half_width", "same_share", "mean_delta", F.when(known, F.col("same_share").between(0.4, 0.6)).alias("suspect"), F.when(known, (F.col("half_width") > 0) & (F.abs("mean_delta") > 0.25 * F.col("half_width"))).alias("drifting"))


# ---------------------------------------------------------------- seeds in symbol sequences


def matches(sequences: DataFrame, key: str, seed: list[int], cost: list[list[float]] | None = None, most: float | None = None, wildcard: int = -1) -> DataFrame:
    """``key, first_pos, distance``: every place of a sequence (column ``symbols``) where the seed fits, wildcards of the seed fitting anything.

    Without ``cost`` the distance is the share of symbols that differ; with a table of symbol distances, the root mean square over the seed's length. ``most`` bounds the number of
    differing symbols, or the distance. A seed longer than the sequence fits nowhere; one of wildcards only is an error.
    """
    fixed = [(k, s) for k, s in enumerate(seed) if s != wildcard]
    if not fixed:
        raise ValueError("a seed of wildcards fits everywhere")
    at = lambda i, k: F.element_at("symbols", (i + k + 1).cast("int"))
    places = F.when(F.size("symbols") >= len(seed), F.sequence(F.lit(0), F.size("symbols") - len(seed)))
    if cost is None:
        total = lambda i: sum(((at(i, k) != s).cast("int") for k, s in fixed), F.lit(0))
        rows = sequences.select(key, "symbols", F.explode(places).alias("first_pos")).withColumn("n", total(F.col("first_pos")))
        rows = rows if most is None else rows.filter(F.col("n") <= most)
        return rows.select(key, "first_pos", (F.col("n") / len(fixed)).alias("distance"))
    cell = lambda i, k, s: F.when(at(i, k) >= 0, F.coalesce(F.try_element_at(F.array(*[F.lit(c * c) for c in cost[s]]), at(i, k) + 1), F.lit(0.0))).otherwise(0.0)
    rows = sequences.select(key, "symbols", F.explode(places).alias("first_pos"))
    rows = rows.select(key, "first_pos", F.sqrt(sum((cell(F.col("first_pos"), k, s) for k, s in fixed), F.lit(0.0)) / len(seed)).alias("distance"))
    return rows if most is None else rows.filter(F.col("distance") <= most)
