"""The relational store: filters with parameters, tags, logs, provenance, similar spans, interval joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 62
MOST_CELLS = 8


def filter_annotations(rows: DataFrame, *, ids: DataFrame | None = None, text: str | None = None, **any_of: list) -> DataFrame:
    """Rows that have, for each named column, one of the listed values; an empty or missing list restricts nothing.

    ``ids`` (column ``id``) restricts to its ids, an empty table to none; ``text`` to rows whose note and tag hold it, whatever the letter case.
    """
    for column, values in any_of.items():
        if values:
            rows = rows.filter(F.col(column).isin(list(values)))
    if text:
        rows = rows.filter(F.lower(F.concat_ws(" ", "note", "tag")).contains(text.lower()))
    return rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")


def current(log: DataFrame, key: list[str], at: str, removed: str | None = None) -> DataFrame:
    """An append-only log's latest row per key; a key whose latest row is marked ``removed`` is gone. Of rows of one instant the largest holds."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("r")).select(*key, "r.*")
    return last.filter(F.col(removed).isNull()) if removed else last


def replace_tags(tags: DataFrame, fresh: DataFrame) -> DataFrame:
    """``id, category, value``: every (id, category) of ``fresh`` has its values from there alone; a null value only takes the old ones away."""
    kept = tags.join(fresh.select("id", "category").distinct(), ["id", "category"], "left_anti")
    return kept.select("id", "category", "value").unionByName(fresh.filter("value is not null").select("id", "category", "value")).distinct()


def missing_tag(rows: DataFrame, tags: DataFrame, category: str) -> DataFrame:
    """``id`` of rows without any tag of the category."""
    return rows.select("id").join(tags.filter(F.col("category") == category).select("id"), "id", "left_anti")


def tag_lists(tags: DataFrame) -> DataFrame:
    """``id, category, tags``: the values of each category in order."""
    return tags.groupBy("id", "category").agg(F.array_sort(F.collect_set("value")).alias("tags"))


def matching_all(tags: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """``id`` of those with one of the listed values in every named category; no category, no restriction."""
    if not any(wanted.values()):
        return tags.select("id").distinct()
    hit = reduce(lambda a, b: a | b, [(F.col("category") == c) & F.col("value").isin(v) for c, v in wanted.items() if v])
    return tags.filter(hit).groupBy("id").agg(F.count_distinct("category").alias("n")).filter(F.col("n") == sum(bool(v) for v in wanted.values())).select("id")


def export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """The rows as CSV with a header or as JSON lines, in as many files as there are partitions."""
    if kind not in ("csv", "json"):
        raise ValueError(kind)
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


# ---------------------------------------------------------------- intervals


def level_of(width: Column) -> Column:
    """The least k with ``width`` at most 2**k."""
    return F.ceil(F.log2(F.greatest(width, F.lit(1)).cast("double"))).cast("int")


def containing(points: DataFrame, intervals: DataFrame, on: list[str], at: str, low: str, high: str) -> DataFrame:
    """Points joined to the intervals that hold them, both bounds included.

    An interval lies in two blocks of its own power of two at most; a point is looked for once for each power that occurs among the intervals of its
    key. Both sides have more rows than the planner expects of them, so the joins are by merging: it would copy them to every executor by way of the driver.
    """
    k = level_of(F.col(high) - F.col(low) + 1)
    blocked = intervals.filter(F.col(low) <= F.col(high)).withColumn("_k", k)
    powers = blocked.groupBy(*on).agg(F.bit_or(F.expr("shiftleft(1L, _k)")).alias("_powers"))
    first, last = (F.floor(F.col(c) / F.pow(F.lit(2.0), "_k")).cast("long") for c in (low, high))
    blocked = blocked.withColumn("_b", F.explode(F.sequence(first, last)))
    occurring = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda p: F.getbit("_powers", p) == 1)
    sought = points.join(powers.hint("merge"), on).withColumn("_k", F.explode(occurring)).withColumn("_b", F.floor(F.col(at) / F.pow(F.lit(2.0), "_k")).cast("long")).drop("_powers")
    return sought.join(blocked.hint("merge"), [*on, "_k", "_b"]).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_k", "_b")


def overlapping(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of ``a`` (``a0, a1``) and ``b`` (``b0, b1``) that have a position in common, bounds included: one begins within the other."""
    inside = containing(a, b, on, "a0", "b0", "b1")
    around = containing(b, a, on, "b0", "a0", "a1").filter("b0 > a0")
    return inside.select(around.columns).unionByName(around)


def similar_spans(candidates: DataFrame, spans: DataFrame, iou: float = 0.8, ratio: float = 1.5) -> DataFrame:
    """``candidate_id, id, iou``: spans of the candidate's recording at least so much overlapped and at most so many times wider or narrower.

    Both have ``id, recording_id, start_idx, end_idx``, half-open; empty ones are similar to nothing. Spans that are alike are nearly as wide and begin within
    a fraction of their width of each other, so a span is in one cell of its width class and a candidate is looked for in the few cells that can match;
    where the limits leave too many cells, all overlapping pairs are looked at.
    """
    a = candidates.filter("end_idx > start_idx").select("recording_id", F.col("id").alias("candidate_id"), F.col("start_idx").alias("a0"), (F.col("end_idx") - 1).alias("a1"))
    b = spans.filter("end_idx > start_idx").select("recording_id", "id", F.col("start_idx").alias("b0"), (F.col("end_idx") - 1).alias("b1"))
    shared = F.least("a1", "b1") - F.greatest("a0", "b0") + 1
    joint = F.greatest("a1", "b1") - F.least("a0", "b0") + 1
    wa, wb = F.col("a1") - F.col("a0") + 1, F.col("b1") - F.col("b0") + 1
    share = (max(0.0, min(1.0, 1 / iou - 1)) if iou > 0 else 1.0) * (1 + 1e-9) + 1e-9
    most = (max(1.0, min(ratio, 1 / iou)) if iou > 0 else max(1.0, ratio)) * (1 + 1e-9)
    if share * most > MOST_CELLS:
        pairs = overlapping(a, b, ["recording_id"])
    else:
        cls = lambda w: F.floor(F.log2(w)).cast("int")
        cells = b.withColumn("_k", cls(wb)).withColumn("_c", F.floor(F.col("b0") / F.pow(F.lit(2.0), F.col("_k") + 1)).cast("long"))
        sought = a.withColumn("_k", F.explode(F.sequence(F.greatest(cls(wa / most), F.lit(0)), cls(wa * most))))
        first, last = F.floor(F.col("a0") / F.pow(F.lit(2.0), F.col("_k") + 1) - share), F.floor((F.col("a0") + wa * share) / F.pow(F.lit(2.0), F.col("_k") + 1))
        sought = sought.withColumn("_c", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        pairs = sought.join(cells.hint("merge"), ["recording_id", "_k", "_c"]).filter(shared > 0)
    pairs = pairs.withColumn("iou", shared / joint)
    return pairs.filter((F.col("iou") >= iou) & (F.greatest(wa, wb) / F.least(wa, wb) <= ratio)).select("candidate_id", "id", "iou")


def joined_events(envelope: DataFrame, wavelet: DataFrame, least: int = 1) -> DataFrame:
    """``recording_id, kind, from_idx, to_idx`` of overlapping regions (``a0, a1`` and ``b0, b1``, bounds included) of at least ``least`` samples.

    An envelope region within a wavelet region gives ``whole``, from the wavelet's start to its own end; a wavelet region within an envelope one is ``part``; of two that cross, the
    shorter side of the middle of what they share is ``part``, the first of equal ones.
    """
    p = overlapping(envelope, wavelet, ["recording_id"])
    low, high = F.least("a0", "b0"), F.greatest("a1", "b1")
    split = F.floor((F.greatest("a0", "b0") + F.least("a1", "b1")) / 2)
    in_wave, in_env = (F.col("b0") <= F.col("a0")) & (F.col("a1") <= F.col("b1")), (F.col("a0") <= F.col("b0")) & (F.col("b1") <= F.col("a1"))
    before = split - low <= high - split
    start = F.when(in_wave | in_env, F.col("b0")).when(before, low).otherwise(split)
    end = F.when(in_wave, F.col("a1")).when(in_env, F.col("b1")).when(before, split).otherwise(high)
    out = p.select("recording_id", F.when(in_wave, "whole").otherwise("part").alias("kind"), start.cast("long").alias("from_idx"), end.cast("long").alias("to_idx"))
    return out.filter(F.col("to_idx") - F.col("from_idx") >= least)


# ---------------------------------------------------------------- evaluation


def scored_hits(hits: DataFrame, events: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """``id, event``: for each hit the last event (largest id) whose span, widened by ``tolerance`` of its length on both sides, holds the hit's centre; null if none does."""
    centre = hits.withColumn("at", (F.col("start_idx") + F.col("end_idx")) / 2)
    pad = (F.col("end_idx") - F.col("start_idx")) * tolerance
    wide = events.select("recording_id", F.col("id").alias("event"), (F.col("start_idx") - pad).alias("low"), (F.col("end_idx") + pad).alias("high"))
    best = containing(centre.select("id", "recording_id", "at"), wide, ["recording_id"], "at", "low", "high").groupBy("id").agg(F.max("event").alias("event"))
    return hits.select("id").join(best.hint("merge"), "id", "left")


def precision_recall(scored: DataFrame, buckets: int = 64) -> DataFrame:
    """``score, precision, recall, area``: the curve at every score that occurs, from the highest, and each step's part of the area (average precision).

    Counts per score are summed in blocks of the score's range first, so the running sums are not made in one task.
    """
    c = scored.groupBy("score").agg(F.count(F.when(F.col("truth"), 1)).alias("p"), F.count("*").alias("n"))
    ends = c.agg(F.min("score"), F.max("score"), F.sum("p")).first()
    low, width, total = ends[0] or 0.0, max(((ends[1] or 0.0) - (ends[0] or 0.0)) / buckets, 1e-300), ends[2] or 0
    c = c.withColumn("blk", F.floor((F.col("score") - low) / width).cast("long"))
    sums = c.groupBy("blk").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    above = Window.partitionBy(F.lit(1)).orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` + 1 rows
    carry = sums.select("blk", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("cp"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("cn"))
    upto = Window.partitionBy("blk").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = c.join(carry, "blk").select("score", "p", (F.col("cp") + F.sum("p").over(upto)).alias("tp"), (F.col("cn") + F.sum("n").over(upto)).alias("k"))
    precision = F.col("tp") / F.col("k")
    return run.select("score", precision.alias("precision"), (F.col("tp") / max(total, 1)).alias("recall"), (precision * F.col("p") / max(total, 1)).alias("area"))


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``h_a, h_b, mutual, nmi`` of two columns in bits, null values left out; normalised by the mean of the entropies, 0 where that is 0."""
    c = rows.dropna(subset=[a, b]).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    h = lambda k: c.groupBy(k).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("t")))).alias(f"h_{k}"))
    joint = c.crossJoin(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("t")))).alias("h"))
    out = h("a").crossJoin(h("b")).crossJoin(joint).withColumn("mutual", F.col("h_a") + F.col("h_b") - F.col("h"))
    mean = (F.col("h_a") + F.col("h_b")) / 2
    return out.select("h_a", "h_b", "mutual", F.when(mean > 0, F.col("mutual") / mean).otherwise(0.0).alias("nmi"))


def rand_index(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs, agreeing, rand``: pairs of rows that both columns put together or both apart, from counts alone."""
    c = rows.dropna(subset=[a, b]).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    two = lambda n: n * (n - 1) / 2
    side = lambda k: c.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(f"s_{k}"))
    one = c.agg(F.sum(two(F.col("n"))).alias("both"), two(F.sum("n")).alias("pairs")).crossJoin(side("a")).crossJoin(side("b"))
    agreeing = F.col("pairs") + 2 * F.col("both") - F.col("s_a") - F.col("s_b")
    return one.select("pairs", agreeing.alias("agreeing"), F.when(F.col("pairs") > 0, agreeing / F.col("pairs")).alias("rand"))


# ---------------------------------------------------------------- window matrix


def grid_of(starts: DataFrame) -> DataFrame:
    """``recording_id, step, uniform, n``: the smallest distance of successive starts, and whether all are equal; null step for one start."""
    gap = F.col("start_idx") - F.lag("start_idx").over(Window.partitionBy("recording_id").orderBy("start_idx"))
    g = starts.select("recording_id", "start_idx").distinct().withColumn("gap", gap)
    return g.groupBy("recording_id").agg(F.min("gap").alias("step"), (F.coalesce(F.min("gap") == F.max("gap"), F.lit(True))).alias("uniform"), F.count("*").alias("n"))


def labels_of_scores(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``score``, the mean of the numbers of ``features`` that are not null or NaN, and ``label``, whether it reaches the threshold; rows without any number go."""
    fine = F.filter("features", lambda v: v.isNotNull() & ~F.isnan(v))
    mean = F.aggregate(fine, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(fine)
    return rows.filter(F.size(fine) > 0).withColumn("score", mean).withColumn("label", (F.col("score") >= threshold).cast("int"))


def stratified(rows: DataFrame, by: str, key: str, most: int, seed: str = "") -> DataFrame:
    """About ``most`` rows, each class by its share but one at least, in the order of a seeded hash of ``key``.

    The rank is bounded before rows of a class meet, so a hot class sends ``most`` rows a task, not all.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 1
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    ranked = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)
    quota = F.greatest(F.lit(1), F.bround(F.col("_n") * most / total, 0))
    return ranked.join(counts, by).filter(F.col("_rank") <= quota).drop("_rank", "_n")


def stage_shape(stage: str, m: Column) -> Column:
    """How a stage's time grows with the window's length m."""
    if stage in ("catch22", "fast_entropy"):
        return m * F.log2(F.greatest(m, F.lit(2)).cast("double"))
    if stage in ("slow_entropy", "cnn"):
        return m.cast("double") * m
    if stage == "rf":
        return m.cast("double")
    raise ValueError(f"no stage {stage}")


def cost_tier(seconds: Column) -> Column:
    """``interactive`` up to 60 s, ``background`` up to 900 s, else ``hpc``; ``unknown`` for null."""
    return F.when(seconds.isNull(), "unknown").when(seconds <= 60, "interactive").when(seconds <= 900, "background").otherwise("hpc")


def bins_between(start: float, end: float, odd: float = 5, even: float = 2) -> list[float]:
    """Signed edges: from ``start`` by turns ``odd`` and ``even`` times as far until ``end`` is reached, the same below zero, and zero."""
    up = [float(start)]
    while up[-1] < end:
        up.append(up[-1] * (odd if len(up) % 2 else even))
    return [-v for v in reversed(up)] + [0.0] + up
