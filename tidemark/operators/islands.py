"""Runs, regions and sessions along ordered rows, and greedy selections over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """``key, value, first_idx, last_idx, n``: stretches of successive positions with one value."""
    w = Window.partitionBy(*key).orderBy(order)
    same = Window.partitionBy(*key, value).orderBy(order)
    marked = rows.withColumn("_g", F.row_number().over(w) - F.row_number().over(same))
    return marked.groupBy(*key, value, "_g").agg(F.min(order).alias("first_idx"), F.max(order).alias("last_idx"), F.count("*").alias("n")).drop("_g")


def regions(rows: DataFrame, key: list[str], condition: Column, gap: int, shortest: int) -> DataFrame:
    """``key, first_idx, last_idx`` (both inclusive) where ``condition`` holds; regions at most ``gap`` apart are one; short ones go."""
    w = Window.partitionBy(*key).orderBy("idx")
    hits = rows.filter(condition)
    cut = F.coalesce(F.col("idx") - F.lag("idx").over(w) > F.greatest(F.lit(1), F.lit(gap)), F.lit(True))
    g = hits.withColumn("_c", cut.cast("int")).withColumn("_g", F.sum("_c").over(w))
    out = g.groupBy(*key, "_g").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")).drop("_g")
    return out.filter(F.col("last_idx") - F.col("first_idx") + 1 >= shortest)


def sessions(points: DataFrame, key: list[str], at: str, gap: int, least: int, pad: int = 0) -> DataFrame:
    """``key, start_idx, end_idx, n``: points at most ``gap`` apart form a session; small ones go; padded, cut at 0."""
    w = Window.partitionBy(*key).orderBy(at)
    g = points.withColumn("_c", F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))).withColumn("_g", F.sum("_c").over(w))
    out = g.groupBy(*key, "_g").agg(F.greatest(F.lit(0), F.min(at) - pad).alias("start_idx"), (F.max(at) + pad).alias("end_idx"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= least).drop("_g")


def between(points: DataFrame, ends: DataFrame, at: str) -> DataFrame:
    """``recording_id, start_idx, end_idx``: the stretches between successive points, from 0 and up to ``n``; empty ones go."""
    marks = points.select("recording_id", F.col(at).cast("long").alias("p")).unionByName(ends.select("recording_id", F.explode(F.array(F.lit(0).cast("long"), F.col("n").cast("long"))).alias("p"))).distinct()
    w = Window.partitionBy("recording_id").orderBy("p")
    return marks.select("recording_id", F.col("p").alias("start_idx"), F.lead("p").over(w).alias("end_idx")).filter("end_idx is not null")


def fold_kept(rows: DataFrame, key: list[str], order: list[Column], pos: str, keep) -> DataFrame:
    """A greedy pass in ``order``: a row is kept if ``keep(kept positions, position)``; ``key, pos`` of the kept ones.

    Greedy choice is sequential within a key; candidates of one key (peaks, matches) are held as one array.
    """
    seq = F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(pos).cast("long").alias("p")))), lambda s: s["p"])
    lists = rows.groupBy(*key).agg(seq.alias("ps"))
    none = F.array().cast("array<bigint>")
    kept = F.aggregate("ps", none, lambda acc, p: F.when(keep(acc, p), F.concat(acc, F.array(p))).otherwise(acc))
    return lists.select(*key, F.explode(kept).alias(pos))


def refractory(points: DataFrame, key: list[str], at: str, distance: int) -> DataFrame:
    """Points at least ``distance`` after the last kept one."""
    return fold_kept(points, key, [F.col(at)], at, lambda acc, p: (F.size(acc) == 0) | (p - F.element_at(acc, -1) >= distance))


def separated(matches: DataFrame, key: list[str], score: str, at: str, distance: int) -> DataFrame:
    """Best (smallest) score first; a match closer than ``distance`` to any kept one goes; ties by position."""
    return fold_kept(matches, key, [F.col(score), F.col(at)], at, lambda acc, p: F.forall(acc, lambda q: F.abs(p - q) >= distance))


def merge_half_overlaps(spans: DataFrame, key: list[str]) -> DataFrame:
    """Successive spans (by start) that overlap by more than half of the shorter become one."""
    one = F.array_sort(F.collect_list(F.struct(F.col("start_idx").cast("long").alias("s"), F.col("end_idx").cast("long").alias("e"))))
    lists = spans.groupBy(*key).agg(one.alias("v"))
    none = F.array().cast("array<struct<s: bigint, e: bigint>>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        over = F.least(last["e"], x["e"]) - F.greatest(last["s"], x["s"])
        shorter = F.least(last["e"] - last["s"], x["e"] - x["s"])
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (over > shorter / 2), joined).otherwise(F.concat(acc, F.array(x)))

    return lists.select(*key, F.inline(F.aggregate("v", none, step))).withColumnsRenamed({"s": "start_idx", "e": "end_idx"})
