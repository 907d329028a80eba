"""Joins of intervals by overlap, without a plan that compares all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared length over joint length; 0 if disjoint, touching or without length."""
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    joint = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when((shared <= 0) | (joint <= 0), 0.0).otherwise(shared / joint)


def width_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Longer over shorter width; null if either has none."""
    a, b = a_end - a_start, b_end - b_start
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def near_duplicates(spans: DataFrame, least_iou: float = 0.8, most_ratio: float = 1.5) -> DataFrame:
    """``recording_id, a_id, b_id, iou`` with a_id < b_id, for ``id, recording_id, start_idx, end_idx``.

    Spans that alike are nearly as wide and start within a fraction of their width of each other. They are hashed by width class and by cells of the start as
    wide as the class allows, each to its own and the next cell, so only spans that can match meet. Equal spans are folded first and expanded last.
    """
    width = F.col("end_idx") - F.col("start_idx")
    ok = spans.filter((width > 0) & F.col("recording_id").isNotNull())
    one = ok.groupBy("recording_id", "start_idx", "end_idx").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))
    cls = F.floor(F.log2(F.col("end_idx") - F.col("start_idx"))).cast("int")
    a = one.withColumn("cls", cls)
    cell = lambda c: F.floor(F.col("start_idx") / F.pow(F.lit(2.0), c + 1)).cast("long")
    left = a.select("*", cell(F.col("cls")).alias("cell"))
    # the other span is of this class or the next wider one, and in the same, the previous or the next cell
    right = a.select("recording_id", F.col("start_idx").alias("s2"), F.col("end_idx").alias("e2"), F.col("rep").alias("rep2"), F.col("ids").alias("ids2"), "cls", F.explode(F.array(F.col("cls"), F.col("cls") - 1)).alias("k"), "start_idx")
    right = right.select("recording_id", "s2", "e2", "rep2", "ids2", F.col("cls").alias("cls2"), F.col("k").alias("cls"), F.explode(F.array(*[cell(F.col("k")) + o for o in (-1, 0, 1)])).alias("cell"))
    j = left.join(right, ["recording_id", "cls", "cell"]).filter("rep != rep2 and (cls2 > cls or rep < rep2)")
    v = iou(F.col("start_idx"), F.col("end_idx"), F.col("s2"), F.col("e2"))
    r = width_ratio(F.col("start_idx"), F.col("end_idx"), F.col("s2"), F.col("e2"))
    hit = j.withColumn("iou", v).filter((F.col("iou") >= least_iou) & (r <= most_ratio))
    across = hit.select("recording_id", F.explode("ids").alias("x"), "ids2", "iou").select("recording_id", "x", F.explode("ids2").alias("y"), "iou")
    inside = one.filter(F.size("ids") > 1).select("recording_id", F.posexplode("ids").alias("p", "x"), "ids").select("recording_id", "x", F.explode(F.slice("ids", F.col("p") + 2, F.size("ids"))).alias("y"), F.lit(1.0).alias("iou"))
    return across.unionByName(inside).select("recording_id", F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"), "iou")


def clipped(periods: DataFrame) -> DataFrame:
    """Periods cut to positions from 0 on; those that end before are dropped."""
    return periods.filter("to_idx > 0").withColumn("from_idx", F.greatest("from_idx", F.lit(0)))


def bucket_cover(periods: DataFrame, key: str, size: int) -> DataFrame:
    """``key, bucket, fraction``: the covered share of each bucket of ``size`` positions that a merged period touches."""
    first, last = F.floor(F.col("from_idx") / size), F.floor((F.col("to_idx") - 1) / size)
    b = periods.select(key, "from_idx", "to_idx", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("bucket"))
    over = F.least(F.col("to_idx"), (F.col("bucket") + 1) * size) - F.greatest(F.col("from_idx"), F.col("bucket") * size)
    return b.groupBy(key, "bucket").agg(F.least(F.lit(1.0), F.sum(over) / size).alias("fraction"))
