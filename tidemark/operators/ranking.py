"""Ranks and running sums within groups of any size.

A plain window over a hot group would run in one task. Here each group is cut into buckets of its order key; bucket
totals are summed per group (few rows), carried into the buckets, and the windows run per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SHIFT = 62 - 10  # the order key's upper ten bits: 1,024 buckets


def hash_order(*cols: str | Column, seed: int = 0) -> Column:
    """A seeded, evenly spread, non-negative 62-bit order key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 2)


def running(df: DataFrame, group: list[str], order: str, tie: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``upto``: the running sum of ``weight`` (rows, if None) in each group, the row itself included.

    ``order`` must be a ``hash_order`` column, ``tie`` breaks its ties. Null groups form one group.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    rows = df.withColumn("_w", w).withColumn("_bucket", F.shiftright(F.col(order), BUCKET_SHIFT).cast("int"))
    totals = rows.groupBy(*group, "_bucket").agg(F.sum("_w").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry"))
    same = F.col("_bucket") == F.col("_b")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carry, same)
    return joined.withColumn("upto", F.col("_carry") + F.sum("_w").over(inside)).drop("_w", "_bucket", "_b", "_carry", *[f"_g_{c}" for c in group])
