"""Joins of rows with hot keys to a table of one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
HOT = 50_000
MOST_HOT = 10_000


def salted_join(rows: DataFrame, single: DataFrame, on: list[str], salt_by: list[str], how: str = "inner", salts: int = SALTS, hot: int = HOT, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``single``, which has at most one row per key.

    Keys of more than ``hot`` rows are counted on the map side; their rows spread over ``salts`` copies of the key's single row. Other keys are
    not copied. The list of hot keys is broadcast and holds the MOST_HOT hottest at most; that bounds its size, not the result: a key beyond
    it is joined without copies. ``counts``, of columns ``on`` and ``_n``, saves the counting where the caller has counted; else ``rows`` is read twice.
    """
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n")) if counts is None else counts.select(*on, "_n")
    heavy = F.broadcast(counts.filter(F.col("_n") > hot).orderBy(F.desc("_n")).limit(MOST_HOT).select(*on, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt_by), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = rows.join(heavy, on, "left").withColumn("_salt", salt).drop("_hot")
    right = single.join(heavy, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
