"""Readers and the cleaning steps shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_loaded(df: DataFrame, key: str, columns: list[str], at: str = "loaded_at") -> DataFrame:
    """One row per ``key``: the values of the row loaded first, and that time as ``first_at``.

    Rows with a null key are dropped. Rows delivered at the same instant are told apart by the smallest values,
    so the result does not depend on file order. The aggregate combines on the map side, so a key delivered very
    often costs no large group.
    """
    first = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct(F.col(at).alias("first_at"), *columns)).alias("first_row"))
    )
    return first.select(key, "first_row.*")


def file_stem(name: Column) -> Column:
    """A file name without directory (``/`` or ``\\``), outer blanks, letter case and extension."""
    bare = F.trim(F.regexp_replace(F.trim(name), r"^.*[/\\]", ""))
    return F.regexp_replace(F.lower(bare), r"\.[a-z][a-z0-9]*$", "")


def session_name(name: Column) -> Column:
    """``file_stem`` without a leading ``<number>_percent_`` and a trailing ``_fs<number>``."""
    stem = F.regexp_replace(file_stem(name), r"^[0-9]+(\.[0-9]+)?_percent_", "")
    return F.regexp_replace(stem, r"_fs[0-9]+(\.[0-9]+)?$", "")


def clean_path(path: Column) -> Column:
    """``\\`` as ``/``, repeated ``/`` as one, no leading ``./``, no outer blanks; letter case kept."""
    slashed = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "/+", "/")
    return F.regexp_replace(slashed, r"^\./", "")
