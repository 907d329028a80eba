"""The bindings of signals, windows and spans to the test tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.tables import first_loaded, read


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def signal(spark: SparkSession, d: str) -> DataFrame:
    """A recording per user: values in the order of time."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return read(spark, d, "events").select(F.col("user_id").alias("recording_id"), at.alias("idx"), F.col("value").alias("x"))


SIG = "sig AS (SELECT user_id recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 idx, value x FROM events)"
LEN = "len AS (SELECT recording_id, count(*) n, min_by(x, idx) x0, max_by(x, idx) xn FROM sig GROUP BY ALL)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Ready-made windows: ``vec_id, label, v``."""
    return read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Windows as signals: ``recording_id, idx, x``."""
    return vectors(spark, d).select(F.col("vec_id").alias("recording_id"), F.posexplode("v").alias("idx", "x")).withColumn("idx", F.col("idx").cast("long"))


VEC = "vec AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings)"
PTS = "pts AS (SELECT vec_id recording_id, unnest(range(len(embedding))) idx, unnest(embedding::DOUBLE[]) x FROM embeddings)"


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Annotations that are not deleted, each id once."""
    cols = ["recording_id", "start_idx", "end_idx", "verdict", "tag", "note", "source", "event_count", "parent_annotation_id", "status", "deleted_at"]
    return first_loaded(read(spark, d, "annotations"), "id", cols).filter("deleted_at is null")


def recs(spark: SparkSession, d: str) -> DataFrame:
    return first_loaded(read(spark, d, "recordings"), "id", ["source_file", "channel", "fs", "n_samples", "global_offset", "npy_path"])


NOTES = "notes AS (SELECT * FROM (SELECT * FROM annotations QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1) WHERE deleted_at IS NULL)"
RECS = "recs AS (SELECT * FROM recordings QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
