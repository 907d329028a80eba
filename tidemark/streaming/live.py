"""Structured Streaming forms of sessions and orphan tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.references import Orphans


def event_sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """``key, started, ended, n``: sessions of events at most ``gap`` apart; events more than ``late`` behind are dropped."""
    w = F.session_window(at, gap)
    out = events.withWatermark(at, late).groupBy(key, w).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def window_stats(events: DataFrame, key: str, at: str, value: str, length: str, late: str) -> DataFrame:
    """Tumbling windows: ``key, started, n, mean, low, high``."""
    out = events.withWatermark(at, late).groupBy(key, F.window(at, length)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(key, F.col("window.start").alias("started"), "n", "mean", "low", "high")


class OrphanStream:
    """Keeps ``Orphans`` up to date from a stream of mixed rows; pass ``batch`` to ``foreachBatch``.

    Rows have REF and PARENT columns and ``is_ref``. The state is in ``folder``, so a stream that starts again goes on from it; a micro-batch that
    is sent a second time is known by its number and passed over.
    """

    def __init__(self, spark, folder: str | None = None) -> None:
        self.state = Orphans(spark, folder)

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        refs = rows.filter("is_ref").select("ref_table", "row_id", "parent_kind", "parent_key", "ref_at")
        parents = rows.filter("not is_ref").select("parent_kind", "parent_key", "first_at", "version", "removed")
        self.state.advance(refs, parents, batch_id)
