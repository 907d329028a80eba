"""Sweep line over intervals: continuous periods, gaps and coverage per entity.

Every span becomes a plus event at its start and a minus event at its end; events at one position are summed
before any shuffle of rows, so an entity with very many spans costs at most one row per distinct position. The
prefix sum over positions runs in blocks of the position axis: block totals are summed per entity first and
carried into each block, so no task holds a whole hot entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage
from tidemark.tables import first_loaded

BLOCK = 1 << 16


def active_counts(spans: DataFrame, entity: list[str], start: str, end: str, block: int = BLOCK) -> DataFrame:
    """``entity, blk, pos, before, active, started, starts``: spans open just before and from each boundary on.

    ``started`` counts the spans that start at or before ``pos``. Spans with a null bound or ``end <= start`` are
    left out, and so are null entities. Extra columns are ignored; an empty table gives an empty result.
    """
    valid = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))
    valid = valid.dropna(subset=entity)
    edges = F.array(
        F.struct(F.col(start).cast("long").alias("pos"), F.lit(1).alias("delta"), F.lit(1).alias("starts")),
        F.struct(F.col(end).cast("long").alias("pos"), F.lit(-1).alias("delta"), F.lit(0).alias("starts")),
    )
    # written once: block totals and prefix sums both read it
    events = cut_lineage(
        valid.select(*entity, F.inline(edges))
        .groupBy(*entity, "pos")
        .agg(F.sum("delta").alias("delta"), F.sum("starts").alias("starts"))
        .withColumn("blk", F.floor(F.col("pos") / block).cast("long"))
    )
    totals = events.groupBy(*entity, "blk").agg(F.sum("delta").alias("d"), F.sum("starts").alias("s"))
    earlier = Window.partitionBy(*entity).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *entity,
        "blk",
        F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("carry_d"),
        F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("carry_s"),
    )
    upto = Window.partitionBy(*entity, "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        events.join(carry, [*entity, "blk"])
        .withColumn("active", F.col("carry_d") + F.sum("delta").over(upto))
        .withColumn("started", F.col("carry_s") + F.sum("starts").over(upto))
        .select(*entity, "blk", "pos", (F.col("active") - F.col("delta")).alias("before"), "active", "started", "starts")
    )


def periods(spans: DataFrame, entity: list[str], start: str, end: str, block: int = BLOCK) -> DataFrame:
    """``entity, from_idx, to_idx, n_spans, next_from``: overlapping or touching spans as one period.

    ``next_from`` is where the entity's next period starts, null for the last. Only boundaries where nothing is
    active on one side remain here. Each block looks at its own; what lies behind its last ones comes from a row per block.
    """
    sides = active_counts(spans, entity, start, end, block).filter("(before = 0) != (active = 0)")
    sides = cut_lineage(sides.select(*entity, "blk", "pos", "before", "started", "starts"))
    here = Window.partitionBy(*entity, "blk").orderBy("pos")
    first = sides.withColumn("k", F.row_number().over(here)).filter("k <= 2").groupBy(*entity, "blk")
    first = first.agg(F.min("pos").alias("p1"), F.max(F.when(F.col("k") == 2, F.col("pos"))).alias("p2"), F.min_by("started", "pos").alias("s1"))
    order = Window.partitionBy(*entity).orderBy("blk")
    ahead = first.select(*entity, "blk", F.lead("p1").over(order).alias("n1"), F.lead("s1").over(order).alias("ns"), F.coalesce(F.lead("p2").over(order), F.lead("p1", 2).over(order)).alias("n2"))
    one, two = F.lead("pos").over(here), F.lead("pos", 2).over(here)
    return (
        sides.join(ahead, [*entity, "blk"])
        .select(
            *entity,
            "pos",
            "before",
            (F.col("started") - F.col("starts")).alias("started_before"),
            F.coalesce(one, "n1").alias("to_idx"),
            F.coalesce(F.lead("started").over(here), "ns").alias("started_after"),
            F.when(one.isNull(), F.col("n2")).otherwise(F.coalesce(two, "n1")).alias("next_from"),
        )
        .filter("before = 0")
        .select(
            *entity,
            F.col("pos").alias("from_idx"),
            "to_idx",
            (F.col("started_after") - F.col("started_before")).alias("n_spans"),
            "next_from",
        )
    )


def merged_and_gaps(spans: DataFrame, entity: list[str], start: str, end: str, block: int = BLOCK) -> DataFrame:
    """``entity, kind, from_idx, to_idx``: ``merged`` periods of two or more spans, and ``gap`` rows between periods."""
    found = F.filter(
        F.array(
            F.when(F.col("n_spans") >= 2, F.struct(F.lit("merged").alias("kind"), F.col("from_idx").alias("a"), F.col("to_idx").alias("b"))),
            F.when(F.col("next_from").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("to_idx").alias("a"), F.col("next_from").alias("b"))),
        ),
        lambda row: row.isNotNull(),
    )
    rows = periods(spans, entity, start, end, block).select(*entity, F.inline(found))
    return rows.withColumnsRenamed({"a": "from_idx", "b": "to_idx"})


def both_tables(annotations: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``span_table, recording_id, start_idx, end_idx``: each id once, by its first loaded row, without soft-deleted annotations."""
    cols = ["recording_id", "start_idx", "end_idx"]
    live = first_loaded(annotations, "id", [*cols, "deleted_at"]).filter("deleted_at is null").select(*cols)
    seen = first_loaded(reviewed, "id", cols).select(*cols)
    return live.withColumn("span_table", F.lit("annotations")).unionByName(seen.withColumn("span_table", F.lit("reviewed_spans")))


def of_known(rows: DataFrame, recordings: DataFrame) -> DataFrame:
    """Rows whose recording exists; spans are reduced to periods before they meet the recordings."""
    return rows.join(recordings.select(F.col("id").alias("recording_id")).distinct(), "recording_id", "left_semi")


def span_periods(annotations: DataFrame, reviewed: DataFrame, recordings: DataFrame) -> DataFrame:
    both = both_tables(annotations, reviewed)
    return of_known(periods(both, ["span_table", "recording_id"], "start_idx", "end_idx"), recordings)


def span_cases(annotations: DataFrame, reviewed: DataFrame, recordings: DataFrame) -> DataFrame:
    """``span_table, recording_id, kind, from_idx, to_idx`` of both span tables, each by itself."""
    both = both_tables(annotations, reviewed)
    cases = of_known(merged_and_gaps(both, ["span_table", "recording_id"], "start_idx", "end_idx"), recordings)
    return cases.select("span_table", "recording_id", "kind", "from_idx", "to_idx")
