"""Splits that keep related records together.

Recordings of one session (equal session name) or linked across sessions by an annotation and its parent form a group.
Sessions are the nodes of the graph, not recordings, so a session with very many recordings is one node. Whole groups
are then dealt to the splits: subset-sum bitsets over the multiplicities of group sizes find the reachable total closest to each target.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import isqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.operators.ranking import hash_order, running
from tidemark.operators.salting import salted_join
from tidemark.session import cut_lineage
from tidemark.tables import first_loaded, session_name


def recording_nodes(recordings: DataFrame) -> DataFrame:
    """``recording_id, node``: the session of each recording id; one without ``source_file`` is a session of its own."""
    rows = first_loaded(recordings, "id", ["source_file"])
    name = F.concat(F.lit("s:"), session_name(F.col("source_file")))
    return rows.select(F.col("id").alias("recording_id"), F.coalesce(name, F.concat(F.lit("r:"), F.col("id").cast("string"))).alias("node"))


def annotation_links(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b``: sessions linked because an annotation on one has its parent on the other; both not deleted."""
    live = first_loaded(annotations, "id", ["recording_id", "parent_annotation_id", "deleted_at"]).filter("deleted_at is null and recording_id is not null")
    # children of one parent on one recording count once: a parent with very many children costs a row per recording
    child = live.filter("parent_annotation_id is not null").select("parent_annotation_id", F.col("recording_id").alias("child_rec")).distinct()
    parent = live.select(F.col("id").alias("parent_annotation_id"), F.col("recording_id").alias("parent_rec"))
    pairs = salted_join(child, parent, ["parent_annotation_id"], ["child_rec"]).filter("child_rec != parent_rec").select("child_rec", "parent_rec").distinct()
    a = nodes.select(F.col("recording_id").alias("child_rec"), F.col("node").alias("a"))
    b = nodes.select(F.col("recording_id").alias("parent_rec"), F.col("node").alias("b"))
    pairs = cut_lineage(pairs)
    return salted_join(salted_join(pairs, a, ["child_rec"], ["parent_rec"]), b, ["parent_rec"], ["child_rec"], counts=pairs.groupBy("parent_rec").agg(F.count("*").alias("_n"))).select("a", "b")


def groups(recordings: DataFrame, annotations: DataFrame) -> DataFrame:
    """``recording_id, group_id`` of every recording id; ``group_id`` is the smallest id of the group.

    Null ids are dropped; rows delivered twice count once (the first loaded holds); removed recordings count.
    """
    nodes = cut_lineage(recording_nodes(recordings))
    root = components(annotation_links(annotations, nodes))
    # few components, each with all of its sessions: a hot session or component is spread over copies of its row
    merged = cut_lineage(salted_join(nodes, root, ["node"], ["recording_id"], "left").select("recording_id", F.coalesce("root", "node").alias("node")))
    sized = cut_lineage(merged.groupBy("node").agg(F.min("recording_id").alias("group_id"), F.count("*").alias("_n")))
    return salted_join(merged, sized.drop("_n"), ["node"], ["recording_id"], counts=sized).select("recording_id", "group_id")


def grouped(recordings: DataFrame, annotations: DataFrame) -> DataFrame:
    """``group_id, recording_id``: a row for each recording other than the smallest of its group."""
    return groups(recordings, annotations).filter("recording_id != group_id").select("group_id", "recording_id")


# ---------------------------------------------------------------- dealing whole groups to splits


def subset_counts(multiplicity: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size to take so that the total is as close to ``target`` as any choice gets.

    Taking whole groups from the largest size on comes within one group of the target. Some best choice differs from that in few groups (five times the largest size at
    most: of more, some taken and some left would have equal totals and could be swapped), so all but that many groups of each size are settled at once.

    Of the rest, bit t of a bitset says that total t is reachable. A size's multiplicity is taken in chunks of 1, 2, 4, ..., so a
    size costs a logarithmic number of shift-and-or steps; the bitsets are walked back for the choice. Of two totals equally close, the smaller.
    Totals are true totals. A bitset has target plus largest size bits: a closest total above the target is less than one group beyond it. Of
    n bitsets about the square root of n are kept, and those between are made again on the way back, one stretch at a time.
    """
    largest = max(multiplicity, default=0)
    spare, left, out = 5 * largest, target, {}
    rest: dict[int, int] = {}
    for size, n in sorted(multiplicity.items(), reverse=True):
        whole = min(n, max(0, left) // size)
        left -= whole * size
        out[size] = max(0, whole - spare)
        rest[size] = min(n, whole + spare) - out[size]
    target -= sum(size * n for size, n in out.items())
    out = {size: n for size, n in out.items() if n}
    limit = target + largest
    mask = (1 << (limit + 1)) - 1
    chunks = []
    for size, n in sorted(rest.items()):
        k = 1
        while n > 0:
            take = min(k, n)
            if size * take <= limit:
                chunks.append((size, take))
            n, k = n - take, 2 * k
    stretch = isqrt(len(chunks)) + 1
    kept, last = [], 1
    for i, (size, take) in enumerate(chunks):
        if i % stretch == 0:
            kept.append(last)
        last = (last | (last << (size * take))) & mask
    below = (last & ((1 << (target + 1)) - 1)).bit_length() - 1
    high = last >> (target + 1)
    above = target + (high & -high).bit_length() if high else None
    total = below if above is None or target - below <= above - target else above
    while kept:
        first = (len(kept) - 1) * stretch
        part = chunks[first : first + stretch]
        reach = [kept.pop()]
        for size, take in part[:-1]:
            reach.append((reach[-1] | (reach[-1] << (size * take))) & mask)
        for (size, take), before in zip(reversed(part), reversed(reach)):
            if not (before >> total) & 1:
                total -= size * take
                out[size] = out.get(size, 0) + take
    assert total == 0
    return out


def deal(sizes: dict[int, int], shares: Sequence[tuple[str, float]]) -> dict[str, dict[int, int]]:
    """For each split, how many groups of each size it gets; the largest split takes what is left.

    Splits are filled from the smallest share on, each as close to its target as the sizes allow.
    """
    total = sum(size * n for size, n in sizes.items())
    left = dict(sizes)
    out: dict[str, dict[int, int]] = {}
    order = sorted(shares, key=lambda s: (s[1], s[0]))
    for name, share in order[:-1]:
        target = int(Fraction(share).limit_denominator(10**6) * total + Fraction(1, 2))
        out[name] = subset_counts({size: n for size, n in left.items() if n}, target)
        for size, n in out[name].items():
            left[size] -= n
    if order:
        out[order[-1][0]] = left
    return out


def records(recordings: DataFrame, annotations: DataFrame) -> DataFrame:
    """``row_table, row_id, group_key``: every recording and annotation with its group.

    An annotation of an unknown recording shares a group with others of that id; without any reference it is a group of its own.
    """
    of = groups(recordings, annotations).select("recording_id", F.concat(F.lit("g:"), F.col("group_id").cast("string")).alias("group_key"))
    recs = of.select(F.lit("recordings").alias("row_table"), F.col("recording_id").alias("row_id"), "group_key")
    notes = salted_join(cut_lineage(first_loaded(annotations, "id", ["recording_id"]).select("id", "recording_id")), of, ["recording_id"], ["id"], "left")
    own = F.coalesce("group_key", F.concat(F.lit("u:"), F.col("recording_id").cast("string")), F.concat(F.lit("a:"), F.col("id").cast("string")))
    return recs.unionByName(notes.select(F.lit("annotations").alias("row_table"), F.col("id").alias("row_id"), own.alias("group_key")))


def assign(recordings: DataFrame, annotations: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """``row_table, row_id, group_key, split_name``: every record, whole groups in one split.

    A group's size is its number of records. Which groups of a size a split gets follows a seeded hash order. Split targets are a
    small fixed table; the driver also gets the number of groups per size (distinct sizes: fewer than the square root of twice the records).
    Targets need not sum to 1: the largest split takes what the others leave. Without targets no record is assigned.
    """
    spark: SparkSession = recordings.sparkSession
    rows = cut_lineage(records(recordings, annotations))
    sized = cut_lineage(rows.groupBy("group_key").agg(F.count("*").alias("size")))
    sizes = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}
    shares = [(r[0], r[1]) for r in targets.filter("split_name is not null and target_share > 0").select("split_name", "target_share").collect()]
    cuts = []
    upto: dict[int, int] = {}
    for name, take in deal(sizes, shares).items():
        for size, n in take.items():
            if n:
                cuts.append((size, upto.get(size, 0), upto.get(size, 0) + n, name))
                upto[size] = upto.get(size, 0) + n
    plan = spark.createDataFrame(cuts, "size long, after long, until long, split_name string")
    ranked = running(sized.withColumn("h", hash_order("group_key", seed=seed)), ["size"], "h", "group_key")
    chosen = ranked.join(plan, "size").filter("upto > after and upto <= until").select("group_key", "split_name")
    return salted_join(rows, chosen, ["group_key"], ["row_table", "row_id"], counts=sized.select("group_key", F.col("size").alias("_n"))).select("row_table", "row_id", "group_key", "split_name")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """``split_name, target_share, n_recordings, n_annotations, actual_share``."""
    n = assigned.groupBy("split_name").agg(F.count(F.when(F.col("row_table") == "recordings", 1)).alias("n_recordings"), F.count(F.when(F.col("row_table") == "annotations", 1)).alias("n_annotations"))
    rows = targets.join(n, "split_name", "left").na.fill(0, ["n_recordings", "n_annotations"])
    size = F.col("n_recordings") + F.col("n_annotations")
    total = F.sum(size).over(Window.partitionBy(F.lit(1)))  # a row per split
    return rows.select("split_name", "target_share", "n_recordings", "n_annotations", (size / total).alias("actual_share"))
