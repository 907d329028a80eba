"""Connected components by hooking and shortcutting over a parent table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.salting import salted_join
from tidemark.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: each node of ``edges`` (``a, b``, any ordered type) and the smallest node of its component.

    Each round hooks every node that has a smaller neighbour onto the smallest one (a map-side combined minimum, so a hub costs
    one row a partition), shortcuts the resulting forest by pointer jumping until every tree is a star, and replaces edges by the edges
    between roots. Rounds go on until no edge is left; every round at least halves the nodes that still have edges. Only tables
    are joined; nothing but row counts reaches the driver. Nodes without an edge to another node do not appear. Edges with a null end are ignored.
    """
    rest = cut_lineage(normal(edges))
    found: DataFrame | None = None
    while not rest.isEmpty():
        parent = rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        parent = shortcut(cut_lineage(parent))
        if found is None:
            found = parent
        else:
            # nodes hooked earlier follow their root; the newly hooked ones join them
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
            found = salted_join(found, up, ["root"], ["node"], "left").select("node", F.coalesce("up", "root").alias("root")).unionByName(parent)
        rest = cut_lineage(relabel(rest, parent))
        found = cut_lineage(found)
    if found is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = found.select(F.col("root").alias("node")).distinct()
    return found.unionByName(roots.select("node", F.col("node").alias("root")))


def normal(edges: DataFrame) -> DataFrame:
    """Edges from the smaller to the larger end, each once, without loops."""
    return edges.filter("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shortcut(parent: DataFrame) -> DataFrame:
    """Every node's parent replaced by its grandparent until nothing changes."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = cut_lineage(salted_join(parent, up, ["root"], ["node"], "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        parent = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return parent


def relabel(edges: DataFrame, parent: DataFrame) -> DataFrame:
    """Edges with both ends replaced by their roots."""
    for end in ("a", "b"):
        of = parent.select(F.col("node").alias(end), F.col("root").alias("_root"))
        edges = salted_join(edges, of, [end], ["a", "b"], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return normal(edges)
