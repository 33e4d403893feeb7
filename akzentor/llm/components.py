"""Connected components over a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akzentor.llm.common import discard, keep


def _jump(pointers: DataFrame) -> DataFrame:
    """pointers(node, up) with up < node: replace `up` by its own pointer until all point at roots."""
    while True:
        above = pointers.select(F.col("node").alias("up"), F.col("up").alias("top"))
        moved = keep(pointers.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "jump")
        changed = not moved.filter("moved").isEmpty()
        discard(pointers)
        pointers = moved.select("node", "up")
        pointers._akzentor_path = moved._akzentor_path
        if not changed:
            return pointers


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) longs -> (node, component) for every node that is linked with another node.

    `component` is the smallest node reachable, the node itself included. Each round points
    every node at its smallest neighbour where that is smaller, compresses the pointers to
    roots, and replaces links by links between roots; the graph shrinks until no link is left.
    Rounds are written to the shared folder, so no lineage grows and nothing is collected.
    Nulls and self links are ignored; no links give an empty table.
    """
    edges = keep(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo is not null and hi is not null and lo < hi").distinct(), "edges")
    total: DataFrame | None = None
    while not edges.isEmpty():
        pointers = _jump(keep(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")), "pointers"))
        lo = pointers.select(F.col("node").alias("lo"), F.col("up").alias("lo_up"))
        hi = pointers.select(F.col("node").alias("hi"), F.col("up").alias("hi_up"))
        half = keep(edges.join(lo, "lo", "left").select(F.coalesce("lo_up", "lo").alias("lo"), "hi"), "half")
        moved = half.join(hi, "hi", "left").select("lo", F.coalesce("hi_up", "hi").alias("hi"))
        after = keep(moved.filter("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct(), "edges")
        discard(half)
        discard(edges)
        edges = after
        if total is None:
            total = pointers
        else:
            step = pointers.select(F.col("node").alias("up"), F.col("up").alias("top"))
            joined = total.join(step, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
            merged = keep(joined.unionByName(pointers), "total")
            discard(total)
            discard(pointers)
            total = merged
    if total is None:
        return edges.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    total = keep(total.select("node", F.col("up").alias("component")), "components")
    roots = total.select(F.col("component").alias("node"), "component").distinct()
    return total.unionByName(roots)
