"""Connected components of a distributed graph by min-hooking and contraction.

Each round points every node to its smallest neighbour, shortens the pointers
until they lead to roots, and keeps only the links between different roots, so
the graph shrinks by half or more a round. Nothing is collected; each step is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.llm.common import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of each node of ``links``; root is one node of its component, the same for all of it.

    Rows with a null end and loops are ignored; an empty graph gives no rows.
    """
    edges = materialize(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    roots: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
        up = materialize(up, "pointers")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            nxt = materialize(up.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "pointers")
            moved = not nxt.filter("moved").isEmpty()
            up = nxt.select("node", "root")
            if not moved:
                break
        if roots is None:
            roots = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = materialize(roots.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = materialize(ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
