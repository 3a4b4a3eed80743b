"""Connected components of an edge table, by hooking to smaller neighbours.

Each round hooks every node to its smallest neighbour, follows those parents for
a few steps, renames the edges and drops what has become a loop.  Edges and the
table of names are written after each round; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.storage import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: long); root is the smallest node it reaches."""
    live = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-edges-0")
    names = scratch.table(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), f"{name}-names-0")
    step = 0
    while not live.isEmpty():
        step += 1
        parent = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        parent = scratch.table(parent, f"{name}-parent-{step}")
        for jump in range(2):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            parent = parent.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"))
            parent = scratch.table(parent, f"{name}-parent-{step}-{jump}")
        of = lambda c: parent.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_to"))  # noqa: B023, E731
        renamed = live.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        live = scratch.table(renamed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-edges-{step}")
        names = scratch.table(names.join(of("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root")), f"{name}-names-{step}")
    return names
