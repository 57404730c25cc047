"""Connected components of a graph given as a table of links, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltatlas.llm.tables import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``a long, b long`` -> ``node, root``: the smallest node that each node reaches.

    Every pass hangs each root on its smallest neighbouring root, follows the hooks to their ends
    by pointer doubling, and replaces the links by those between the ends; links inside a tree
    vanish. Passes are logarithmic in the longest chain. Nodes without a link are not listed, nor
    are links to oneself needed. Each pass is written to the shared folder, and hot nodes only
    meet partial minima and joins with a written table of one row for each node.
    """
    left = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b").distinct(), "cc-links")
    roots = stored(
        left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
        .select("node", F.col("node").alias("root")), "cc-roots")
    while left.limit(1).count():
        hooks = stored(left.groupBy("a").agg(F.min("b").alias("to")), "cc-hooks")
        while True:
            onward = hooks.select(F.col("a").alias("via"), F.col("to").alias("end"))
            stepped = stored(
                hooks.join(onward, F.col("to") == F.col("via"), "left")
                .select("a", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")),
                "cc-hooks")
            hooks = stepped.select("a", "to")
            if not stepped.filter("moved").limit(1).count():
                break
        ends = hooks.select(F.col("a").alias("old"), F.col("to").alias("new"))
        other = hooks.select(F.col("a").alias("old_b"), F.col("to").alias("new_b"))
        moved = (
            left.join(ends, F.col("a") == F.col("old"), "left")
            .join(other, F.col("b") == F.col("old_b"), "left")
            .select(F.coalesce("new", "a").alias("x"), F.coalesce("new_b", "b").alias("y"))
            .filter("x <> y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))
        left = stored(moved.distinct(), "cc-links")
        roots = stored(
            roots.join(ends, F.col("root") == F.col("old"), "left")
            .select("node", F.coalesce("new", "root").alias("root")), "cc-roots")
    return roots
