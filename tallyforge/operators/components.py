"""Connected components as a loop of joins; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.runtime import table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in ``edges``; component is the smallest node reachable.

    Each round hooks every node to the neighbour (or itself) that comes first in a fixed random order and
    contracts the graph along those hooks, so a hub, a chain and a clique all shrink by a constant share.
    Nulls are ignored, loops and repeated edges are allowed, no edges give no rows.
    """
    src = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    first = table(src.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    left, hooks = first.where("a <> b"), []
    for _ in range(max_rounds):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("id"))
        hook = both.groupBy("a").agg(F.min(order("b")).alias("n")).select(F.col("a").alias("node"), F.least(F.col("n"), order("a"))["id"].alias("to"))
        hook = table(hook, "cc-hooks")
        hooks.append(hook)
        at = lambda c: hook.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        moved = left.join(at("a"), "a").join(at("b"), "b").where("a_to <> b_to")
        left = table(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "cc-edges")
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = nodes.withColumn("root", F.col("node"))
    for hook in hooks:
        step = hook.select(F.col("node").alias("root"), "to")
        found = found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    found = table(found, "cc-roots")
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")
