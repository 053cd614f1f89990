"""Connected components of large edge tables by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """Return ``node, root`` for every node of ``edges(a, b)``; nodes are connected iff roots are equal.

    In each round every node hooks onto the neighbour (or itself) of the least hash, edges
    move to the hooked nodes, and loops and repeats go. Hashing the order gives each round a
    constant factor of the nodes on average whatever the labels, so rounds grow with the
    logarithm of a component. Each round is written to the checkpoint folder: no lineage grows
    and lost executors cost one round. Null ends and loops are ignored; empty edges give no nodes.
    """
    def order(c: str):
        return F.struct(F.xxhash64(c, F.lit(7)).alias("h"), F.col(c).alias("id"))

    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    round_no = 0
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("x"), order("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), order("a").alias("y")))
        hook = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least(F.col("y"), order("x"))["id"].alias("to"))
        hook = materialise(hook, f"hook{round_no}")
        moved = edges.join(hook.select(F.col("x").alias("a"), F.col("to").alias("p")), "a").join(hook.select(F.col("x").alias("b"), F.col("to").alias("q")), "b")
        edges = materialise(moved.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), f"edges{round_no}")
        if found is None:
            found = hook.select(F.col("x").alias("node"), F.col("to").alias("root"))
        else:
            found = materialise(found.join(hook.select(F.col("x").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"roots{round_no}")
        round_no += 1
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
