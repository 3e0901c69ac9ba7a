"""Connected components of a link table, by contraction; all tables stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, join_one, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, component): each node that has an edge, with the smallest node reachable.

    Every round each node points to the neighbour (itself included) of least hash, the
    edges are carried over to the roots, and edges inside one root vanish. Hash order
    instead of id order makes sorted chains shrink by a constant factor a round too. A hot
    node has many edges but one row of state, so partial aggregation bears its load and its row is broadcast (join_one). No
    edges: an empty table. Self links and repeated links are harmless; rows with nulls are
    ignored.
    """
    pairs = (
        edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .where("a is not null and b is not null")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    pairs = stored(pairs, "edges")
    owner = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "owner")
    live = pairs.where("a <> b")
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("b"))).alias("m"))
        # the root of a node is its least neighbour if that one is less than itself, in hash order
        parent = parent.select(
            F.col("a").alias("node"),
            F.least(F.col("m"), F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b")))["b"].alias("parent"),
        )
        parent = stored(parent, "parents")
        spent, spent_owner = live, owner
        live = (
            join_one(join_one(live, parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), ["a"]), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb")), ["b"])
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
        live = stored(live, "live")
        owner = join_one(owner, parent.withColumnRenamed("node", "root"), ["root"], "left").select("node", F.coalesce("parent", "root").alias("root"))
        owner = stored(owner, "owner")
        discard(spent, spent_owner, parent)
    else:
        raise RuntimeError("components did not settle")
    discard(live, pairs)
    least = stored(owner.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("_n")), "least")
    return join_one(owner, least, ["root"], n="_n").select("node", "component")
