"""Reachability over edge tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint_ready(df: DataFrame) -> bool:
    """Whether a shared checkpoint folder is known to the session; sets it from spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None and place:
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir() is not None


def reachable(edges: DataFrame, start: DataFrame, max_rounds: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """Nodes reached from start(node) over edges(a, b), breadth first.

    Each round joins only the newest nodes. max_nodes ends the search after the round that
    passes it, as an interactive recomposition does; max_rounds raises an error when nodes are still
    found after so many rounds. Lineage is cut every few rounds.
    """
    e = edges.select("a", "b").distinct()
    cut = checkpoint_ready(edges)
    seen = new = start.select("node").distinct()
    for k in count():
        new = e.join(new.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        if cut:
            new = new.checkpoint()
        else:
            new = new.persist()
        if new.isEmpty():
            break
        if k == max_rounds:
            raise RuntimeError(f"nodes are still found after {max_rounds} rounds")
        seen = seen.unionByName(new)
        if cut and k % 5 == 4:
            seen = seen.checkpoint()
        if max_nodes is not None and seen.count() > max_nodes:
            break
    return seen
