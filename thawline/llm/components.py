"""Connected components of a links table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thawline.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component: the least node reachable.

    Each round every node hooks to the first of itself and its neighbours in an order by hash, then to that one's
    own; nodes that hook to the same one become one node, so that the graph shrinks by a factor each round, stars
    and long chains alike. Each round's edges and hooks are written and read again.
    """
    edges = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    edges = materialize(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    hooks = []
    while True:
        near = edges.groupBy("src").agg(F.min_by("dst", F.struct(F.xxhash64("dst"), "dst")).alias("dst"))
        rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
        hook = materialize(near.select(F.col("src").alias("node"), F.when(rank("dst") < rank("src"), F.col("dst")).otherwise(F.col("src")).alias("to")), "hooks")
        further = hook.select(F.col("node").alias("to"), F.col("to").alias("last"))
        hook = materialize(hook.join(further, "to").select("node", F.col("last").alias("to")), "hooks")
        hooks.append(hook)
        move = lambda c: hook.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        edges = edges.join(move("src"), "src").join(move("dst"), "dst").select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst"))
        edges = materialize(edges.where("src <> dst").distinct(), "edges")
        if edges.isEmpty():
            break
    roots = hooks.pop()
    for hook in reversed(hooks):
        nxt = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        roots = hook.join(nxt, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    roots = materialize(roots, "roots")
    least = roots.groupBy("to").agg(F.min("node").alias("component"))
    return materialize(roots.join(least, "to").select("node", "component"), "components")
