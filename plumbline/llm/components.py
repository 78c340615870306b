"""Connected components as a loop of DataFrame contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) of whole numbers to (node, component): the smallest node that is reachable.

    Each round hooks every node to its smallest neighbour, doubles the pointers once and contracts the edges, so at
    least half of the remaining nodes go; the number of rounds grows with the logarithm of the largest component.
    Every round is written to the shared folder. Loops and repeated edges are ignored; no edges give no rows.
    """
    links = edges.where("src <> dst").select("src", "dst")
    links = materialize(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    at = links.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node"))
    while not links.isEmpty():
        hook = links.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("up"))
        hook = materialize(hook, "hook")
        again = hook.select(F.col("src").alias("mid"), F.col("up").alias("top"))
        hook2 = materialize(hook.join(small(again), F.col("up") == F.col("mid"), "left").select("src", F.coalesce("top", "up").alias("up")), "hook")
        a = small(hook2.select(F.col("src").alias("a"), F.col("up").alias("a_up")))
        b = small(hook2.select(F.col("src").alias("b"), F.col("up").alias("b_up")))
        left = links.join(a, F.col("src") == F.col("a")).join(b, F.col("dst") == F.col("b"))
        rest = materialize(left.where("a_up <> b_up").select(F.col("a_up").alias("src"), F.col("b_up").alias("dst")).distinct(), "edges")
        moved = at.join(a, F.col("component") == F.col("a"), "left").select("node", F.coalesce("a_up", "component").alias("component"))
        at, last = materialize(moved, "components"), at
        discard(last)
        discard(links)
        discard(hook)
        discard(hook2)
        links = rest
    return at
