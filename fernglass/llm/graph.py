"""Connected components of an edge table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the edges; root is the smallest node of its component.

    Each round points every node to the smallest of itself and its neighbours, follows the pointers twice, and
    joins what points to the same node; edges inside a joint node go. Pointers never rise, so the last node of a
    component is its smallest. The number of edges falls by a large part each round. Nodes are never gathered: a
    minimum is aggregated before the shuffle, and a node with many edges is the skewed side of an inner or left
    join, which Spark splits. Null ends are dropped; repeated edges and loops do no harm.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    pairs, free_pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    live, held = pairs.where("a < b"), [free_pairs]
    while not live.isEmpty():
        low = live.select(F.col("b").alias("n"), F.col("a").alias("m")).groupBy("n").agg(F.min("m").alias("p"))
        hop = low.select(F.col("n").alias("n2"), F.col("p").alias("p2"))
        low, free_low = written(low.join(hop, F.col("p") == F.col("n2"), "left").select("n", F.coalesce("p2", "p").alias("p")))
        to_a, to_b, to_l = (low.select(F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}")) for x in "abl")
        moved = live.join(to_a, F.col("a") == F.col("na"), "left").join(to_b, F.col("b") == F.col("nb"), "left")
        moved = moved.select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
        live, free_live = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        labels, free_labels = written(labels.join(to_l, F.col("root") == F.col("nl"), "left").select("node", F.coalesce("pl", "root").alias("root")))
        # the tables of the round before aren't read any more
        for free in [*held, free_low]:
            free()
        held = [free_live, free_labels]
    return labels
