"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.support import discard, written


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); the component is its least node.

    Each round links a node's larger neighbours, then its smaller ones, to the
    least node around it.  Edges never outnumber those given, no neighbourhood is
    ever gathered (only least neighbours are, by aggregation), and rounds grow
    with the logarithm of the nodes."""
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-0")
    at = 0
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the least neighbours stand as a table: a hub's edges are then one skewed key of a plain join, which is dealt anew
        around = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m")), f"components-around-{at}")
        # stars around their least nodes: who has a smaller neighbour has no other
        if around.where("m < a AND n > 1").isEmpty():
            discard(around)
            break
        # of the larger ends that the next step groups by, none is a hub
        large = both.where("b > a").join(around.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = large.join(least, "a").select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        at += 1
        small = written(small, f"components-{at}")
        discard(links, around)
        links = small
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
