"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.durable import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of all nodes of ``edges`` (``a``, ``b``, both long).

    Large-star and small-star steps (Kiveris et al., 2014) turn each component
    into a star around its least node in a number of rounds that grows with
    the logarithm of its size, until all are. A step is a minimum for each node, combined
    before it is shuffled, and a join whose large partitions Spark can split,
    so hubs are no single task's work. Each round is written down; the driver
    sees only counts and checksums. Loops, repeated edges and null ends are
    ignored; no edges give no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a != b").distinct()
    now = durable(now, "components")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        after = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b"))).distinct()
        now = durable(after, "components")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one lesser neighbour that has none itself; edges go from greater to lesser nodes."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up > 0 and down > 0)").agg(F.count("*")).first()[0] == 0
