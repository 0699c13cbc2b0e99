"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_and_read


def _lowest(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with ``m``, the smallest of u and its partners. The minimum is combined on
    the map side and written, so that the join has a shuffle of its own on either side and can
    split a node with very many partners."""
    least = write_and_read(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    known = _lowest(down)
    links = known.select(
        F.inline(
            F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )
        )
    )
    return links.where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges(u, v)`` with the smallest node it is connected to.

    The rounds grow with the logarithm of the longest path; each is written to the session's
    shared folder, so a lost executor costs one round at most. Only a count and a checksum
    reach the driver. Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = write_and_read(edges.where("u <> v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        edges = write_and_read(_small_star(_large_star(edges)).distinct(), "edges")
