"""Connected components of an edge table by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.durable import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (columns a, b): the smallest node
    that can be reached. Self-loops, repeated and null edges are allowed; an empty
    table gives an empty result.

    Each round links every node to its smallest neighbour, first from below and
    then from above, until nothing changes; a round is written to the shared folder, so
    lineage stays short. The smallest neighbour is a partial aggregate, so a node
    with very many neighbours costs no task more than another.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = durable(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = durable(large.distinct(), "large")
        low = durable(large.groupBy("a").agg(F.min("b").alias("low")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = durable(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    root = edges.select("b").distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(root.select("b", "b"))
