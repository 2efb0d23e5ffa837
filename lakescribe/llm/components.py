"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salts_for, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(links: DataFrame, salts: int) -> DataFrame:
    """Links (a, b) with _m, the least b of each a.

    A node with very many links is dealt to ``salts`` parts by its neighbours: the least goes up from the parts and back down to them, so no task
    gets all links of one node.
    """
    links = links.withColumn("_salt", F.pmod(F.xxhash64("b", F.lit(3)), F.lit(salts)).cast("int"))
    parts = links.groupBy("a", "_salt").agg(F.min("b").alias("_part"))
    least = parts.groupBy("a").agg(F.min("_part").alias("_m"))
    return links.join(parts.select("a", "_salt").join(least, "a"), ["a", "_salt"]).drop("_salt")


def _large_star(edges: DataFrame, salts: int) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and its neighbours."""
    ways = _with_least(_both_ways(edges), salts).filter("b > a")
    return ways.select(F.col("b").alias("a"), F.least("_m", "a").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, salts: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    down = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), salts)
    pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("_m").alias("b")), F.struct("a", F.col("_m").alias("b")))).alias("p")
    return down.select(pairs).select("p.a", "p.b").filter("a <> b").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node is either linked to one smaller node or only to larger ones: then the smaller ends are the components."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))).alias("e")
    nodes = edges.select(ends).groupBy("e.node").agg(F.sum("e.down").alias("_down"), F.min("e.down").alias("_least"))
    return not nodes.filter("_down > 1 OR (_down = 1 AND _least = 0)").head(1)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is the least node that is reachable.

    Links to null and from a node to itself say nothing. Each round's links are written, so lineage stays short and lost executors lose
    nothing; only whether the links are stars, and their number, come to the driver.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    for _ in range(most_rounds):
        if _is_stars(edges):
            break
        salts = salts_for(edges.count(), least=16)
        edges = written(_small_star(_large_star(edges, salts), salts), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select("b", "b").distinct().toDF("node", "component")).distinct()
