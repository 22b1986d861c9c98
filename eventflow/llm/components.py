"""Connected components by alternating large and small stars; each step is a minimum by node and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, stored


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each greater neighbour of a node to the least of its neighbours and itself."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.join(_minimum(both), "u").filter("v > u")
    return out.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; edges lead from greater to smaller."""
    out = edges.join(_minimum(edges), "u")
    return out.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(out.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node leads to one other that leads nowhere."""
    if not is_empty(edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")):
        return False
    return is_empty(edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in the links (a, b): the least node that can be reached.  Loops link nothing."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _are_stars(edges):
        # a star has as many edges as it replaces, or fewer, and one for each node it is made around
        edges = stored(_small_star(_large_star(edges)), "links", 2 * edges.count())
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionAll(ends.select("component", "component").distinct())
