"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join on the
same key (a hot key is split by the adaptive skew join).  Every round is written
to the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(both: DataFrame) -> DataFrame:
    """For each node its neighbours in ``both`` (directed from the node) joined with the least of them and itself."""
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["n"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _stars(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges are directed to the smaller node already."""
    stars = _stars(edges)
    own = stars.select("a", F.col("m").alias("b"))
    others = stars.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(others).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge to another."""
    now = staged(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen.n == 0 or (seen.n, seen.s) == mark:
            break
        mark = (seen.n, seen.s)
        now = staged(_small(_large(now)), "edges")
    # every node but a component's least has one edge left, to the least
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
