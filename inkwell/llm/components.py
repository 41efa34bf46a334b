"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges``: columns u, v (long).  Gives node, component (smallest node that can be reached), a row a node.

    Each step rewires every node to the smallest node it sees; the number of edges never grows, and the rounds grow with
    the logarithm of the size of a component.  Minima are pre-aggregated before each shuffle.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = written(_least(both), "least")
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        low = written(_least(large), "least")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        next_ = written(small.where("u <> v").distinct(), "edges")
        for old in (now, near, large, low):
            drop_written(old)
        now, before, mark = next_, mark, _mark(next_)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _least(edges: DataFrame) -> DataFrame:
    """The smallest node that each node sees.  It is stored before it is joined, so that Spark can split the join where a node
    has very many edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _mark(edges: DataFrame) -> tuple:
    """What tells two edge tables apart: their number and a sum of hashes."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
