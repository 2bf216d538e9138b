"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import written


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the
    links ``a, b`` (bigint).

    Alternates the large-star and small-star steps until the links are stars:
    each hangs a node's neighbours on the smallest of them, so the number of
    rounds grows with the logarithm of the longest chain and the number of
    links never grows.  A hub's links are aggregated before they are shuffled; what
    they are joined with is written first, so that the join is one of two plain
    shuffles, which Spark splits where they are skewed.  Each round goes to the
    shared folder; self-links and repeated links do no harm."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    edges, last = edges.where("a <> b"), None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")), "least")
        # large star: the greater neighbours of a node go to its smallest one
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: its smaller neighbours, and itself, do the same
        large = written(large, "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"), "least")
        small = large.join(low, F.col("a") == F.col("k")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.distinct(), "stars")
        now = _signature(edges)
        if now == last:
            break
        last = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(roots).unionAll(loops).groupBy("node").agg(F.min("component").alias("component"))
