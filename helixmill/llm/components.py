"""Connected components of an edge table by alternating star contraction, each round a join and a group-by.

Every vertex is pointed at the smallest vertex it knows of: first by its larger neighbours, then by its smaller ones.
The neighbours of a vertex are never gathered, so a hub costs rows, not a large group. Rounds: the logarithm of the
longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root): each vertex that is not the smallest of its component, and that smallest one. Null ends and loops
    link nothing; repeated edges count once; an empty table gives an empty table."""
    e = edges.filter(f"{a} is not null and {b} is not null and {a} <> {b}")
    e = written(e.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct())
    mark = None
    while True:
        # large star: v's larger neighbours point at the smallest neighbour of v
        both = e.select("v", "u").union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: v and its smaller neighbours point at the smallest of them
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        e = large.join(small, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u")))
        e = written(e.filter("v <> u").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "vertex")
        mark = now
