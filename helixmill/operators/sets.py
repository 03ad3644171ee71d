"""Sets of rows: what two of them share and what either has alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Each distinct key of a or b once, with in_a and in_b: one shuffle, combined before it; null keys are equal."""
    sides = [x.select(*key, F.lit(i == 0).alias("a"), F.lit(i == 1).alias("b")) for i, x in enumerate((a, b))]
    return sides[0].union(sides[1]).groupBy(*key).agg(F.bool_or("a").alias("in_a"), F.bool_or("b").alias("in_b"))


def intersection(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return _marked(a, b, key).filter("in_a and in_b").select(*key)


def difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return _marked(a, b, key).filter("in_a and not in_b").select(*key)


def compared(a: DataFrame, b: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """(by, in_both, only_a, only_b): how many distinct keys of each group the two have; by: some of key."""
    m = _marked(a, b, key)
    return m.groupBy(*by).agg(F.count_if(F.expr("in_a and in_b")).alias("in_both"), F.count_if(F.expr("in_a and not in_b")).alias("only_a"), F.count_if(F.expr("in_b and not in_a")).alias("only_b"))
