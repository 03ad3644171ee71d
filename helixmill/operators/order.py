"""Orders over all rows, and what is selected by rank, without a task that sees all rows of a group.

Spark's range partitioner looks keys up in drawn splitters. Its result is written once, so the places that are counted on it hold
whenever they are read; a tie-breaker after the key lets equal keys lie in several ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.staging import partitions, written

#: Distinct values of a group that its median may hold in one buffer; larger groups are cut into ranges.
HELD = 1 << 16
#: Ranges whose counts are broadcast.
MOST_RANGES = 1 << 16
_INDEX = (1 << 33) - 1  # of monotonically_increasing_id: the row within its partition


def ranged(rows: DataFrame, by: list[str], ranges: int | None = None, weight: str | None = None) -> DataFrame:
    """rows, written in ranges of the key `by`, each in order, with part (its range), r (the row's number in it, from 0) and, with a
    weight column of type long, before: the sum of the weights before the row in its range."""
    n = min(ranges or partitions(rows.sparkSession), MOST_RANGES)
    cut = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *by, "_tie").sortWithinPartitions(*by, "_tie").drop("_tie")
    cut = cut.withColumns({"part": F.spark_partition_id(), "r": F.monotonically_increasing_id().bitwiseAND(_INDEX)})
    if weight is not None:
        cut = cut.mapInArrow(_running(weight), cut.withColumn("before", F.lit(0).cast("long")).schema)
    return written(cut)


def _running(weight: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            if batch.num_rows:
                ends = pc.add(pc.cumulative_sum(batch.column(weight)), done)
                yield pa.RecordBatch.from_arrays([*batch.columns, pc.subtract(ends, batch.column(weight))], [*batch.schema.names, "before"])
                done = ends[-1].as_py()

    return run


def placed(rows: DataFrame, by: list[str], ranges: int | None = None) -> DataFrame:
    """rows with part and place: the row's number, from 1, in the order of `by`. Equal keys are numbered in some order."""
    cut = ranged(rows, by, ranges)
    sizes = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.join(F.broadcast(sizes.select("part", ahead.alias("ahead"))), "part").withColumn("place", F.col("r") + F.col("ahead") + 1).drop("r", "ahead")


def numbered(rows: DataFrame, by: list[str], position: str, width: int, name: str = "ordinal") -> DataFrame:
    """rows with their number, from 0, by position within each group `by`: counted for each stretch of `width` positions, added up
    over stretches, and numbered within a stretch, so a long group is the work of many tasks. A group has each position once."""
    cut = rows.withColumn("_stretch", F.floor(F.col(position) / width))
    counts = cut.groupBy(*by, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*by, "_stretch", ahead.alias("_ahead"))
    at = F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy(position)) - 1
    return cut.withColumn("_at", at).join(starts, [*by, "_stretch"]).withColumn(name, F.col("_at") + F.col("_ahead")).drop("_stretch", "_at", "_ahead")


def quantiles(rows: DataFrame, by: list[str], value: str, share: float = 0.5, weight: Column | None = None, name: str = "median", held: int = HELD) -> DataFrame:
    """(by, name): the exact quantile of each group's values, interpolated between neighbours as Spark's percentile does; the
    mean of the middle two for an even count. Null values do not count; a group without values has null. weight: how often a
    row counts (a whole number; null or not positive: never).

    Equal values are added up before they meet. Groups of up to `held` distinct values are answered from one buffer each;
    larger ones are cut into ranges of (group, value), whose sums tell the range and the row that hold a rank."""
    n = F.lit(1) if weight is None else F.when(weight > 0, weight).otherwise(0)
    same = written(rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.sum(n).cast("long").alias("_n")))
    buffered = lambda df: df.groupBy(*by).agg(F.percentile("_v", F.lit(share), F.col("_n")).alias(name))
    counts = F.col("_v").isNotNull() & (F.col("_n") > 0)
    big = written(same.filter(counts).groupBy(*by).agg(F.count(F.lit(1)).alias("_values")).filter(F.col("_values") > held).select(*by))
    if big.isEmpty():
        return buffered(same)
    on = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    few = buffered(same.join(big, on(same, big), "left_anti"))
    cut = ranged(same.join(big, on(same, big), "left_semi").filter(counts), [*by, "_v"], weight="_n")

    parts = cut.groupBy("part", *by).agg(F.min("before").alias("_first"), F.sum("_n").alias("_held"))
    group = Window.partitionBy(*by)
    ahead = F.coalesce(F.sum("_held").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_ahead", ahead).withColumn("_at", F.lit(share) * (F.sum("_held").over(group) - 1))
    ranks = parts.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    ranks = ranks.filter((F.col("_ahead") <= F.col("_rank")) & (F.col("_rank") < F.col("_ahead") + F.col("_held")))
    ranks = ranks.select(F.col("part").alias("_part"), *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], "_at", (F.col("_rank") - F.col("_ahead") + F.col("_first")).alias("_goal"))
    same_group = [cut["part"] == ranks["_part"], *[cut[c].eqNullSafe(ranks[f"_by_{i}"]) for i, c in enumerate(by)]]
    found = cut.join(ranks, [*same_group, cut["before"] <= ranks["_goal"], ranks["_goal"] < cut["before"] + cut["_n"]])
    low, high, over = F.min("_v"), F.max("_v"), F.first(F.col("_at") - F.floor("_at"))
    many = found.groupBy(*by).agg(F.when(low == high, low).otherwise(low * (1 - over) + high * over).alias(name))
    return few.unionByName(many)
