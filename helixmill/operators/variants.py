"""Mutations from the pattern of k-mer hits and misses along a read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.functions.dna import Shape
from helixmill.staging import partitions

MOST_BITS = 22


def sliding_pattern(rows: DataFrame, by: list[str], order: str, hit: Column, bits: int) -> DataFrame:
    """rows with `pattern`: the last `bits` hits as a number, the current one in the lowest bit; `turned`: the same hits with
    the oldest one in the lowest bit; n_seen: how many there are."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - bits, 0)
    flags = rows.withColumn("_hit", F.when(F.coalesce(hit, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    listed = flags.withColumn("_last", F.collect_list("_hit").over(w))
    number = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc * 2 + x)
    return listed.withColumn("pattern", number(F.col("_last"))).withColumn("turned", number(F.reverse("_last"))).withColumn("n_seen", F.size("_last")).drop("_hit", "_last")


def hit_miss(mutated: Column, shape: Shape, bits: int) -> Column:
    """The pattern that mutations at the set bits of `mutated` cause: k-mer i (bit i) hits if no taken position is mutated."""
    mask = sum(1 << o for o in shape.take)
    return sum((F.when(mutated.bitwiseAND(mask << i) == 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(bits)), F.lit(0).cast("long"))


def train(spark: SparkSession, shape: Shape, bits: int, limit: int | None = None, lower: int = 0) -> DataFrame:
    """(pattern, mutations array<int>): positions that are mutated in every set of mutations that causes a pattern; patterns
    that no set causes are left out, and so is the pattern of no miss.

    Position j is a candidate if no hit covers it. It is certain if some missing k-mer has it as its only candidate. A
    pattern can be caused if every miss has a candidate. Bit i of a pattern is the k-mer that begins at i.

    limit, lower: patterns with more candidates than limit, or no more than lower, are left out too."""
    return trained(spark, shape, bits, limit, lower).drop("candidates")


def trained(spark: SparkSession, shape: Shape, bits: int, limit: int | None = None, lower: int = 0) -> DataFrame:
    """train() with candidates int: how many positions a pattern leaves open."""
    if bits > MOST_BITS:
        raise ValueError(f"at most {MOST_BITS} k-mers")
    span = bits + len(shape) - 1
    masks = [sum(1 << (i + o) for o in shape.take) for i in range(bits)]
    most = span if limit is None else limit

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("id").to_numpy()
            covered, certain, possible = np.zeros_like(p), np.zeros_like(p), np.ones(len(p), bool)
            for i, m in enumerate(masks):
                covered |= np.where(p >> i & 1, m, 0)
            for i, m in enumerate(masks):
                own, miss = m & ~covered, (p >> i & 1) == 0
                possible &= ~miss | (own != 0)
                certain |= np.where(miss & (np.bitwise_count(own) == 1), own, 0)
            free = span - np.bitwise_count(covered).astype(np.int32)
            possible &= (free <= most) & (free > lower)
            told = [[j for j in range(span) if c >> j & 1] for c in certain[possible].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(p[possible]), pa.array(told, pa.list_(pa.int32())), pa.array(free[possible], pa.int32())], ["pattern", "mutations", "candidates"])

    # in Arrow batches: as expressions the optimizer would infer the same conditions for whatever is joined to a pattern
    return spark.range(0, (1 << bits) - 1).mapInArrow(invert, "pattern long, mutations array<int>, candidates int")


def train_to(spark: SparkSession, path: str, shape: Shape, bits: int, limit: int) -> DataFrame:
    """The table of trained() up to `limit` candidates in the folder path, in a folder for each level of what it was trained to. What
    is there is not trained again: patterns with more candidates than the last level are added to it."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    levels = [i for i in range(1, bits + len(shape)) if fs.exists(fs_path(f"{path}/limit={i}/_SUCCESS"))]
    if (last := max(levels, default=0)) < limit:
        trained(spark, shape, bits, limit, last).write.mode("overwrite").parquet(f"{path}/limit={limit}")
        levels.append(limit)
    rows = spark.read.schema("pattern long, mutations array<int>, candidates int").parquet(*[f"{path}/limit={i}" for i in levels])
    return rows.filter(F.col("candidates") <= limit)


def call(rows: DataFrame, table: DataFrame, read: str, shape: Shape, bits: int) -> DataFrame:
    """(read, position): mutated read positions told by the pattern of hits; rows: (read, pos, hit) for every k-mer.

    Windows of `bits` successive k-mers are looked up in the pattern table, and positions are counted once."""
    seen = sliding_pattern(rows, [read], "pos", F.col("hit"), bits).filter(F.col("n_seen") == bits)
    # the table's bit 0 is the first k-mer of a window
    asked = seen.select(read, (F.col("pos") - bits + 1).alias("from"), F.col("turned").alias("pattern")).filter(F.col("pattern") != (1 << bits) - 1)
    found = asked.join(table.filter(F.size("mutations") > 0), "pattern").select(read, "from", F.explode("mutations").alias("m"))
    return found.select(read, (F.col("from") + F.col("m")).alias("position")).distinct()


def call_hits(hits: DataFrame, sizes: DataFrame, table: DataFrame, read: str, shape: Shape, bits: int) -> DataFrame:
    """call() from the hits alone, (read, pos), for reads of which every position has a k-mer; sizes: (read, n_kmers).

    A window of misses alone tells nothing, so each window belongs to the first hit in it, whose next hits give the pattern; misses are
    never rows. Hits are few bytes, so they are spread over all partitions, which AQE would join to few. Of an id that several reads
    share, only windows beyond all reads but the longest one are told: positions before it have several k-mers."""
    rank = F.row_number().over(Window.partitionBy(read).orderBy(F.desc("n_kmers")))
    two = sizes.filter("n_kmers > 0").withColumn("_rank", rank).filter("_rank <= 2").groupBy(read).agg(F.max("n_kmers").alias("_end"), F.coalesce(F.max(F.when(F.col("_rank") == 2, F.col("n_kmers"))), F.lit(0)).alias("_from"))
    w = Window.partitionBy(read).orderBy("pos")
    rows = hits.join(two, read).filter("pos >= _from").repartition(partitions(hits.sparkSession), read)
    ahead = [F.lead("pos", i).over(w) - F.col("pos") for i in range(1, bits)]
    bit = [F.when(d < bits, F.call_function("shiftleft", F.lit(1).cast("long"), d.cast("int"))).otherwise(F.lit(0).cast("long")) for d in ahead]
    rows = rows.withColumns({"_mask": sum(bit, F.lit(1).cast("long")), "_low": F.greatest(F.col("pos") - (bits - 1), F.col("_from"), F.lag("pos").over(w) + 1), "_high": F.least("pos", F.col("_end") - bits)})
    windows = rows.filter("_low <= _high").select(read, "pos", "_mask", F.explode(F.sequence("_low", "_high")).alias("from"))
    shifted = F.call_function("shiftleft", F.col("_mask"), (F.col("pos") - F.col("from")).cast("int"))
    windows = windows.select(read, "from", shifted.bitwiseAND((1 << bits) - 1).alias("pattern"))
    found = windows.join(F.broadcast(table.filter(F.size("mutations") > 0)), "pattern").select(read, "from", F.explode("mutations").alias("m"))
    return found.select(read, (F.col("from") + F.col("m")).cast("int").alias("position")).distinct()
