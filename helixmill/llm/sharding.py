"""Shards of nearly equal bytes by sampled splitters, in DataFrame operations only.

A sample in which a record is drawn in proportion to its size gives splitters: quantiles of the key, so that every range
between two holds about the same bytes. The key is the text's CRC with more bits of another hash of the text below it, so
equal texts are neighbours in its order. Records are placed in ranges, whose bytes are then counted exactly. A range that
holds more than twice its share is subdivided: a text whose copies alone hold a share gets stretches of its own, in which
its records are dealt by a hash of the id; what lies between such texts is cut by the key, never within one. A running sum
over all stretches, and one within each, gives every record the exact number of bytes and records before it; the shard is
that byte position's share of the total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import written

#: Bytes of text in a range, and the most ranges: their splitters and counts are broadcast (16 bytes each). A range holds
#: ids and sizes, not texts, so that at 100 TB one of 8192 ranges still is a few million rows to sort.
RANGE_BYTES = 8 << 20
MOST_RANGES = 8192
#: Sampled records for each range.
SAMPLES = 32
#: Ranges whose running sums are added up in one task; the sums of such groups are added up in another.
FAN = 256
OVERHEAD = 16
#: Bits of a second hash of the text below the 32 of its CRC, and how many keys there are.
LOW_BITS = 28
KEYS = 1 << (32 + LOW_BITS)


def _unit(*of: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / float(1 << 40)


def splitters(rows: DataFrame, n_ranges: int, total: int) -> DataFrame:
    """(rng, lo, hi): n_ranges or fewer ranges [lo, hi) of `key`, by quantiles of a size-weighted sample of rows
    (key, size, tie). The sample's size depends on n_ranges, not on the rows."""
    chance = F.col("size") * F.lit(SAMPLES * n_ranges / max(total, 1))
    drawn = rows.filter(_unit("tie", F.lit("sample")) < chance)
    cuts = drawn.agg(F.percentile_approx("key", F.array(*[F.lit(i / n_ranges) for i in range(1, n_ranges)]) if n_ranges > 1 else F.array(F.lit(0.5)), 100_000).alias("q"))
    edges = cuts.select(F.array_sort(F.array_distinct(F.coalesce("q", F.array().cast("array<long>")))).alias("q"))
    edges = edges.select(F.concat(F.array(F.lit(-(1 << 62))), "q", F.array(F.lit(1 << 62))).alias("q"))
    return edges.select(F.posexplode(F.slice("q", 1, F.size("q") - 1)).alias("rng", "lo"), "q").select(F.col("rng").cast("long"), "lo", F.get("q", F.col("rng") + 1).alias("hi"))


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (null under this law) for each row.

    size: UTF-8 bytes of the text (null: none) plus 16. Law `bytes`: records are laid end to end in the order of text_crc32,
    another hash of the text and a hash of the id; a shard is one of `shards` equal stretches of the total, so its bytes
    differ from an equal share by less than the two records at its ends. slot counts from 0 in each shard without gaps.
    Equal texts follow each other, so only a group over one of the inner ends of shards lies in more than one. Shards and
    slots depend on the rows alone, not on how they are stored. Null ids and repeated rows are records like others
    (repeated rows are interchangeable); an empty table gives no rows; other columns are ignored."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + OVERHEAD
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long")
    more = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND((1 << LOW_BITS) - 1)
    rows = docs.select(F.col(key).alias("id"), size.alias("size"), (F.shiftleft(crc, LOW_BITS) + more).alias("key"))
    rows = written(rows.withColumn("tie", F.xxhash64("id", "key")))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_ranges = min(MOST_RANGES, max(shards, -(-total // RANGE_BYTES)))
    share = max(1, -(-total // n_ranges))
    ranges = F.broadcast(splitters(rows, n_ranges, total))
    # keys are spread over all their bits: a range meets few of the cells by which it is joined
    width = max(1, KEYS // n_ranges)
    cell = lambda c: F.floor(F.least(F.greatest(c, F.lit(0)), F.lit(KEYS - 1)) / F.lit(width))
    cells = ranges.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    placed = rows.withColumn("cell", cell(F.col("key"))).join(cells, "cell").filter("key >= lo and key < hi").select("id", "size", "key", "tie", "rng")
    split = _subdivided(written(placed), share)

    part = ["rng", "part", "sub"]
    held = split.groupBy(*part).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    held = held.withColumn("grp", F.floor(F.col("rng") / FAN))
    within = Window.partitionBy("grp").orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    tops = held.groupBy("grp").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    over = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    tops = tops.select("grp", F.coalesce(F.sum("bytes").over(over), zero).alias("top_bytes"), F.coalesce(F.sum("rows").over(over), zero).alias("top_rows"))
    before = held.select(*part, "grp", F.coalesce(F.sum("bytes").over(within), zero).alias("b"), F.coalesce(F.sum("rows").over(within), zero).alias("r")).join(tops, "grp")
    before = before.select(*part, (F.col("b") + F.col("top_bytes")).alias("bytes_before"), (F.col("r") + F.col("top_rows")).alias("rows_before"))

    order = Window.partitionBy(*part).orderBy("key", "tie", "id")
    at = split.withColumn("b", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("r", F.row_number().over(order) - 1).join(before, part)
    middle = F.col("bytes_before") + F.coalesce(F.col("b"), zero) + F.floor(F.col("size") / 2)
    placed_at = at.select("id", "size", "key", F.floor(middle * shards / F.lit(max(total, 1))).cast("int").alias("shard"), (F.col("rows_before") + F.col("r")).cast("long").alias("rank"))
    placed_at = written(placed_at)
    firsts = F.broadcast(placed_at.groupBy("shard").agg(F.min("rank").alias("first")))  # at most `shards` rows
    out = placed_at.join(firsts, "shard")
    return out.select(
        F.col("id").alias(key), "size", F.shiftright("key", LOW_BITS).alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _subdivided(placed: DataFrame, share: int) -> DataFrame:
    """placed with part and sub, in whose order keys ascend: 0 and 0 outside overfull ranges. In one, part 2i + 1 is its i-th
    heavy key (its records hold a share) and part 2i what lies before it; sub cuts the first by records, the second by keys.

    There are fewer overfull ranges, and fewer heavy keys, than shares in the total, so both are broadcast."""
    full = placed.groupBy("rng").agg(F.sum("size").alias("held"), F.min("key").alias("low"), F.max("key").alias("high")).filter(F.col("held") > 2 * share)
    full = F.broadcast(written(full))
    heavy = placed.join(full.select("rng"), "rng", "left_semi").groupBy("rng", "key").agg(F.sum("size").alias("own")).filter(F.col("own") > share)
    heavy = written(heavy)
    keys = F.broadcast(heavy.groupBy("rng").agg(F.array_sort(F.collect_list("key")).alias("keys")))
    own = F.broadcast(heavy.select("rng", "key", F.ceil(F.col("own") / share).cast("long").alias("cuts")))
    out = placed.join(full, "rng", "left").join(keys, "rng", "left").join(own, ["rng", "key"], "left")
    below = F.coalesce(F.size(F.filter("keys", lambda k: k < F.col("key"))), F.lit(0))
    below = F.when(F.col("keys").isNull(), F.lit(0)).otherwise(below)
    part = F.when(F.col("held").isNull(), F.lit(0)).otherwise(2 * below + F.col("cuts").isNotNull().cast("int"))
    by_row = F.floor(_unit("tie", F.lit("part")) * F.col("cuts"))
    by_key = F.floor((F.col("key") - F.col("low")).cast("double") / (F.col("high") - F.col("low") + 1).cast("double") * F.ceil(F.col("held") / share))
    sub = F.when(F.col("cuts").isNotNull(), by_row).when(F.col("held").isNotNull(), by_key).otherwise(0)
    return out.select("id", "size", "key", "tie", "rng", part.cast("long").alias("part"), sub.cast("long").alias("sub"))
