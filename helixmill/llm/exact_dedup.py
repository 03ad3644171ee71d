"""Exact deduplication against a persistent index of digests, on Spark's own functions alone.

The index is a table bucketed and sorted by digest, with one row for each distinct text ever added: its SHA-256, the row that stays, and the
batch that brought it. A batch is reduced to one row for each digest before anything is shuffled (a text that fills a third of
the rows is one row of each task), anti-joined with the index by sort-merge, and what is new is appended; the index side has no
exchange. A second table in the same buckets keeps how often each batch held each digest.

Awkward rows: null text counts as empty. Of equal texts in one batch the row with the largest key stays, null keys lowest; of repeated
rows with that key, one. A text that the index has keeps its row, whatever the later batch's keys. Repeated rows and null keys are rows of
their own. Other columns pass through, and may have any name. An empty table adds nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill import staging

from . import stage
from .features import unused

#: Digests with more than this part of a bucket's mean share are answered by a broadcast: there are at most HEAVY x buckets of them.
HEAVY = 4


def digest(text: Column | str) -> Column:
    """32 bytes: SHA-256 of the text in UTF-8, null as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


class DigestIndex:
    """An index in a folder that all executors share. Open it with the same folder in a later session to go on.

    Each batch has a name. Adding a batch again, after a failure or by mistake, changes nothing."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        meta = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta/_SUCCESS")
        if meta.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(meta):
            row = spark.read.json(f"{self.path}/meta").first()
            self.buckets, self.key_type = row["buckets"], row["key_type"]
            if buckets is not None and buckets != self.buckets:
                raise ValueError(f"the index has {self.buckets} buckets")
        else:
            self.buckets, self.key_type = buckets or stage.partitions(spark), key_type
            spark.createDataFrame([(self.buckets, key_type)], "buckets int, key_type string").coalesce(1).write.mode("overwrite").json(f"{self.path}/meta")
        own = uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex
        self.keepers, self.sightings = f"digests_{own}", f"sightings_{own}"
        # partitions by batch would make buckets of each, so the batch is a column
        self._table(self.keepers, f"digest BINARY, keep {self.key_type}, keep_row BIGINT, batch STRING", "digests")
        self._table(self.sightings, "digest BINARY, n BIGINT, batch STRING", "sightings")

    def _table(self, name: str, columns: str, folder: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (compression 'zstd') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )

    def known(self) -> DataFrame:
        """(digest, keep, keep_row, batch) of every distinct text."""
        return self.spark.table(self.keepers)

    def sizes(self) -> DataFrame:
        """(digest, group_size): rows of all batches with a text."""
        return self.spark.table(self.sightings).groupBy("digest").agg(F.sum("n").alias("group_size"))

    def has(self, batch: str) -> bool:
        return bool(self.spark.table(self.sightings).filter(F.col("batch") == batch).limit(1).count())

    def add(self, rows: DataFrame, batch: str) -> None:
        """Add rows (key, row, digest); row tells repeated keys apart. New digests are appended first and sightings last, so a batch that
        failed between the two is completed when it is added again."""
        if self.has(batch):
            return
        one = rows.groupBy("digest").agg(F.max(F.struct("key", "row")).alias("top"), F.count(F.lit(1)).alias("n"))
        if self.buckets != stage.partitions(self.spark):  # else the sums lie in the index's buckets as they are
            one = one.repartition(self.buckets, "digest")
        one = stage.written_by(one, "digest", self.buckets)
        new = one.hint("merge").join(self.known().filter(F.col("batch") != batch).select("digest"), "digest", "left_anti")
        done = self.known().filter(F.col("batch") == batch).select("digest")
        new = new.join(done.hint("merge"), "digest", "left_anti")
        new.select("digest", F.col("top.key").alias("keep"), F.col("top.row").alias("keep_row"), F.lit(batch).alias("batch")).write.insertInto(self.keepers)
        one.select("digest", "n", F.lit(batch).alias("batch")).write.insertInto(self.sightings)

    def answers(self, rows: DataFrame) -> DataFrame:
        """(key, keep, group_size, kept, digest) of rows (key, row, digest) that have been added. Digests of very many rows, few by
        their definition, are broadcast; the others meet the index by sort-merge."""
        table = self.known().select("digest", "keep", "keep_row").hint("merge").join(self.sizes(), "digest")
        total = self.spark.table(self.sightings).agg(F.sum("n")).first()[0] or 0
        least = max(2, total // (HEAVY * self.buckets))
        heavy = table.filter(F.col("group_size") > least)
        marked = rows.join(F.broadcast(heavy.withColumn("told", F.lit(True))), "digest", "left")
        told = marked.filter("told")
        rest = marked.filter("told is null").select("key", "row", "digest").hint("merge").join(table.filter(F.col("group_size") <= least), "digest")
        names = ["key", "row", "digest", "keep", "keep_row", "group_size"]
        out = told.select(*names).unionByName(rest.select(*names))
        return out.select("key", "keep", "group_size", (F.col("key").eqNullSafe(F.col("keep")) & (F.col("row") == F.col("keep_row"))).alias("kept"), "digest")


def rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, digest), written once: the texts are read once and row numbers stay as they are."""
    return stage.written(docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), digest(text).alias("digest")))


def _batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """n batches of numeric keys, the largest first, by quantiles of the keys; null keys are in the last. Other keys: one batch."""
    if n < 2 or rows.schema["key"].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return [rows]
    cuts = rows.agg(F.percentile_approx("key", [1 - i / n for i in range(1, n)], 1000)).first()[0] or []
    out, above = [], F.lit(True)
    for cut in dict.fromkeys(cuts):
        inside = F.coalesce(F.col("key") > cut, F.lit(False))
        out.append(rows.filter(above & inside))
        above = ~inside
    return [*out, rows.filter(above)]


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 1, index: DigestIndex | None = None) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row.

    The rows go into an index (a new one, if none is given) in batches, those of larger keys first; so with a new index the row with
    the largest key of each text stays, and every batch after the first is deduplicated against what is there."""
    spark = docs.sparkSession
    if index is None:
        index = DigestIndex(spark, f"{stage.shared_dir(spark)}/index-{uuid.uuid4().hex}", docs.schema[key].dataType.simpleString())
        staging.named(spark).extend([index.keepers, index.sightings])  # drop_all() drops this index
    rows, run = rows_of(docs, key, text), uuid.uuid4().hex
    for i, part in enumerate(_batches(rows, batches)):
        index.add(part, f"{run}-{i}")
    return index.answers(rows).select(F.col("key").alias(key), F.col("keep").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, index: DigestIndex, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose texts the index did not have, one for each text; the index has them afterwards.
    The same batch added again gives the same rows."""
    mark = unused(docs, "digest")
    rows = rows_of(docs, key, text)
    index.add(rows, batch)
    kept = unused(docs, "keep")
    new = index.known().filter(F.col("batch") == batch).select(F.col("digest").alias(f"{mark}_"), F.col("keep").alias(kept))
    # by digest and key, so copies of one text do not meet; repeated rows of the key that stays are equal, and one is kept
    found = docs.withColumn(mark, digest(text)).join(new, (F.col(mark) == F.col(f"{mark}_")) & F.col(f"`{key}`").eqNullSafe(F.col(kept)))
    return found.dropDuplicates([mark]).drop(mark, f"{mark}_", kept)
