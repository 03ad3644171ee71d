"""Structured Streaming over files of reads: each new file is looked up in a stored index.

Lookups and counts of a read need the read alone, so a micro-batch is a batch job over its new files, and the only state
is the running count of each taxon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixmill.functions.dna import Shape
from helixmill.operators import classify, kmers
from helixmill.sources import fastx

READS = "read string, sequence string"


def arriving(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """(read, sequence) of Parquet files that are added to a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """(read, sequence) of FASTA and FASTQ files that are added to a folder, or grow by whole records."""
    fastx.register(spark)
    return spark.readStream.format("fastx").load(fastx.qualified(spark, path)).select(F.col("id").alias("read"), F.upper("sequence").alias("sequence"))


def taxa(reads: DataFrame, index: DataFrame, shape: Shape) -> DataFrame:
    """(read, taxid) for every k-mer found: a join of the stream with the stored index, without state."""
    rows = kmers.kmers(reads, "sequence", shape, ["read"])
    return rows.join(index.select("key", "taxid"), "key").select("read", "taxid")


def running_hits(reads: DataFrame, index: DataFrame, shape: Shape) -> DataFrame:
    """(taxid, hits) of all reads so far; the state has a row for each taxon of the index."""
    return taxa(reads, index, shape).groupBy("taxid").agg(F.count(F.lit(1)).alias("hits"))


def classified(reads: DataFrame, index: DataFrame, lineages: DataFrame, ranks: list[str], shape: Shape, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts the stream that appends (read, taxid, path_hits) to the folder `out`, a subfolder for each micro-batch; a batch
    that is run again after a failure writes its own subfolder anew."""

    def put(batch: DataFrame, number: int) -> None:
        hits = classify.read_taxa(classify.lookup(kmers.kmers(batch, "sequence", shape, ["read"]), index), "read")
        classify.assign(hits, "read", "descent", lineages=lineages, ranks=ranks, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
