"""Readers of result tables, with their schemas and what must hold in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSIFICATION = "record_id bigint, read_num tinyint, taxid int, gene_id int, gene_pos int, hits_best int, total_hits int, read_length int, overlap int, forward boolean"
SNPS = "read_id bigint, read_num tinyint, taxid int, gene_id int, position int, quality smallint, base string"
#: Fixed value: the highest gene number of a genome.
MOST_GENES = 120


def _held(df: DataFrame, column: str, holds: Column, message: str) -> DataFrame:
    """df, which fails when a row is read in which the condition does not hold."""
    return df.withColumn(column, F.when(holds, F.col(column)).otherwise(F.raise_error(message)))


def classification(spark: SparkSession, path: str, most_genes: int = MOST_GENES) -> DataFrame:
    """The classification table; a gene number above most_genes is an error (null: unset)."""
    rows = spark.read.schema(CLASSIFICATION).parquet(path)
    return _held(rows, "gene_id", F.col("gene_id").isNull() | (F.col("gene_id") <= most_genes), f"gene number above {most_genes}")


def snps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNPS).parquet(path)


def as_classification(df: DataFrame) -> DataFrame:
    """df with the columns and types of the classification table; missing ones are null."""
    return _cast(df, CLASSIFICATION)


def as_snps(df: DataFrame) -> DataFrame:
    return _cast(df, SNPS)


def _cast(df: DataFrame, schema: str) -> DataFrame:
    named = [field.split() for field in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(kind).alias(n) for n, kind in named])
