"""Tables of the corpus operators; intermediate ones lie where the engine keeps its own."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from helixmill.staging import drop_all, partitions, shared_dir, written, written_by

__all__ = ["drop_all", "joined_in_place", "partitions", "read", "shared_dir", "written", "written_by"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Within it, what runs joins rows where they lie if they are dealt out by a part of the join's keys. Spark moves them by all keys
    otherwise, against skew; so it is for parts of the key that are not skewed."""
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)
