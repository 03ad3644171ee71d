"""Tables that are written once in buckets of a key and looked up by it: such a join moves the other side alone.

The buckets are in the folder's files, and what Spark must know of them lies beside them, so any later session can open it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _name(path: str) -> str:
    return f"stored_{uuid.uuid5(uuid.NAMESPACE_URL, path.rstrip('/')).hex}"


def save(df: DataFrame, path: str, key: str, n: int) -> None:
    """df into the folder path, in n buckets sorted by key, one file each. The folder may not have a table yet."""
    spark, path = df.sparkSession, path.rstrip("/")
    rows = df.repartition(n, key)
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")  # the name alone; an external table's files stay
    rows.write.mode("errorifexists").option("path", f"{path}/rows").bucketBy(n, key).sortBy(key).saveAsTable(_name(path))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    spark.createDataFrame([(key, n, ddl)], "key string, n int, ddl string").coalesce(1).write.json(f"{path}/buckets")


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table that save() has written, in this session or another."""
    path = path.rstrip("/")
    meta = spark.read.schema("key string, n int, ddl string").json(f"{path}/buckets").first()
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} ({meta['ddl']}) USING parquet CLUSTERED BY ({meta['key']}) SORTED BY ({meta['key']}) INTO {meta['n']} BUCKETS LOCATION '{path}/rows'")
    return spark.table(_name(path))
