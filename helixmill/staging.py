"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset, a folder of this machine's own, but only if
    the session is local: executors elsewhere would not see it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = getattr(context, "_helixmill_dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
            named = context._helixmill_dir = tempfile.mkdtemp(prefix="helixmill-")
    return f"{named.rstrip('/')}/helixmill-{context.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """df, written once as Parquet and read again: its lineage ends here, and every later reader sees the same rows
    even if executors are lost. The files stay until drop_all()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str, n: int) -> DataFrame:
    """As written(), in n buckets of a key, so that a later join on the key does not move these rows."""
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, key).saveAsTable(name)
    named(spark).append(name)
    return spark.table(name)


def named(spark: SparkSession) -> list[str]:
    """Names of the tables that this application has made."""
    context = spark.sparkContext
    if not hasattr(context, "_helixmill_tables"):
        context._helixmill_tables = []
    return context._helixmill_tables


_named = named


def drop_all(spark: SparkSession) -> None:
    """Delete the intermediate tables that this application has made, and no others, once their results have been written."""
    names = named(spark)
    while names:
        spark.sql(f"DROP TABLE IF EXISTS {names.pop()}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
