"""Readers of the tab-separated files around sequence data. All go through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.functions.text import header_taxid_gene

from . import fastx


def _fields(spark: SparkSession, path: str, *names: tuple[int, str, str]) -> DataFrame:
    parts = F.split("value", r"\t")
    return spark.read.text(path).filter(F.trim("value") != "").select(*[F.get(parts, F.lit(i)).try_cast(kind).alias(n) for i, n, kind in names])


def nodes_dump(spark: SparkSession, path: str) -> DataFrame:
    """(id, parent_id, rank) of a nodes file whose fields are parted by tab, bar, tab."""
    return _fields(spark, path, (0, "id", "int"), (2, "parent_id", "int"), (4, "rank", "string"))


def names_dump(spark: SparkSession, path: str, first_seen: bool = False) -> DataFrame:
    """(id, name): the scientific name, else the first by name order, or with first_seen the first that the file has."""
    # within a block of a file the numbers grow from line to line; blocks are ordered by where they begin
    rows = _fields(spark, path, (0, "id", "int"), (2, "name", "string"), (6, "name_class", "string"))
    place = [F.input_file_name().alias("_file"), F.input_file_block_start().alias("_block"), F.monotonically_increasing_id().alias("_line")]
    rows = rows.select("*", *place)
    order = Window.partitionBy("id").orderBy(F.coalesce(F.col("name_class") != "scientific name", F.lit(True)), *(["_file", "_block", "_line"] if first_seen else ["name"]))
    return rows.withColumn("r", F.row_number().over(order)).filter("r = 1").select("id", "name")


TAXONOMY = "id int, parent_id int, external_id int, name string, rank string, level int, rep_genome string"


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The engine's own taxonomy file: a header line, seven columns."""
    return spark.read.csv(path, sep="\t", header=True, schema=TAXONOMY, enforceSchema=True)


def gene_lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="taxid int, gene_id int, length int")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="taxid int, gene_id int, factor double")


def reference_map(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, gene_id, start, end) of genes in a reference file."""
    return spark.read.csv(path, sep="\t", schema="taxid bigint, gene_id bigint, start bigint, end bigint")


def located_genes(spark: SparkSession, reference: str) -> DataFrame:
    """(taxid, gene_id, start, end, file): where the sequences of a plain reference file with headers `>taxid_gene` lie."""
    fastx.register(spark)
    taxid, gene = header_taxid_gene("header")
    return spark.read.format("fastx_spans").load(fastx.qualified(spark, reference)).select(taxid.cast("long").alias("taxid"), gene.cast("long").alias("gene_id"), "start", "end", "file")


def write_reference_map(spark: SparkSession, reference: str, path: str) -> None:
    """The map of a reference file, as reference_map() reads it."""
    located_genes(spark, reference).select("taxid", "gene_id", "start", "end").write.csv(path, sep="\t")


def mapped_genes(reference: str, wanted: DataFrame) -> DataFrame:
    """(taxid, gene_id, start, end, sequence, bytes_read) of the genes of a map: each is read from its own bytes of the reference,
    and the rest of the file is not."""
    return fastx.fetch(wanted.withColumn("file", F.lit(fastx.qualified(wanted.sparkSession, reference)))).drop("file")


def true_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").try_cast("int").alias("taxid")).filter("taxid is not null")


def shape_history(spark: SparkSession, path: str) -> DataFrame:
    """(shape, identity, sensitivity, hits) of a search's history: a row for each shape and identity, from columns <identity>_sens
    and <identity>_hits (the share of k-mers that hit)."""
    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    known = [c[: -len("_sens")] for c in rows.columns if c.endswith("_sens") and f"{c[: -len('_sens')]}_hits" in rows.columns]
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    each = F.array(*[F.struct(F.lit(i).alias("identity"), number(f"{i}_sens").alias("sensitivity"), number(f"{i}_hits").alias("hits")) for i in known])
    return rows.select("shape", F.explode(each).alias("e")).select("shape", "e.*")


def snp_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="read_id bigint, read_num tinyint, taxid int, gene_id int, position int, quality smallint, base string")


def pattern_text(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, mutations) of lines `pattern positions...`."""
    parts = F.split(F.trim("value"), r"\s+")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("int"))
    return spark.read.text(path).filter(F.trim("value") != "").select(F.get(parts, F.lit(0)).cast("long").alias("pattern"), rest.alias("mutations"))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of lines `key=value`."""
    at = F.split("value", "=", 2)
    return spark.read.text(path).filter("value like '%=%'").select(F.trim(F.get(at, F.lit(0))).alias("key"), F.trim(F.get(at, F.lit(1))).alias("val"))


def with_file(df: DataFrame, suffix: str) -> DataFrame:
    """df with `sample`: the name of the file that a row came from, without a suffix."""
    name: Column = F.regexp_replace(F.input_file_name(), r"^.*/", "")
    return df.withColumn("sample", F.regexp_replace(name, f"{suffix}$", ""))
