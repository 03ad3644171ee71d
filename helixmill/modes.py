"""The three runs from files to files: build an index, classify reads against it, profile what was classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import text
from helixmill.functions.dna import Shape
from helixmill.operators import classify as cl
from helixmill.operators import index, kmers, placement, profile, shapes, taxonomy, variants
from helixmill.sources import fastx, results, samples, store
from helixmill.staging import partitions, written

PATTERN_BITS = 16


def _leaf(nodes: DataFrame) -> DataFrame:
    return nodes.select("id").join(nodes.filter("parent_id <> id").select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti")


def build(spark: SparkSession, reference: str, nodes: DataFrame, shape: Shape, db: str, ranks: list[str] = taxonomy.RANKS, most_pos: int | None = None, bits: int = PATTERN_BITS, buckets: int | None = None) -> None:
    """Into the folder db: the index of all k-mers of a reference (FASTA, headers >taxid_gene), the taxonomy with its closure
    and lineages, gene lengths and the pattern table of the shape. nodes: (id, parent_id, rank); leaves have the genes."""
    fastx.register(spark)
    taxid, gene = text.header_taxid_gene("header")
    genes = spark.read.format("fastx").load(fastx.qualified(spark, reference)).select(taxid.alias("taxid"), gene.alias("gene_id"), F.upper("sequence").alias("sequence"))
    closed = taxonomy.closure(nodes)
    closed.write.parquet(f"{db}/closure")
    closed = spark.read.parquet(f"{db}/closure")
    nodes.write.parquet(f"{db}/nodes")
    lineages = taxonomy.lineages(closed, nodes, ranks)
    lineages.write.parquet(f"{db}/lineages")
    own = spark.read.parquet(f"{db}/lineages").withColumnRenamed("id", "taxid")
    genes.select("taxid", "gene_id", F.length("sequence").alias("length")).write.parquet(f"{db}/genes")
    rows = kmers.kmers(genes, "sequence", shape, ["taxid", "gene_id"]).join(own, "taxid")
    store.save(index.build(rows, ranks, most_pos=most_pos), f"{db}/index", "key", buckets or partitions(spark))
    shapes.save(variants.train(spark, shape, bits), [], f"{db}/shape")
    spark.createDataFrame([(shape.text, bits)], "shape string, bits int").write.json(f"{db}/meta")


def classify_samples(spark: SparkSession, db: str, paths: list[str], out: str, again: bool = False, **options) -> list[str]:
    """classify() for each sample of a list of files, into a folder of its name: pairs of files by name, single files, and files with
    mates in turn. Samples that are finished are left as they are unless `again`. The names of those that were classified."""
    done = []
    for s in samples.discover(paths):
        if again or not _finished(spark, f"{out}/{s.name}"):
            classify(spark, db, s.first, f"{out}/{s.name}", s.second, mode="overwrite", name=s.name, **options)
            done.append(s.name)
    return done


def _finished(spark: SparkSession, folder: str) -> bool:
    """Whether both tables of a run have been committed."""
    at = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{t}/_SUCCESS") for t in ("classification", "snps")]
    return all(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) for p in at)


def classify(spark: SparkSession, db: str, first: str, out: str, second: str | None = None, share: float = 0.7, least: int = 3, ranks: list[str] = taxonomy.RANKS, mode: str = "errorifexists", name: str = "reads") -> None:
    """Into the folder out: `classification` (a row for each mate of a classified pair) and `snps` (mutations of placed mates).

    Mates are records of one number in two files, or in turn in one, whatever their ids; record_id is the pair's number. Pairs go down the taxonomy by the hits of both mates. A mate is placed if the pair's taxon is a leaf and at least two of
    its hits on one gene of it agree; its mutations are told there."""
    fastx.register(spark)
    meta = spark.read.json(f"{db}/meta").first()
    shape, bits = Shape(meta["shape"]), meta["bits"]
    ix = store.load(spark, f"{db}/index")
    closed, lineages, genes, nodes = (spark.read.parquet(f"{db}/{t}") for t in ("closure", "lineages", "genes", "nodes"))
    sample = samples.detected(spark, samples.Sample(name, first, second))
    reads = samples.mates(spark, sample).select("pair", "read_num", F.upper("sequence").alias("sequence"), "quality")
    mate = ["pair", "read_num"]
    hits = written(cl.lookup_places(kmers.occurrences(reads, "sequence", shape, mate), ix))
    counts = hits.filter("taxid is not null").groupBy("pair", "taxid").agg(
        F.count(F.lit(1)).alias("hits"), *[F.count_if(F.col("read_num") == m).alias(f"hits_{m}") for m in (1, 2)]
    )
    answers = cl.descend(counts, lineages, ranks, "pair", share, least, mates=["hits_1", "hits_2"])
    leaf = _leaf(nodes).select(F.col("id").alias("taxid"))
    found = hits.filter((F.col("gene_id") > 0)).join(leaf, "taxid", "left_semi")
    votes = cl.best_offsets(found, mate).filter("votes >= 2").join(answers.join(leaf, "taxid", "left_semi").select("pair", "taxid"), ["pair", "taxid"], "left_semi")
    placed = placement.best_placement(votes, mate).join(reads.select(*mate, F.length("sequence").alias("read_length")), mate)
    placed = placed.join(genes.withColumnRenamed("length", "gene_length"), ["taxid", "gene_id"])
    rows = placement.marked(hits, placed, closed, shape, mate)
    best = placement.result_rows(rows, shape, mate).drop("taxid", "read_length")
    lengths = reads.select(*mate, F.length("sequence").alias("read_length"))
    mates = answers.select("pair", "taxid", F.explode(F.array(*[F.struct(F.lit(m).alias("read_num"), F.col(f"path_hits_{m}").alias("path")) for m in (1, 2)])).alias("m"))
    mates = mates.select("pair", "taxid", "m.*").filter(F.col("path") > least).join(lengths, mate).join(best, mate, "left")
    rest = F.greatest(F.lit(0), F.col("read_length") - len(shape) + 1)
    lines = mates.select(
        F.col("pair").alias("record_id"), "read_num", "taxid", "gene_id", "gene_pos", F.coalesce("hits_best", "path").alias("hits_best"), F.coalesce("total_hits", rest).alias("total_hits"),
        "read_length", "overlap", "forward",
    )
    results.as_classification(lines).write.mode(mode).parquet(f"{out}/classification")
    told = placement.call(rows, spark.read.parquet(f"{db}/shape/patterns"), shape, bits, mate)
    snps = placement.snp_rows(told, reads, mate).select(F.col("pair").alias("read_id"), "read_num", "taxid", "gene_id", F.col("gene_position").alias("position"), "quality", "base")
    results.as_snps(snps).write.mode(mode).parquet(f"{out}/snps")


def profiled(spark: SparkSession, db: str, run: str, reads: int = 100, identity: float = 0.9, expected: float = 0.4, where: Column | None = None) -> DataFrame:
    """(id, rank, abundance) of the taxa that a classification shows to be there."""
    meta = spark.read.json(f"{db}/meta").first()
    shape = Shape(meta["shape"])
    genes, closed, nodes = (spark.read.parquet(f"{db}/{t}") for t in ("genes", "closure", "nodes"))
    rows = results.classification(spark, f"{run}/classification").filter(F.col("gene_id").isNotNull() & (F.col("overlap") >= len(shape)))
    rows = rows.filter(profile.read_passes(F.col("hits_best"), F.col("overlap"), len(shape), shape.k))
    rows = rows.withColumn("ani", profile.ani(F.col("hits_best"), F.col("overlap"), len(shape), shape.k)).withColumn("pos", F.greatest("gene_pos", F.lit(0)))
    passed = profile.taxon_table(rows, genes).filter(profile.taxon_passes(reads, identity, expected, where)).select("taxid")
    depths = profile.taxon_depth(profile.gene_depth(rows.join(passed, "taxid", "left_semi"), genes.join(passed, "taxid", "left_semi")))
    return profile.rank_abundance(depths, closed, nodes)
