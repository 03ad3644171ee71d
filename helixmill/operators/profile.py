"""Abundance of taxa from classified reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order

#: Bases that a bucket of a gene is meant to have.
TARGET = 100


def ani(hits: Column, length: Column, span: int, k: int) -> Column:
    """Identity that explains the share of k-mers found: (hits / k-mers) ** (1 / k); null if the read has no k-mer."""
    n = length - span + 1
    return F.when(n > 0, F.pow(hits / n, F.lit(1.0 / k)))


def read_passes(hits: Column, overlap: Column, span: int, k: int, identity: float = 0.9, slack: float = 0.36) -> Column:
    return hits > (overlap - span + 1) * (identity**k * (1 - slack))


def clip(pos: Column, length: Column, gene_length: Column) -> Column:
    """Bases of a read that lie in its gene when it starts at pos."""
    return F.greatest(F.lit(0), F.least(pos + length, gene_length) - F.greatest(pos, F.lit(0)))


def taxon_table(reads: DataFrame, genes: DataFrame) -> DataFrame:
    """(taxid, reads, bases, present_genes, median_ani, n_genes, expected_genes) from reads of (taxid, gene_id, overlap, ani) and
    genes (taxid, gene_id, length). expected_genes: how many of the genes so many reads would touch, n(1 - ((n-1)/n)^r)."""
    each = reads.groupBy("taxid", "gene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap").alias("overlap"))
    t = each.groupBy("taxid").agg(F.sum("n").alias("reads"), F.sum("overlap").alias("bases"), F.count("gene_id").alias("present_genes"))
    t = t.join(order.quantiles(reads, ["taxid"], "ani", name="median_ani"), "taxid")
    n = genes.groupBy("taxid").agg(F.count(F.lit(1)).alias("n_genes"))
    rate = F.col("n_genes") * (1 - F.pow((F.col("n_genes") - 1) / F.col("n_genes"), F.col("reads")))
    return t.join(n, "taxid").withColumn("expected_genes", rate)


def taxon_passes(reads: int, identity: float, expected: float, leaf: Column | None = None) -> Column:
    """leaf: whether the taxon is one; a taxon without genes is not in the table."""
    return (F.lit(True) if leaf is None else leaf) & (F.col("n_genes") > 0) & (F.col("present_genes") / F.col("expected_genes") > expected) & (F.col("reads") > reads) & (F.col("median_ani") > identity)


def bucket_count(length: Column) -> Column:
    """How many buckets of about TARGET bases a gene is cut into: of the two nearest counts the one whose bucket length is
    nearer to TARGET, the smaller of equals, at least one."""
    few = F.floor(length / TARGET)
    more = few + 1
    nearer = F.lit(TARGET) - F.floor(length / more) < F.floor(length / F.greatest(few, F.lit(1))) - TARGET
    return F.when((few == 0) | nearer, more).otherwise(few)


def bucket_length(length: Column) -> Column:
    return F.floor(length / bucket_count(length))


def sized_buckets(reads: DataFrame, genes: DataFrame) -> DataFrame:
    """(taxid, gene_id, bucket, reads): reads by the bucket of their gene in which they start (before it: the first)."""
    at = F.floor(F.greatest(F.col("pos"), F.lit(0)) / bucket_length(F.col("length")))
    return reads.join(genes.select("taxid", "gene_id", "length"), ["taxid", "gene_id"]).groupBy("taxid", "gene_id", at.alias("bucket")).agg(F.count(F.lit(1)).alias("reads"))


def gene_buckets(reads: DataFrame, width: int = 100) -> DataFrame:
    """Reads that start in each stretch of `width` bases of a gene."""
    return reads.groupBy("taxid", "gene_id", F.floor(F.col("pos") / width).alias("bucket")).agg(F.count(F.lit(1)).alias("reads"), F.sum("overlap").alias("bases"))


def gene_depth(reads: DataFrame, genes: DataFrame, width: int = 100) -> DataFrame:
    """(taxid, gene_id, reads, bases, active, expected_active, depth) for each gene: depth is bases over the length of the
    buckets that so many reads are expected to touch. Genes without reads have depth 0."""
    b = gene_buckets(reads, width).groupBy("taxid", "gene_id").agg(F.sum("reads").alias("reads"), F.sum("bases").alias("bases"), F.count(F.lit(1)).alias("active"))
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / width))
    g = genes.join(b, ["taxid", "gene_id"], "left").na.fill(0, ["reads", "bases", "active"]).withColumn("n", n)
    expected = F.col("n") * (1 - F.pow((F.col("n") - 1) / F.col("n"), F.col("reads")))
    g = g.withColumn("expected_active", expected)
    depth = F.when(F.col("reads") > 0, F.col("bases") / (F.col("expected_active") * (F.col("length") / F.col("n")))).otherwise(0.0)
    return g.select("taxid", "gene_id", "reads", "bases", "active", "expected_active", depth.alias("depth"))


def taxon_depth(depths: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """(taxid, depth): median over genes, each divided by its correction factor if there is one."""
    if corrections is not None:
        depths = depths.join(corrections, ["taxid", "gene_id"], "left").withColumn("depth", F.col("depth") / F.coalesce("factor", F.lit(1.0)))
    return order.quantiles(depths, ["taxid"], "depth", name="depth")


def rank_abundance(depths: DataFrame, closed: DataFrame, nodes: DataFrame, root: int = 1) -> DataFrame:
    """(id, rank, abundance): each taxon's depth counts for itself and its ancestors but the root; shares are of a rank."""
    up = closed.select(F.col("id").alias("taxid"), F.col("ancestor_id").alias("id"))
    each = depths.join(up, "taxid").filter(F.col("id") != root).groupBy("id").agg(F.sum("depth").alias("depth"))
    each = each.join(nodes.select("id", "rank"), "id")
    total = each.groupBy("rank").agg(F.sum("depth").alias("total"))  # a handful of rows; a window would put a rank in one task
    return each.join(total, "rank").select("id", "rank", (F.col("depth") / F.col("total")).alias("abundance"))


def naive_depth(reads: DataFrame, genes: DataFrame) -> DataFrame:
    """(taxid, depth): bases over the length of all genes that are present in the genome."""
    size = genes.filter("length > 0").groupBy("taxid").agg(F.sum("length").alias("length"))
    return reads.groupBy("taxid").agg(F.sum("overlap").alias("bases")).join(size, "taxid").select("taxid", (F.col("bases") / F.col("length")).alias("depth"))


def biobox(abundance: DataFrame, names: DataFrame, ranks: list[str]) -> DataFrame:
    """Rows of a profile file, (taxid, rank, name, percentage), top rank first and larger shares first."""
    place = F.coalesce(*[F.when(F.col("rank") == r, F.lit(i)) for i, r in enumerate(ranks)], F.lit(len(ranks)))
    out = abundance.join(names.select("id", "name"), "id", "left").select(F.col("id").alias("taxid"), "rank", "name", F.round(100 * F.col("abundance"), 6).alias("percentage"), place.alias("_place"))
    return out.orderBy("_place", F.desc("percentage"), "taxid").drop("_place")


def profile_rows(abundance: DataFrame, nodes: DataFrame, lineage: DataFrame, ranks: list[str]) -> DataFrame:
    """(taxid, rank, taxpath, namepath, percentage, place): rows of a profile file in order of place, then larger shares.

    Leaves come first, as rank strain and with .1 after their id; then all taxa of each rank, the lowest first, and the
    root. nodes: (id, name, rank, leaf); lineage: (id, taxpath, namepath), of which closing separators are cut."""
    each = abundance.select("id", "abundance").join(nodes.select("id", "rank", "leaf"), "id").join(lineage.select("id", "taxpath", "namepath"), "id")
    order = {r: i + 1 for i, r in enumerate([*reversed(ranks), "root"])}
    place = F.coalesce(*[F.when(F.col("rank") == r, F.lit(i)) for r, i in order.items()])
    plain = each.filter(F.col("rank").isin(list(order))).select(F.col("id").cast("string").alias("taxid"), "rank", "taxpath", "namepath", "abundance", place.alias("place"))
    strain = each.filter("leaf").select(F.concat(F.col("id").cast("string"), F.lit(".1")).alias("taxid"), F.lit("strain").alias("rank"), "taxpath", "namepath", "abundance", F.lit(0).alias("place"))
    cut = lambda c: F.regexp_replace(c, r"\|+$", "").alias(c)
    return strain.union(plain).select("taxid", "rank", cut("taxpath"), cut("namepath"), F.round(100 * F.col("abundance"), 6).alias("percentage"), "place")
