"""Abundance correction: which share of the reads that a gene can give is classified to its own taxon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .classify import best_taxon, path_scores


def windows(rows: DataFrame, gene: list[str], size: int, overlap: int) -> DataFrame:
    """(gene, start, taxid, hits): hits of each taxon in every window of `size` k-mers that a simulated read may cover.

    rows: (gene, pos, taxid) of each k-mer of a gene in the index. Windows begin at every position from overlap - size on,
    so the first has `overlap` k-mers of the gene; those of the other end run out of it. Windows without k-mers have no rows.

    Each k-mer is two events, where it enters the windows and where it leaves them. Hits are running sums of a gene's and taxon's
    events, so a row for each window is made only once hits have been added up."""
    events = F.array(F.struct(F.greatest(F.col("pos") - (size - 1), F.lit(overlap - size)).alias("at"), F.lit(1).alias("d")), F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("d")))
    steps = rows.select(*gene, "taxid", F.inline(events)).groupBy(*gene, "taxid", "at").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*gene, "taxid").orderBy("at")
    steps = steps.select(*gene, "taxid", "at", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"), F.lead("at").over(order).alias("next"))
    return steps.filter("hits > 0").select(*gene, F.explode(F.sequence("at", F.col("next") - 1)).alias("start"), "taxid", "hits")


def factors(rows: DataFrame, closed: DataFrame, taxid: str, gene: str, size: int = 85, overlap: int = 20) -> DataFrame:
    """(taxid, gene_id, factor): windows whose best taxon by path sums is the gene's own, over all windows of the gene.

    rows: (own taxon, gene, pos, taxid), taxid what the index has for that k-mer. A gene of n k-mers has n + 2 (size - overlap)
    windows; those that lie beyond its last k-mer count as not classified."""
    by = ["own_taxid", "gene"]
    given = rows.select(F.col(taxid).alias("own_taxid"), F.col(gene).alias("gene"), "pos", "taxid")
    hits = windows(given.filter("taxid is not null"), by, size, overlap).withColumn("read", F.struct(*by, "start"))
    best = best_taxon(path_scores(hits.select("read", "taxid", "hits"), closed, "read"), "read")
    right = best.filter(F.col("taxid") == F.col("read.own_taxid")).groupBy(F.col("read.own_taxid").alias("own_taxid"), F.col("read.gene").alias("gene")).agg(F.count(F.lit(1)).alias("right"))
    n = given.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    share = F.coalesce("right", F.lit(0)) / (F.col("n") + 2 * (size - overlap))
    return n.join(right, by, "left").select(F.col("own_taxid").alias("taxid"), F.col("gene").alias("gene_id"), share.alias("factor"))
