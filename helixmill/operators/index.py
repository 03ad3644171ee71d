"""A k-mer index: each key with the common ancestor of all sequences that have it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .taxonomy import lca_of_groups


def build(rows: DataFrame, lineage: list[str], root: int = 1, most_pos: int | None = None) -> DataFrame:
    """(key, taxid, gene_id, gene_pos, n) from rows of key, gene_id, pos and lineage columns.

    taxid is the deepest rank on which all occurrences agree. Gene and position stay only if they are the same in every
    occurrence, else both are 0. One shuffle, combined on the map side, whatever the order of rows."""
    if most_pos is not None:
        rows = rows.filter(F.col("pos") <= most_pos)
    same = (F.min("gene_id") == F.max("gene_id")) & (F.min("pos") == F.max("pos"))
    more = [F.when(same, F.min("gene_id")).otherwise(0).alias("gene_id"), F.when(same, F.min("pos")).otherwise(0).alias("gene_pos"), F.count(F.lit(1)).alias("n")]
    out = lca_of_groups(rows, ["key"], lineage, root, more)
    return out.select("key", F.col("lca").alias("taxid"), "gene_id", "gene_pos", "n")


def build_all_values(rows: DataFrame, taxid: str) -> DataFrame:
    """The index that keeps every value: distinct (key, taxid, gene_id, gene_pos)."""
    return rows.select("key", F.col(taxid).alias("taxid"), "gene_id", F.col("pos").alias("gene_pos")).distinct()


def upsert(index: DataFrame, rows: DataFrame, merge: dict[str, Column], custom: dict[str, Column] | None = None) -> DataFrame:
    """The index with rows added; values of equal keys are merged by aggregates, {column: aggregate over both sides' rows}.

    An aggregate of `merge` is a built-in expression such as F.max("taxid"), which combines before the shuffle. Those of `custom`
    are grouped-aggregate pandas UDFs over columns of merge or custom; each sees the values of a key in no order, and the values
    of one key are in memory at once. The two kinds are computed side by side and meet by key."""
    custom = custom or {}
    names = ["key", *merge, *custom]
    both = index.select(*names).unionByName(rows.select(*names))
    aggregated = [both.groupBy("key").agg(*[a.alias(n) for n, a in kind.items()]) for kind in (merge, custom) if kind]
    return aggregated[0] if len(aggregated) == 1 else aggregated[0].join(aggregated[1], "key")


def composition(hits: DataFrame, ranks: DataFrame, read: str, named: list[str]) -> DataFrame:
    """For each read, how many of its k-mers the index has at each of the named ranks, at none of them (no_rank), and not at
    all (missing). hits: rows of a lookup; ranks: (taxid, rank)."""
    each = hits.groupBy(read, "taxid").agg(F.count(F.lit(1)).alias("n")).join(ranks.select("taxid", "rank"), "taxid", "left")
    have, zero = F.col("taxid").isNotNull(), F.lit(0)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), zero)
    other = have & ~F.coalesce(F.col("rank").isin(named), F.lit(False))
    return each.groupBy(read).agg(*[count(have & (F.col("rank") == r)).alias(r) for r in named], count(other).alias("no_rank"), count(~have).alias("missing"))


def pack_sizes(values: DataFrame) -> DataFrame:
    """How many keys have how many values."""
    return values.groupBy("key").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_keys"))


def rank_composition(index: DataFrame, ranks: DataFrame) -> DataFrame:
    """Entries, those with a gene, and share of all entries by rank; ranks: (taxid, rank), which is small and is broadcast
    by the optimizer when it is."""
    by = index.join(ranks, "taxid", "left").groupBy(F.coalesce("rank", F.lit("no rank")).alias("rank"))
    counts = by.agg(F.count(F.lit(1)).alias("entries"), F.count(F.when(F.col("gene_id") > 0, 1)).alias("with_gene"))
    total = counts.agg(F.sum("entries").alias("total"))
    return counts.join(F.broadcast(total)).select("rank", "entries", "with_gene", (F.col("entries") / F.col("total")).alias("share"))


def unverified(rows: DataFrame, index: DataFrame, closed: DataFrame, taxid: str) -> DataFrame:
    """Reference k-mers that the index does not have, or has with a taxon that is no ancestor of theirs, or with another
    gene: empty for a right index."""
    found = rows.select("key", F.col(taxid).alias("own"), F.col("gene_id").alias("own_gene")).distinct().join(index, "key", "left")
    up = closed.select(F.col("id").alias("own"), F.col("ancestor_id").alias("taxid"), F.lit(True).alias("above"))
    held = found.join(up, ["own", "taxid"], "left")
    wrong = F.col("above").isNull() | ((F.col("gene_id") != 0) & (F.col("gene_id") != F.col("own_gene")))
    return held.filter(wrong).select("key", "own", "taxid")
