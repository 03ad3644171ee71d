"""Reads placed on genes: which of their k-mers agree, mutations in gene coordinates, and the rows that are put out.

A placement is (read columns, taxid, gene_id, forward, offset, read_length, gene_length). offset is where the read's first
k-mer lies in the gene: for a forward read its first base too; a reverse read runs down from there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.dna import Shape

from .profile import clip
from .variants import sliding_pattern


def gene_start(offset: Column, forward: Column, read_length: Column, shape: Shape) -> Column:
    """The gene position of the leftmost base of a read on either strand; below 0 if the read hangs over the start."""
    return F.when(forward, offset).otherwise(offset - (read_length - len(shape)))


def kmers_in_gene(offset: Column, forward: Column, read_length: Column, gene_length: Column, shape: Shape) -> tuple[Column, Column]:
    """First k-mer of a placed read that lies in its gene, and how many do."""
    s = len(shape)
    first = F.when(forward, F.greatest(F.lit(0), -offset)).otherwise(F.greatest(F.lit(0), offset + s - gene_length))
    last = F.when(forward, F.least(read_length, gene_length - offset) - s).otherwise(F.least(read_length - s, offset))
    return first, F.greatest(F.lit(0), last - first + 1)


def best_placement(votes: DataFrame, read: list[str]) -> DataFrame:
    """One placement of each read from classify.best_offsets: most votes; of equals the reverse strand, then the smaller
    offset, taxon and gene."""
    order = F.struct("votes", ~F.col("forward"), -F.col("offset"), -F.col("taxid"), -F.col("gene_id"))
    return votes.groupBy(*read).agg(F.max_by(F.struct("taxid", "gene_id", "forward", "offset", "votes"), order).alias("b")).select(*read, "b.*")


def marked(hits: DataFrame, placements: DataFrame, closed: DataFrame, shape: Shape, read: list[str]) -> DataFrame:
    """The k-mers of placed reads that lie in the gene, with the placement's columns and `hit`.

    hits: (read, pos, taxid, gene_id, gene_pos), nulls for misses. A k-mer hits if the index has it at this very place of
    this gene, or without a gene for the placed taxon or an ancestor of it; whatever else the index has is a miss."""
    placed = placements.select(*read, F.col("taxid").alias("to_taxid"), F.col("gene_id").alias("to_gene"), "forward", "offset", "read_length", "gene_length")
    first, n = kmers_in_gene(F.col("offset"), F.col("forward"), F.col("read_length"), F.col("gene_length"), shape)
    rows = hits.join(placed, read).filter((F.col("pos") >= first) & (F.col("pos") < first + n))
    up = closed.select(F.col("id").alias("to_taxid"), F.col("ancestor_id").alias("taxid"), F.lit(True).alias("above"))
    rows = rows.join(up, ["to_taxid", "taxid"], "left")
    at = F.when(F.col("forward"), F.col("gene_pos") - F.col("pos")).otherwise(F.col("gene_pos") + F.col("pos"))
    exact = (F.col("gene_id") > 0) & (F.col("gene_id") == F.col("to_gene")) & (F.col("taxid") == F.col("to_taxid")) & (at == F.col("offset"))
    hit = exact | ((F.col("gene_id") == 0) & F.col("above"))
    return rows.select(*read, "pos", F.col("to_taxid").alias("taxid"), F.col("to_gene").alias("gene_id"), "forward", "offset", "read_length", "gene_length", F.coalesce(hit, F.lit(False)).alias("hit"))


def in_gene(placed: DataFrame, sequence: str, shape: Shape) -> DataFrame:
    """Placements that carry their read's sequence, with the part of it whose k-mers lie in the gene instead, and `begin`, the
    position at which that part begins. Reads without such a k-mer are left out."""
    first, n = kmers_in_gene(F.col("offset"), F.col("forward"), F.col("read_length"), F.col("gene_length"), shape)
    return placed.filter(n > 0).withColumns({"begin": first.cast("int"), sequence: F.substring(sequence, first + 1, n + (len(shape) - 1))})


def call(rows: DataFrame, table: DataFrame, shape: Shape, bits: int, read: list[str]) -> DataFrame:
    """(read, taxid, gene_id, forward, gene_position, read_position): mutations told by the pattern of hits of marked() rows,
    once for each position of the gene.

    A window is `bits` successive k-mers without a gap; windows of misses alone and of hits alone tell nothing."""
    seen = sliding_pattern(rows, read, "pos", F.col("hit"), bits)
    begins = F.lag("pos", bits - 1).over(Window.partitionBy(*read).orderBy("pos"))
    seen = seen.withColumn("begin", begins).filter(F.col("begin") == F.col("pos") - (bits - 1))
    keep = [*read, "taxid", "gene_id", "forward", "offset"]
    asked = seen.select(*keep, "begin", F.col("turned").alias("pattern")).filter((F.col("pattern") != (1 << bits) - 1) & (F.col("pattern") != 0))
    told = asked.join(table.filter(F.size("mutations") > 0), "pattern").select(*keep, "begin", F.explode("mutations").alias("m"))
    told = told.withColumn("read_position", F.col("begin") + F.col("m"))
    at = F.when(F.col("forward"), F.col("offset") + F.col("read_position")).otherwise(F.col("offset") - F.col("read_position") + len(shape) - 1)
    return told.groupBy(*read, "taxid", "gene_id", "forward", at.cast("int").alias("gene_position")).agg(F.min("read_position").cast("int").alias("read_position"))


def snp_rows(calls: DataFrame, reads: DataFrame, read: list[str]) -> DataFrame:
    """calls with base and quality: the read's letter (its complement on the reverse strand) and the byte of its quality.

    reads: (read, sequence, quality). Calls on letters other than A, C, G, T are left out."""
    letter = F.substring("sequence", F.col("read_position") + 1, F.lit(1))
    base = F.when(F.col("forward"), letter).otherwise(F.translate(letter, "ACGT", "TGCA"))
    rows = calls.join(reads.select(*read, "sequence", "quality"), read).filter(letter.isin("A", "C", "G", "T"))
    return rows.select(*calls.columns, base.alias("base"), F.ascii(F.substring("quality", F.col("read_position") + 1, F.lit(1))).cast("smallint").alias("quality"))


def result_rows(rows: DataFrame, shape: Shape, read: list[str]) -> DataFrame:
    """(read, taxid, gene_id, gene_pos, hits_best, total_hits, read_length, overlap, forward) from marked() rows: k-mers that
    hit and k-mers in the gene, and the bases of the read that lie in it."""
    by = [*read, "taxid", "gene_id", "forward", "offset", "read_length", "gene_length"]
    start = gene_start(F.col("offset"), F.col("forward"), F.col("read_length"), shape)
    counts = rows.groupBy(*by).agg(F.count_if("hit").alias("hits_best"), F.count(F.lit(1)).alias("total_hits"))
    return counts.select(*read, "taxid", "gene_id", start.cast("int").alias("gene_pos"), "hits_best", "total_hits", "read_length", clip(start, F.col("read_length"), F.col("gene_length")).cast("int").alias("overlap"), "forward")


def paired_rows(mates: DataFrame, shape: Shape, pair: str) -> DataFrame:
    """(pair, gene_id, gene_pos, read_length, hits_best, placed): one row for both mates of a pair.

    mates: (pair, gene_id, forward, offset, read_length, hits), offset null for a mate without a place. The position is the
    smaller one of the placed mates, lengths of placed mates and hits of both add up; gene_id is null if neither is placed."""
    placed = F.col("offset").isNotNull()
    start = gene_start(F.col("offset"), F.col("forward"), F.col("read_length"), shape)
    return mates.groupBy(pair).agg(
        F.min(F.when(placed, F.col("gene_id"))).alias("gene_id"), F.min(F.when(placed, start)).cast("int").alias("gene_pos"),
        F.sum(F.when(placed, F.col("read_length"))).alias("read_length"), F.sum("hits").alias("hits_best"), F.count_if(placed).alias("placed"),
    )


def debug_rows(rows: DataFrame, read: list[str], truth: Column | None = None) -> DataFrame:
    """(read, taxid, gene_id, pattern, hits, correct): the string of hits and misses of each placed read, for looking at.
    A read's string is as long as the read."""
    by = rows.groupBy(*read, "taxid", "gene_id").agg(F.sort_array(F.collect_list(F.struct("pos", "hit"))).alias("x"), F.count_if("hit").alias("hits"))
    text = F.array_join(F.transform("x", lambda e: F.when(e.hit, "1").otherwise("0")), "")
    return by.select(*read, "taxid", "gene_id", text.alias("pattern"), "hits", (F.lit(None).cast("boolean") if truth is None else truth == F.col("taxid")).alias("correct"))
