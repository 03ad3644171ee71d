"""Classification of reads by their k-mers: lookup join, placement of hits, scores along the taxonomy."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.dna import Shape
from helixmill.staging import partitions


def lookup(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows of (key, ...) with taxid, gene_id and gene_pos of the index; a miss has nulls. The optimizer broadcasts the index
    while it is small by its statistics; beyond that both sides are hashed by key."""
    return rows.join(index.select("key", "taxid", "gene_id", "gene_pos"), "key", "left")


def lookup_places(places: DataFrame, index: DataFrame) -> DataFrame:
    """lookup() of kmers.occurrences(): the rows of every k-mer (kept columns, pos, key) with taxid, gene_id and gene_pos of the index.

    Distinct keys with their lists of places meet the index; a stored index (sources.store) lies in buckets of the key and is not
    moved. Lists become rows after the join."""
    found = places.join(index.select("key", "taxid", "gene_id", "gene_pos"), "key", "left")
    return found.select("key", "taxid", "gene_id", "gene_pos", F.inline("at"))


def enough_hits(hits: DataFrame, read: str, least: int = 2) -> DataFrame:
    """(read, hits) of reads with at least `least` keys in the index."""
    return hits.groupBy(read).agg(F.count("taxid").alias("hits")).filter(F.col("hits") >= least)


def hit_coverage(hits: DataFrame, read: str) -> DataFrame:
    """The share of a read's k-mers that hit. Reads without k-mers have no row."""
    return hits.groupBy(read).agg((F.count("taxid") / F.count(F.lit(1))).alias("hit_coverage"))


def is_leaf_hit(last_leaf: Column | int) -> Column:
    """A hit that places a read: a leaf taxon, a gene, and a position other than 0."""
    return (F.col("taxid") > 1) & (F.col("taxid") <= last_leaf) & (F.col("gene_id") > 0) & (F.col("gene_pos") > 0)


def _spread(leaf_hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, gene_pos) by placement in a set number of partitions. Sums before a shuffle would keep a group for nearly each hit of
    a task, and AQE, which goes by compressed bytes, would join many hits into one task."""
    return leaf_hits.select(*by, "pos", "gene_pos").repartition(partitions(leaf_hits.sparkSession), *by)


def fold_offsets(leaf_hits: DataFrame, read: str | list[str]) -> DataFrame:
    """For each read (and mate, if read names both columns), taxon and gene: the offsets on either strand that its first hit (by position) sets, and how many hits
    agree with each. Forward: gene position - read position; reverse: their sum."""
    by = [*_columns(read), "taxid", "gene_id"]
    fwd, rev = F.col("gene_pos") - F.col("pos"), F.col("gene_pos") + F.col("pos")
    first = Window.partitionBy(*by).orderBy("pos")
    marked = _spread(leaf_hits, by).select(*by, "pos", fwd.alias("f"), rev.alias("r")).withColumn("off_fwd", F.first("f").over(first)).withColumn("off_rev", F.first("r").over(first))
    return marked.groupBy(*by, "off_fwd", "off_rev").agg(F.count(F.when(F.col("f") == F.col("off_fwd"), 1)).alias("n_fwd"), F.count(F.when(F.col("r") == F.col("off_rev"), 1)).alias("n_rev"), F.min("pos").alias("first_pos"), (F.max("pos") - F.min("pos")).alias("span"))


def _columns(read: str | list[str]) -> list[str]:
    return [read] if isinstance(read, str) else list(read)


def mate_hits(folded: DataFrame, pair: str, mate: str) -> DataFrame:
    """(pair, taxid, gene_id, hits, hits_1, hits_2): hits of a placement, those of its mates (1 and 2) added up; each mate
    counts the strand with more hits. folded: fold_offsets() by pair and mate."""
    own = F.greatest("n_fwd", "n_rev")
    each = [F.coalesce(F.sum(F.when(F.col(mate) == m, own)), F.lit(0)).alias(f"hits_{m}") for m in (1, 2)]
    return folded.groupBy(pair, "taxid", "gene_id").agg(F.sum(own).alias("hits"), *each)


def taxon_sums(nodes: DataFrame, answers: DataFrame, closed: DataFrame, leaves: Column, read: str) -> DataFrame:
    """(read, taxid, gene_id, support): hits of an answer and its ancestors. nodes: (read, taxid, gene_id, hits). A node that is
    a leaf counts if it is of the answer's gene, or the answer has none (0)."""
    up = closed.select(F.col("id").alias("to_taxid"), F.col("ancestor_id").alias("taxid"))
    asked = answers.select(read, F.col("taxid").alias("to_taxid"), F.col("gene_id").alias("to_gene")).join(up, "to_taxid")
    rows = nodes.join(asked, [read, "taxid"]).filter(~leaves | (F.col("to_gene") < 1) | (F.col("to_gene") == F.col("gene_id")))
    return rows.groupBy(read, F.col("to_taxid").alias("taxid"), F.col("to_gene").alias("gene_id")).agg(F.sum("hits").alias("support"))


def inner_support(inner_hits: DataFrame, folded: DataFrame, closed: DataFrame, read: str) -> DataFrame:
    """(read, taxid, gene_id, inner): hits on inner nodes that still have a gene and a place, counted for the leaf placement
    that they agree with: a descendant of theirs, in the same gene and at an offset of either strand. Of several leaves the
    one whose first hit comes first in the read counts, of equals the smallest taxon."""
    up = closed.filter("distance > 0").select("id", F.col("ancestor_id").alias("inner"))
    leaf = folded.select(read, F.col("taxid").alias("leaf"), "gene_id", "off_fwd", "off_rev", "first_pos")
    rows = inner_hits.withColumnRenamed("taxid", "inner").join(leaf, [read, "gene_id"])
    rows = rows.filter((F.col("gene_pos") - F.col("pos") == F.col("off_fwd")) | (F.col("gene_pos") + F.col("pos") == F.col("off_rev")))
    rows = rows.join(up.withColumnRenamed("id", "leaf"), ["leaf", "inner"])
    first = rows.groupBy(read, "pos", "gene_id").agg(F.min_by("leaf", F.struct("first_pos", "leaf")).alias("taxid"))
    return first.groupBy(read, "taxid", "gene_id").agg(F.count(F.lit(1)).alias("inner"))


def assign(taxa: DataFrame, read: str, strategy: str = "descent", closed: DataFrame | None = None, lineages: DataFrame | None = None, ranks: list[str] | None = None, root: int = 1, **options) -> DataFrame:
    """(read, taxid, ...) by one of the strategies: "descent" (needs lineages and ranks), "pathsum" (needs closed) or
    "pathsum_lca" (needs all). options go to the strategy."""
    if strategy == "descent":
        return descend(taxa, lineages, ranks, read, root=root, **options)
    scores = path_scores(taxa, closed, read)
    if strategy == "pathsum":
        return best_taxon(scores, read, **options)
    if strategy == "pathsum_lca":
        return best_with_ties(scores, lineages, ranks, read, root, **options)
    raise ValueError(f"no strategy {strategy!r}")


def node_hits(folded: DataFrame) -> DataFrame:
    """Hits of a placement and its strand; of equal counts the reverse one."""
    return folded.withColumn("hits", F.greatest("n_fwd", "n_rev")).withColumn("forward", F.col("n_fwd") > F.col("n_rev"))


def best_offsets(leaf_hits: DataFrame, read: str | list[str]) -> DataFrame:
    """The offset with most hits for each read (and mate), taxon and gene, over both strands; of equals the reverse, then the smaller."""
    both = F.explode(F.array(F.struct(F.lit(True).alias("forward"), (F.col("gene_pos") - F.col("pos")).alias("offset")), F.struct(F.lit(False).alias("forward"), (F.col("gene_pos") + F.col("pos")).alias("offset"))))
    by = [*_columns(read), "taxid", "gene_id"]
    votes = _spread(leaf_hits, by).select(*by, both.alias("o")).groupBy(*by, "o.forward", "o.offset").agg(F.count(F.lit(1)).alias("votes"))
    order = F.struct("votes", ~F.col("forward"), -F.col("offset"))
    return votes.groupBy(*by).agg(F.max_by(F.struct("forward", "offset", "votes"), order).alias("b")).select(*by, "b.*")


def read_taxa(hits: DataFrame, read: str) -> DataFrame:
    """(read, taxid, hits): found keys of each taxon, counted before anything is joined to them."""
    return hits.filter("taxid is not null").groupBy(read, "taxid").agg(F.count(F.lit(1)).alias("hits"))


def path_scores(taxa: DataFrame, closed: DataFrame, read: str) -> DataFrame:
    """(read, taxid, hits, score) where score adds the read's hits of all ancestors to its own."""
    up = closed.select(F.col("id").alias("taxid"), F.col("ancestor_id").alias("above"))
    above = taxa.select(read, F.col("taxid").alias("above"), F.col("hits").alias("above_hits"))
    return taxa.join(up, "taxid").join(above, [read, "above"]).groupBy(read, "taxid", "hits").agg(F.sum("above_hits").alias("score"))


def best_taxon(scores: DataFrame, read: str) -> DataFrame:
    """The taxon with the largest score; of equals the smallest id. n_best: how many have that score."""
    w = Window.partitionBy(read)
    top = scores.withColumn("top", F.max("score").over(w)).filter("score = top")
    return top.groupBy(read).agg(F.min("taxid").alias("taxid"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n_best"))


def best_with_ties(scores: DataFrame, lineages: DataFrame, ranks: list[str], read: str, root: int = 1) -> DataFrame:
    """The taxon with the largest score; of equals their common ancestor."""
    from .taxonomy import lca_of_groups

    top = scores.withColumn("top", F.max("score").over(Window.partitionBy(read))).filter("score = top")
    return lca_of_groups(top.join(lineages.withColumnRenamed("id", "taxid"), "taxid"), [read], ranks, root, [F.max("score").alias("score"), F.count(F.lit(1)).alias("n_best")]).withColumnRenamed("lca", "taxid")


def confidences(scores: DataFrame, read: str) -> DataFrame:
    """Share of a taxon's own hits in its score, and of its score among the read's candidates: (score - least + 1) / sum."""
    w = Window.partitionBy(read)
    lifted = scores.withColumn("lifted", F.col("score") - F.min("score").over(w) + 1)
    return lifted.select(read, "taxid", (F.col("hits") / F.col("score")).alias("rank_confidence"), (F.col("lifted") / F.sum("lifted").over(w)).alias("candidate_confidence"))


def run_counters(per_read: DataFrame, answers: DataFrame, read: str) -> DataFrame:
    """One row about a whole run: reads, kmers, hits, misses, and reads classified and not. per_read: (read, n_kmers, hits);
    answers: a row for each classified read."""
    told = answers.select(read).distinct().withColumn("_told", F.lit(True))
    rows = per_read.join(told, read, "left")
    return rows.agg(
        F.count(F.lit(1)).alias("reads"), F.sum("n_kmers").alias("kmers"), F.sum("hits").alias("hits"), F.sum(F.col("n_kmers") - F.col("hits")).alias("misses"),
        F.count("_told").alias("classified"), F.count_if(F.col("_told").isNull()).alias("unclassified"),
    )


def score_vectors(scores: DataFrame, closed: DataFrame, read: str, truth: Column) -> DataFrame:
    """(read, correct, truth, taxid, own_vector, total_vector, rank_confidence, candidate_confidence, total_hits, own_hits): each
    read's candidates in order of score, of equals by taxon, and what is said of the first of them. It is correct if it is the
    true taxon or an ancestor of it. scores: (read, taxid, hits, score); truth: of columns of scores, one for each read."""
    each = confidences(scores, read).join(scores.select(read, "taxid", "hits", "score", truth.alias("truth")), [read, "taxid"])
    rows = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "taxid", "hits", "score", "rank_confidence", "candidate_confidence")))
    listed = each.groupBy(read).agg(F.first("truth").alias("truth"), rows.alias("x"))
    vector = lambda c: F.array_join(F.transform("x", lambda e: e[c].cast("string")), ",")
    best = F.col("x")[0]
    out = listed.select(read, "truth", best["taxid"].alias("taxid"), vector("hits").alias("own_vector"), vector("score").alias("total_vector"), best["rank_confidence"].alias("rank_confidence"), best["candidate_confidence"].alias("candidate_confidence"), best["score"].alias("total_hits"), best["hits"].alias("own_hits"))
    up = closed.select(F.col("id").alias("truth"), F.col("ancestor_id").alias("taxid"), F.lit(True).alias("correct"))
    return out.join(up, ["truth", "taxid"], "left").withColumn("correct", F.coalesce("correct", F.lit(False)))


def ambiguous(folded_hits: DataFrame, read: str) -> DataFrame:
    """(read, ambiguous, alternatives): whether a read has a gene of a leaf taxon where hits lie at other offsets than the one that
    its first hit sets on either strand, and how many such offsets there are. folded_hits: leaf hits of a lookup."""
    by = [read, "taxid", "gene_id"]
    fwd, rev = F.col("gene_pos") - F.col("pos"), F.col("gene_pos") + F.col("pos")
    first = Window.partitionBy(*by).orderBy("pos")
    rows = _spread(folded_hits, by).select(*by, fwd.alias("f"), rev.alias("r"), F.first(fwd).over(first).alias("f0"), F.first(rev).over(first).alias("r0"))
    other = (F.col("f") != F.col("f0")) & (F.col("r") != F.col("r0"))
    each = rows.groupBy(*by, "f").agg(F.count_if(other).alias("n")).groupBy(read).agg(F.count_if(F.col("n") > 0).alias("alternatives"))
    return each.select(read, (F.col("alternatives") > 0).alias("ambiguous"), "alternatives")


def descend(taxa: DataFrame, lineages: DataFrame, ranks: list[str], read: str, share: float = 0.7, least: int = 3, root: int = 1, mates: list[str] | None = None) -> DataFrame:
    """(read, taxid, path_hits): from the root down, rank by rank, into the child that has more than `share` of the hits at
    or below this level and at least `least`; hits of every node on the way add up, and a read is classified if they
    exceed `least`.

    mates: columns of hits of each mate, where `hits` is their sum. The way down is by the sum; path_<column> adds up each
    mate's hits along it, and a pair is classified if one of them exceeds `least`.

    Hits of the taxa on the path so far are not part of a level's total. A read whose next set rank differs between taxa is
    compared at the first rank that one of them has; taxa that end there do not go further. The share is compared as a decimal: 63 hits
    are not more than 0.7 of 90, as they are in doubles. Each rank is one window over
    the read's few taxa, all on the same partitioning, so the whole descent is one shuffle."""
    t = taxa.join(lineages.withColumnRenamed("id", "taxid"), "taxid", "left")
    w = Window.partitionBy(read)
    on = (F.col("taxid") == root)
    t = t.withColumn("at", F.lit(root)).withColumn("open", F.lit(True)).withColumn("live", ~on)
    paths = {"path_hits": "hits"} if mates is None else {f"path_{m}": m for m in mates}
    t = t.withColumns({p: F.coalesce(F.sum(F.when(on, F.col(h))).over(w), F.lit(0)) for p, h in paths.items()})
    for r in ranks:
        child = Window.partitionBy(read, "live", r)
        t = t.withColumn("total", F.sum(F.when(F.col("live"), F.col("hits"))).over(w))
        t = t.withColumn("below", F.when(F.col("live") & F.col(r).isNotNull(), F.sum("hits").over(child)))
        t = t.withColumn("good", F.coalesce(F.col("open") & (F.col("below") > F.lit(Decimal(str(share))) * F.col("total")) & (F.col("below") >= least), F.lit(False)))
        t = t.withColumn("to", F.max(F.when(F.col("good"), F.col(r))).over(w))
        some = F.max(F.when(F.col("live") & F.col(r).isNotNull(), 1)).over(w).isNotNull()
        t = t.withColumn("some", some)
        t = t.withColumn("live", F.when(F.col("open") & F.col("some"), F.col("live") & F.coalesce(F.col(r) == F.col("to"), F.lit(False))).otherwise(F.col("live")))
        own = F.col("live") & (F.col("taxid") == F.col("to"))
        t = t.withColumns({p: F.col(p) + F.coalesce(F.sum(F.when(own, F.col(h))).over(w), F.lit(0)) for p, h in paths.items()})
        t = t.withColumn("live", F.col("live") & ~F.coalesce(F.col("taxid") == F.col("to"), F.lit(False)))
        t = t.withColumn("at", F.coalesce("to", "at")).withColumn("open", F.col("open") & (~F.col("some") | F.col("to").isNotNull()))
    return t.groupBy(read).agg(F.max("at").alias("taxid"), *[F.max(p).alias(p) for p in paths]).filter(F.greatest(F.lit(0), *paths) > least)


def orientation(offset: Column, read_length: Column, gene_length: Column, forward: Column) -> Column:
    """Where a placed read lies: inside the gene, over its start, over its end or over both, with the strand."""
    strand = F.when(forward, "forward").otherwise("reverse")
    start, end = offset < 0, offset + read_length > gene_length
    place = F.when(start & end, "spans").when(start, "over_start").when(end, "over_end").otherwise("inside")
    return F.when(offset.isNull() | forward.isNull(), "unplaced").otherwise(F.concat_ws("_", place, strand))


def overlapping_kmers(pos: Column, read_length: Column, gene_length: Column, shape: Shape) -> tuple[Column, Column]:
    """First k-mer of a read that lies in the gene when the read starts at gene position pos, and how many do."""
    start = F.greatest(F.lit(0), -pos)
    last = F.least(read_length, gene_length - pos) - len(shape)
    return start, F.greatest(F.lit(0), last - start + 1)


def valid_pair(a: Column, b: Column) -> Column:
    """Ids of mates: equal, or equal but for a final 1 and 2."""
    stem = lambda s: F.substring(s, F.lit(1), F.length(s) - 1)
    return (a == b) | ((stem(a) == stem(b)) & (F.right(a, F.lit(1)) == "1") & (F.right(b, F.lit(1)) == "2"))


def hit_type(first: Column, second: Column) -> Column:
    """Which mates have at least two collinear hits."""
    a, b = F.coalesce(first >= 2, F.lit(False)), F.coalesce(second >= 2, F.lit(False))
    return F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("none")


def zip_mates(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """Records of two mate files side by side, by sample and ordinal, never by row order."""
    rename = lambda df, n: df.select(*on, *[F.col(c).alias(f"{c}_{n}") for c in df.columns if c not in on])
    return rename(first, 1).join(rename(second, 2), on)
