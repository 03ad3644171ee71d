"""Strains of several samples compared by their alleles. Observations: (sample, taxid, gene_id, position, base, quality)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOCUS = ["sample", "taxid", "gene_id", "position"]
GENE = ["taxid", "gene_id"]
REFERENCE = "R"


def allele_counts(seen: DataFrame) -> DataFrame:
    """(locus, base, n, quality, mean_quality)."""
    return seen.groupBy(*LOCUS, "base").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality"), F.avg("quality").alias("mean_quality"))


def with_reference(alleles: DataFrame, coverage: DataFrame) -> DataFrame:
    """alleles with a row `R` for what covers a locus and is no allele; coverage: (locus, coverage)."""
    counted = alleles.groupBy(*LOCUS).agg(F.sum("n").alias("seen")).join(coverage, LOCUS)
    rest = counted.filter("coverage > seen").select(*LOCUS, F.lit(REFERENCE).alias("base"), (F.col("coverage") - F.col("seen")).alias("n"))
    return alleles.select(*LOCUS, "base", "n").union(rest)


def frequent(alleles: DataFrame, share: float = 0.2, least: int = 2, where: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Alleles with at least `least` observations and `share` of the locus's; the reference is no allele. where: another
    condition, of an allele's observations and its locus's."""
    total = F.sum("n").over(Window.partitionBy(*LOCUS))
    good = where or (lambda n, of: (n / of >= share) & (n >= least))
    return alleles.withColumn("_total", total).filter(good(F.col("n"), F.col("_total")) & (F.col("base") != REFERENCE)).drop("_total")


def locus_statistics(alleles: DataFrame) -> DataFrame:
    """(locus, alleles, observations, major): major is the most frequent base but the reference, the first of equals."""
    other = F.when(F.col("base") != REFERENCE, F.col("base"))
    order = F.when(F.col("base") != REFERENCE, F.struct(F.col("n"), -F.ascii("base")))
    return alleles.groupBy(*LOCUS).agg(F.count(other).alias("alleles"), F.sum("n").alias("observations"), F.max_by(other, order).alias("major"))


def differing_loci(alleles: DataFrame, reference: DataFrame) -> DataFrame:
    """alleles of loci where no observed base is the reference's; reference: (taxid, gene_id, sequence)."""
    base = alleles.join(reference, GENE).withColumn("_ref", F.substring("sequence", F.col("position") + 1, F.lit(1)))
    equal = base.filter("base = _ref").select(*LOCUS).distinct()
    return alleles.join(equal, LOCUS, "left_anti")


def members(snps: DataFrame, taxa: DataFrame, reads: DataFrame) -> DataFrame:
    """Observations of predicted taxa (taxid) on valid reads (read_id, read_num), without unset positions."""
    return snps.filter("position <> -1").join(taxa, "taxid", "left_semi").join(reads, ["read_id", "read_num"], "left_semi")


#: Samples of a block, and positions that are compared at once.
BLOCK, STRETCH = 256, 8192
_COUNTS = ["shared_length", "shared", "only_a", "only_b", "differing"]


def gene_distance(major: DataFrame, ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(taxid, gene_id, sample_a, sample_b, shared_length, shared, only_a, only_b, differing) for pairs of samples that share
    covered positions of a gene; major: (locus, base), a locus once; ranges: merged (sample, taxid, gene_id, start, end).

    Only positions within both samples' ranges count. What a sample has of a gene is one row. Samples are dealt into blocks of about
    `block`, and two blocks of a gene are compared as matrices over stretches of its positions, so a row moves once for
    each block of samples and not for each sample."""
    listed = lambda df, to, *c: df.groupBy(*GENE, "sample").agg(F.collect_list(F.struct(*c)).alias(to))
    own = listed(ranges.filter("start < end"), "ranges", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    own = own.join(listed(major, "alleles", F.col("position").cast("long").alias("position"), "base"), [*GENE, "sample"], "left")
    n = max(1, -(-ranges.select("sample").distinct().count() // block))
    at, other = F.pmod(F.xxhash64("sample"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = own.withColumn("_at", at).withColumn("_other", other)
    rows = rows.withColumns({"_i": F.least("_at", "_other"), "_j": F.greatest("_at", "_other")}).drop("_other")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = f"taxid {kinds['taxid']}, gene_id {kinds['gene_id']}, sample_a {kinds['sample']}, sample_b {kinds['sample']}, " + ", ".join(f"{c} long" for c in _COUNTS)
    return rows.groupBy(*GENE, "_i", "_j").applyInArrow(_compared, schema)


def _stretch(table, lo: int, size: int, codes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Which of the positions lo.. each row covers, and the code of its allele there (0: none, or not covered)."""
    covered, base = np.zeros((len(table), size), np.float32), np.zeros((len(table), size), np.int16)
    for i, (ranges, alleles) in enumerate(table):
        for r in ranges:
            covered[i, max(r["start"] - lo, 0) : max(r["end"] - lo, 0)] = 1
        for a in alleles or []:
            if lo <= a["position"] < lo + size:
                base[i, a["position"] - lo] = codes[a["base"]]
    base[covered == 0] = 0
    return covered, base


def _compared(table: pa.Table) -> pa.Table:
    """Counts of all pairs of samples of two blocks (of one block with itself)."""
    rows = table.to_pylist()
    sides = [[r for r in rows if r["_at"] == b] for b in dict.fromkeys((rows[0]["_i"], rows[0]["_j"]))]
    x, y = sides[0], sides[-1]
    codes = {b: i + 1 for i, b in enumerate(sorted({a["base"] for r in rows for a in r["alleles"] or []}, key=str))}
    starts, ends = [e["start"] for r in rows for e in r["ranges"]], [e["end"] for r in rows for e in r["ranges"]]
    total = np.zeros((len(_COUNTS), len(x), len(y)), np.int64)
    for lo in range(min(starts), max(ends), STRETCH):
        size = min(STRETCH, max(ends) - lo)
        (cx, bx), (cy, by) = (_stretch([(r["ranges"], r["alleles"]) for r in side], lo, size, codes) for side in (x, y))
        if not cx.any() or not cy.any():
            continue
        hx, hy = (bx > 0).astype(np.float32), (by > 0).astype(np.float32)
        met = lambda p, q: np.rint(p @ q.T).astype(np.int64)
        shared = met(hx, hy)
        same = sum((met((bx == c).astype(np.float32), (by == c).astype(np.float32)) for c in codes.values()), np.zeros_like(shared))
        total += np.stack([met(cx, cy), shared, met(hx, cy) - shared, met(cx, hy) - shared, shared - same])
    both = len(sides) == 2
    some = (total[0] > 0) & (True if both else ~np.eye(len(x), dtype=bool))
    i, j = np.nonzero(some)
    found = total[:, i, j]
    a, b = [x[k]["sample"] for k in i], [y[k]["sample"] for k in j]
    if both:  # the other way round too
        found = np.concatenate([found, found[[0, 1, 3, 2, 4]]], axis=1)
        a, b = a + b, b + a
    n, kind = len(a), table.schema.field("sample").type
    same_gene = [table.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for c in GENE]
    return pa.table([*same_gene, pa.array(a, kind), pa.array(b, kind), *map(pa.array, found)], names=[*GENE, "sample_a", "sample_b", *_COUNTS])


def simple_gene_distance(snps: DataFrame, ranges: DataFrame) -> DataFrame:
    """As gene_distance() by position alone, whatever the base: columns as there without `differing`, and length_a, length_b,
    and share, the shared length over the length that either sample covers."""
    counts = gene_distance(snps.select(*LOCUS).distinct().withColumn("base", F.lit("N")), ranges).drop("differing")
    sizes = ranges.groupBy(*GENE, "sample").agg(F.sum(F.col("end") - F.col("start")).alias("length"))
    for s in "ab":
        counts = counts.join(sizes.select(*GENE, F.col("sample").alias(f"sample_{s}"), F.col("length").alias(f"length_{s}")), [*GENE, f"sample_{s}"])
    return counts.withColumn("share", F.col("shared_length") / (F.col("length_a") + F.col("length_b") - F.col("shared_length")))


def simple_strain_distance(genes: DataFrame) -> DataFrame:
    """(taxid, sample_a, sample_b, genes, shared_length, distance, share) from simple_gene_distance(): positions that one sample
    alone has over the shared length, and the mean of the genes' shares weighted by their shared lengths."""
    s = genes.groupBy("taxid", "sample_a", "sample_b").agg(
        F.count(F.lit(1)).alias("genes"), F.sum("shared_length").alias("shared_length"), F.sum(F.col("only_a") + F.col("only_b")).alias("d"), F.sum(F.col("shared_length") * F.col("share")).alias("w")
    )
    size = F.when(F.col("shared_length") > 0, F.col("shared_length"))
    return s.select("taxid", "sample_a", "sample_b", "genes", "shared_length", (F.col("d") / size).alias("distance"), (F.col("w") / size).alias("share"))


def distances(major: DataFrame, ranges: DataFrame, kind: str = "jc69", least_genes: int = 3) -> DataFrame:
    """Distances of strains between samples: "jc69" compares alleles, "simple" positions."""
    if kind == "jc69":
        return strain_distance(gene_distance(major, ranges), least_genes)
    if kind == "simple":
        return simple_strain_distance(simple_gene_distance(major, ranges))
    raise ValueError(f"no distance {kind!r}")


def jukes_cantor(p: Column) -> Column:
    """-3/4 ln(1 - 4/3 p); null where it is not defined."""
    return F.when(p < 0.75, -0.75 * F.log(1 - p * 4.0 / 3.0))


def strain_distance(genes: DataFrame, least_genes: int = 3) -> DataFrame:
    """(taxid, sample_a, sample_b, genes, shared_length, differences, distance): distance is null for fewer genes than asked."""
    diff = F.col("only_a") + F.col("only_b") + F.col("differing")
    s = genes.groupBy("taxid", "sample_a", "sample_b").agg(F.count(F.lit(1)).alias("genes"), F.sum("shared_length").alias("shared_length"), F.sum(diff).alias("differences"))
    return s.withColumn("distance", F.when((F.col("genes") >= least_genes) & (F.col("shared_length") > 0), jukes_cantor(F.col("differences") / F.col("shared_length"))))


def matrix(distances: DataFrame, samples: list[str]) -> DataFrame:
    """One row for each strain and sample, one column for each other sample."""
    return distances.groupBy("taxid", F.col("sample_a").alias("samples")).pivot("sample_b", samples).agg(F.first("distance")).orderBy("taxid", "samples")
