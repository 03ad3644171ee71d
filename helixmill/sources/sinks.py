"""Writers of results. Tables are Parquet; the text forms are for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textsink


def table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet; mode "ignore" leaves a finished result as it is."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def tsv(df: DataFrame, path: str, header: bool = True, gzip: bool = False) -> None:
    df.write.csv(path, sep="\t", header=header, compression="gzip" if gzip else "none")


def taxonomy(nodes: DataFrame, path: str) -> None:
    tsv(nodes.select("id", "parent_id", "external_id", "name", "rank", "level", "rep_genome"), path)


def profile_lines(rows: DataFrame, sample: str, ranks: list[str]) -> DataFrame:
    """Lines of a profile file, header first: (line), ordered; a profile is a few thousand lines."""
    head = [f"@SampleID:{sample}", "@Version:0.9.1", "@Ranks:" + "|".join(ranks), "", "@@TAXID\tRANK\tNAME\tPERCENTAGE"]
    spark = rows.sparkSession
    top = spark.createDataFrame([(i, h) for i, h in enumerate(head)], "at int, line string").select(F.lit(-1).alias("place"), F.lit(0.0).alias("p"), "at", "line")
    place = F.coalesce(*[F.when(F.col("rank") == r, F.lit(i)) for i, r in enumerate(ranks)], F.lit(len(ranks)))
    body = rows.select(place.alias("place"), (-F.col("percentage")).alias("p"), F.col("taxid").cast("int").alias("at"), F.concat_ws("\t", F.col("taxid").cast("string"), "rank", "name", F.format_string("%.6f", F.col("percentage").cast("double"))).alias("line"))
    return top.union(body).orderBy("place", "p", "at").select("line")


def matrices(distances: DataFrame, path: str, samples: list[str]) -> None:
    """One directory for each strain, with a row for each sample and a column for each of the samples."""
    wide = distances.groupBy("taxid", F.col("sample_a").alias("samples")).pivot("sample_b", samples).agg(F.first("distance"))
    wide.write.partitionBy("taxid").csv(path, sep="\t", header=True)


def profile_file(rows: DataFrame, path: str, sample: str, ranks: list[str]) -> None:
    """profile.profile_rows() as a profile file: a header, strains first, then species up to the root, larger shares first. The file
    is one part of text; a profile is a few thousand lines."""
    head = [f"@SampleID: {sample}", "@Version: 0.9.1", "@Ranks:" + "|".join([*ranks, "strain"]), "@@TAXID\tRANK\tTAXPATH\tTAXPATHSN\tPERCENTAGE"]
    spark = rows.sparkSession
    top = spark.createDataFrame([(-1, float(i), "", h) for i, h in enumerate(head)], "place int, p double, t string, line string")
    line = F.concat_ws("\t", "taxid", "rank", "taxpath", "namepath", F.format_string("%.6f", F.col("percentage").cast("double")))
    body = rows.select(F.col("place").cast("int").alias("place"), (-F.col("percentage").cast("double")).alias("p"), F.col("taxid").alias("t"), line.alias("line"))
    top.union(body).repartition(1).sortWithinPartitions("place", "p", "t").select("line").write.text(path)


def fasta(df: DataFrame, path: str, order: list[str], gzip: bool = False) -> None:
    """Records (header, sequence) as FASTA text in an order: range-partitioned files whose names sort as their records do."""
    textsink.save(df, path, "fasta", order, gzip)


def fastq(df: DataFrame, path: str, gzip: bool = False) -> None:
    textsink.save(df, path, "fastq", gzip=gzip)


def raw_taxa(table: DataFrame, path: str, gzip: bool = False) -> None:
    """The table of taxa that a profile is made of (profile.taxon_table) as a tab-separated file with a header."""
    names = ["taxid", "reads", "bases", "present_genes", "n_genes", "expected_genes", "median_ani"]
    tsv(table.select(*names), path, gzip=gzip)


def corrections(factors: DataFrame, path: str) -> None:
    """(taxid, gene_id, factor) as tables.corrections() reads it."""
    tsv(factors.select("taxid", "gene_id", "factor"), path, header=False)


def classified_and_not(reads: DataFrame, classified: DataFrame, key: str, path: str) -> None:
    """The reads whose key is in `classified` and the others, in two directories."""
    reads.join(classified.select(key).distinct(), key, "left_semi").write.parquet(f"{path}/classified")
    reads.join(classified.select(key).distinct(), key, "left_anti").write.parquet(f"{path}/unclassified")


def vcf_records(snps: DataFrame) -> DataFrame:
    """(chrom, position, base, line) of variant records from (taxid, gene_id, position, reference, base, n, coverage)."""
    chrom = F.concat_ws("_", F.col("taxid").cast("string"), F.col("gene_id").cast("string"))
    line = F.concat_ws("\t", chrom, (F.col("position") + 1).cast("string"), F.lit("."), "reference", "base", F.lit("."), F.lit("PASS"), F.format_string("DP=%d;AC=%d", F.col("coverage").cast("long"), F.col("n").cast("long")))
    return snps.select(chrom.alias("chrom"), "position", "base", line.alias("line"))


def vcf(snps: DataFrame, path: str, gzip: bool = False) -> None:
    """A folder of variant files: the header in the first, records in order over the others."""
    textsink.save(vcf_records(snps), path, "vcf", ["chrom", "position", "base"], gzip)


def vcf_lines(snps: DataFrame) -> DataFrame:
    """(line) of variant records, header first."""
    spark = snps.sparkSession
    top = spark.createDataFrame([("", i, "", h) for i, h in enumerate(textsink.VCF_HEADER)], "chrom string, position int, base string, line string")
    return top.union(vcf_records(snps).withColumn("position", F.col("position").cast("int"))).orderBy("chrom", "position", "base").select("line")


def newick(nodes: list[tuple[int, int, str]], root: int) -> str:
    """A small tree (one read's taxa: id, parent id, label) as Newick text."""
    children: dict[int, list[int]] = {}
    label = {i: name for i, _, name in nodes}
    for i, up, _ in nodes:
        if i != up and i != root:
            children.setdefault(up, []).append(i)

    def text(i: int) -> str:
        below = children.get(i)
        return (f"({','.join(text(c) for c in sorted(below))})" if below else "") + label[i]

    return text(root) + ";"


def indented(nodes: list[tuple[int, int, str]], root: int) -> str:
    children: dict[int, list[int]] = {}
    label = {i: name for i, _, name in nodes}
    for i, up, _ in nodes:
        if i != up and i != root:
            children.setdefault(up, []).append(i)
    out, stack = [], [(root, 0)]
    while stack:
        i, depth = stack.pop()
        out.append("  " * depth + label[i])
        stack += [(c, depth + 1) for c in sorted(children.get(i, []), reverse=True)]
    return "\n".join(out)
