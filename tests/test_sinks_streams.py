"""Text sinks that leave nothing behind, and streams of read files."""

import gzip

import pytest
from helixmill.sources import fastx, sinks, tables, textsink
from helixmill.streaming import reads
from pyspark.sql import functions as F


def texts(folder):
    out = []
    for p in sorted(folder.glob("part-*")):
        out.append(gzip.decompress(p.read_bytes()).decode() if p.name.endswith(".gz") else p.read_text())
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_records_in_order_and_read_back(spark, tmp_path, packed):
    rows = spark.range(500).select(F.format_string("r%03d", F.col("id")).alias("header"), F.repeat(F.lit("ACGT"), 3).alias("sequence"), F.repeat(F.lit("IIII"), 3).alias("quality")).repartition(7)
    sinks.fasta(rows, str(tmp_path / "fa"), ["header"], packed)
    got = "".join(texts(tmp_path / "fa"))
    assert got == "".join(f">r{i:03d}\nACGTACGTACGT\n" for i in range(500))
    sinks.fastq(rows, str(tmp_path / "fq"), packed)
    fastx.register(spark)
    back = spark.read.format("fastx").load(str(tmp_path / "fq"))
    assert back.count() == 500 and back.filter("length(quality) = 12").select("id").distinct().count() == 500
    assert not [p for p in (tmp_path / "fq").iterdir() if p.name.startswith("_")]
    sinks.fastq(rows.limit(3), str(tmp_path / "fq"), packed)  # appended
    assert spark.read.format("fastx").load(str(tmp_path / "fq")).count() == 503


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 4).select(F.col("id").cast("string").alias("header"), F.when(F.col("id") == 900, F.raise_error(F.lit("stop here"))).otherwise("A").cast("string").alias("sequence"))
    with pytest.raises(Exception, match="stop here"):
        textsink.save(rows, str(tmp_path / "out"), "fasta")
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="quality"):
        rows.write.format("records").option("kind", "fastq").mode("append").save(str(tmp_path / "out"))


def test_variant_files_have_one_header(spark, tmp_path):
    snps = spark.range(50).select(F.lit(5).alias("taxid"), F.lit(2).alias("gene_id"), (F.col("id") * 7 % 50).cast("int").alias("position"), F.lit("A").alias("reference"), F.lit("C").alias("base"), F.lit(3).alias("n"), F.lit(7).alias("coverage")).repartition(4)
    sinks.vcf(snps, str(tmp_path / "v"))
    lines = "".join(texts(tmp_path / "v")).splitlines()
    assert lines[:4] == textsink.VCF_HEADER and lines == [r.line for r in sinks.vcf_lines(snps).collect()]
    textsink.save(sinks.vcf_records(snps.limit(1)), str(tmp_path / "v"), "vcf", mode="overwrite")
    assert len("".join(texts(tmp_path / "v")).splitlines()) == 5


def test_tables_of_a_profile(spark, tmp_path):
    t = spark.createDataFrame([(5, 9, 90, 3, 4, 3.5, 0.95)], "taxid int, reads long, bases long, present_genes long, n_genes long, expected_genes double, median_ani double")
    sinks.raw_taxa(t, str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).collect()] == [("5", "9", "90", "3", "4", "3.5", "0.95")]
    sinks.corrections(spark.createDataFrame([(5, 2, 0.25)], "taxid int, gene_id int, factor double"), str(tmp_path / "c"))
    assert [tuple(r) for r in tables.corrections(spark, str(tmp_path / "c")).collect()] == [(5, 2, 0.25)]


def test_arriving_files_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def drained():
        q = reads.arriving_files(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.read for r in spark.read.schema("read string, sequence string").parquet(str(tmp_path / "out")).collect())

    (folder / "a.fq").write_text("@a1\nAC\n+\nII\n@a2\nac\n+\nII\n")
    assert drained() == ["a1", "a2"]
    with gzip.open(folder / "b.fa.gz", "wt") as f:
        f.write(">b1\nACGT\n")
    with open(folder / "a.fq", "a") as f:
        f.write("@a3\nGG\n+\nII\n")
    (folder / "c.txt").write_text("no reads")
    assert drained() == ["a1", "a2", "a3", "b1"]  # after a restart: what is new, once
    assert drained() == ["a1", "a2", "a3", "b1"]


def test_offsets_of_files():
    r = fastx.FastxStreamReader({"path": "x", "splitBytes": "10"})
    assert [(p.path, p.start, p.end) for p in r.partitions({"a.fq": 5}, {"a.fq": 17, "b.fq.gz": 3})] == [("a.fq", 5, 15), ("a.fq", 15, 17), ("b.fq.gz", 0, None)]
    assert [p.path for p in r.partitions({"a.fq": 5}, {"a.fq": 5})] == [""]
    for start, end in (({"a.fq": 9}, {"a.fq": 5}), ({"a.fq.gz": 5}, {"a.fq.gz": 9})):
        with pytest.raises(fastx.MalformedRecord):
            r.partitions(start, end)
