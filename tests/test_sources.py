import gzip

import pytest
from helixmill.sources import fastx, sinks, tables
from helixmill.sources.samples import Sample, discover, interleaved

FASTA = ">a first\nACGT\nAC\n\n>b\nGG>TT\n>c\n\n>d last\nT"


def fastq(n):
    return "".join(f"@r{i}/1 x\n{'ACGT' * (i % 5 + 1)}\n+\n{'@+II' * (i % 5 + 1)}\n" for i in range(n))


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_fasta_splits(spark, tmp_path, size):
    fastx.register(spark)
    (tmp_path / "x.fa").write_text(FASTA)
    got = spark.read.format("fastx").option("splitBytes", size).load(str(tmp_path / "x.fa")).orderBy("offset").collect()
    assert [(r.id, r.header, r.sequence, r.quality) for r in got] == [("a", "a first", "ACGTAC", None), ("b", "b", "GG>TT", None), ("c", "c", "", None), ("d", "d last", "T", None)]


@pytest.mark.parametrize("size", [37, 100, 10_000])
def test_fastq_splits_and_gzip(spark, tmp_path, size):
    fastx.register(spark)
    text = fastq(40)
    (tmp_path / "a.fq").write_text(text)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    got = spark.read.format("fastx").option("splitBytes", size).load(str(tmp_path)).collect()
    assert len(got) == 80 and len({(r.file, r.offset) for r in got}) == 80
    assert sorted(r.id for r in got) == sorted(f"r{i}/1" for i in range(40) for _ in range(2))
    assert all(len(r.sequence) == len(r.quality) and r.sequence == "ACGT" * (len(r.sequence) // 4) for r in got)


def test_malformed(spark, tmp_path):
    fastx.register(spark)
    for name, text in (("a.fq", "@a\nAC\n+\nI\n"), ("b.fq", "plain\n"), ("c.fq", "@a\nAC\n+\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="record|begins"):
            spark.read.format("fastx").load(str(tmp_path / name)).collect()
    (tmp_path / "e.fa").write_text("")
    assert spark.read.format("fastx").load(str(tmp_path / "e.fa")).count() == 0


def test_tables(spark, tmp_path):
    p = tmp_path / "t"
    p.write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n")
    assert [tuple(r) for r in tables.nodes_dump(spark, str(p)).collect()] == [(1, 1, "no rank"), (2, 1, "genus")]
    p.write_text("2\t|\tb\t|\t\t|\tsynonym\t|\n2\t|\tz\t|\t\t|\tscientific name\t|\n3\t|\tq\t|\t\t|\tsynonym\t|\n3\t|\tc\t|\t\t|\tsynonym\t|\n")
    assert sorted(tuple(r) for r in tables.names_dump(spark, str(p)).collect()) == [(2, "z"), (3, "c")]
    p.write_text("id\tparent_id\texternal_id\tname\trank\tlevel\n1\t1\t9\troot\tno rank\t0\tG1\n")
    assert tables.taxonomy(spark, str(p)).first().rep_genome == "G1"
    p.write_text("5\t2\t300\n")
    assert tuple(tables.gene_lengths(spark, str(p)).first()) == (5, 2, 300)
    p.write_text("k = v=w\nnone\n")
    assert [tuple(r) for r in tables.key_values(spark, str(p)).collect()] == [("k", "v=w")]
    p.write_text("5 1 4\n6\n")
    assert [(r.pattern, r.mutations) for r in tables.pattern_text(spark, str(p)).collect()] == [(5, [1, 4]), (6, [])]
    p.write_text("7\n\n8\n")
    assert [r.taxid for r in tables.true_ids(spark, str(p)).collect()] == [7, 8]


def test_samples():
    assert discover(["d/x_2.fq", "d/x_1.fq", "d/y.fq.gz"]) == [Sample("x", "d/x_1.fq", "d/x_2.fq"), Sample("y", "d/y.fq.gz")]
    assert interleaved(["a/1", "a/2", "b/1", "b/2"]) and not interleaved(["a/1", "b/1"]) and not interleaved([])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b_2", "GG"), ("a_1", "AC")], "header string, sequence string")
    sinks.fasta(rows, str(tmp_path / "fa"), ["header"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "fa").glob("part-*")))
    assert text == ">a_1\nAC\n>b_2\nGG\n"
    sinks.classified_and_not(rows, rows.filter("sequence = 'GG'"), "header", str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split/unclassified")).first().header == "a_1"
    snps = spark.createDataFrame([(5, 2, 9, "A", "C", 3, 7)], "taxid int, gene_id int, position int, reference string, base string, n int, coverage int")
    assert sinks.vcf_lines(snps).collect()[-1].line == "5_2\t10\t.\tA\tC\t.\tPASS\tDP=7;AC=3"
    shares = spark.createDataFrame([(7, "genus", "g", 60.0), (3, "phylum", "p", 100.0), (8, "genus", "h", 40.0)], "taxid int, rank string, name string, percentage double")
    lines = [r.line for r in sinks.profile_lines(shares, "s", ["phylum", "genus"]).collect()]
    assert lines[0] == "@SampleID:s" and [x.split("\t")[0] for x in lines[5:]] == ["3", "7", "8"]
    assert sinks.newick([(1, 1, "root"), (2, 1, "a"), (3, 1, "b"), (4, 2, "c")], 1) == "((c)a,b)root;"
    assert sinks.indented([(1, 1, "root"), (2, 1, "a"), (4, 2, "c")], 1) == "root\n  a\n    c"
    sinks.table(rows, str(tmp_path / "t"))
    sinks.table(rows.limit(0), str(tmp_path / "t"), mode="ignore")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
