"""Cases that no query shows: long chains, cycles, long sequences, hot groups, foreign tables, runs from files to files."""

import math
import random

import pytest
from helixmill import modes, staging
from helixmill.functions import text, version
from helixmill.functions.dna import Shape
from helixmill.operators import intervals, kmers, profile, shapes, taxonomy, variants
from helixmill.options import Options
from helixmill.plans import catalog
from helixmill.sources import results
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def test_closure_of_a_chain_of_a_hundred(spark):
    chain = spark.createDataFrame([(i, max(i - 1, 1), "x") for i in range(1, 101)], "id int, parent_id int, rank string")
    got = {(r.id, r.ancestor_id): r.distance for r in taxonomy.closure(chain).collect()}
    assert got == {(i, j): i - j for i in range(1, 101) for j in range(1, i + 1)}
    assert taxonomy.closure(chain.limit(0)).count() == 0


def test_closure_refuses_cycles(spark):
    with pytest.raises(ValueError):
        taxonomy.closure(spark.createDataFrame([(1, 1), (2, 4), (3, 2), (4, 3)], "id int, parent_id int"))


def test_choose_is_exact(spark):
    asked = [(62, 31), (64, 32), (66, 33), (5, 0), (5, 6), (5, -1), (40, 38), (1, 1)]
    got = spark.createDataFrame(asked, "n int, k int").select("n", "k", text.choose("n", "k").alias("c")).collect()
    assert all(r.c == (math.comb(r.n, r.k) if r.k >= 0 else 0) for r in got)


def test_long_sequence_and_pieces(spark):
    rng = random.Random(3)
    s = "".join(rng.choices("ACGT", k=600_000))
    shape = Shape("XX_XX")
    df = spark.createDataFrame([(7, s)], "id int, s string")
    whole = kmers.kmers(df, "s", shape, ["id"])
    assert whole.count() == len(s) - 4
    cut = kmers.kmers(kmers.pieces(df, "s", shape, 1000), "s", shape, ["id", "start"]).select("id", (F.col("start") + F.col("pos")).alias("pos"), "key")
    assert cut.count() == whole.count() and cut.exceptAll(whole.select("id", "pos", "key")).isEmpty()
    counts = kmers.counted(df, "s", shape, ["id"]).groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_forward").alias("f"))
    both = kmers.kmers(df, "s", shape, ["id"], strands=True).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fw") < F.col("rv")).alias("f"))
    assert counts.exceptAll(both).isEmpty() and both.exceptAll(counts).isEmpty()


def test_letters_of_several_bytes_and_unknown_ones(spark):
    df = spark.createDataFrame([(1, "ACéGT"), (2, "ACNGT"), (3, "ACAGT")], "id int, s string")
    rows = kmers.kmers(df, "s", Shape("XX"), ["id"]).collect()
    assert [[r.pos for r in rows if r.id == i] for i in (1, 2)] == [[0, 3], [0, 3]]
    filled = {(r.id, r.pos): r.key for r in kmers.kmers(df, "s", Shape("XX"), ["id"], unknown_as="A").collect()}
    assert all(filled[2, p] == filled[3, p] for p in range(4))
    with pytest.raises(ValueError):
        kmers.kmers(df.withColumnRenamed("id", "pos"), "s", Shape("XX"), ["pos"])


def test_prefix_estimate_is_near(spark):
    sf = "/root/testdata/sf0.001"
    catalog.load()
    exact = {r.prefix: r.n_distinct for r in catalog.QUERIES["kmer_histogram"](spark, sf).collect()}
    got = {r.prefix: r.n_distinct for r in catalog.QUERIES["kmer_prefix_estimate"](spark, sf).collect()}
    assert set(got) == set(exact) and all(abs(got[p] - n) <= max(3, 0.1 * n) for p, n in exact.items())


def test_merge_across_stretches(spark):
    w = intervals.STRETCH
    rows = [(1, w - 5, w + 5), (1, w + 5, w + 9), (1, 3 * w, 5 * w + 1), (1, 4 * w, 4 * w + 2), (1, 5 * w + 1, 5 * w + 2), (2, 0, 1)]
    got = sorted(tuple(r) for r in intervals.merge(spark.createDataFrame(rows, "g int, start int, end int"), ["g"]).select("g", "start", "end", "n").collect())
    assert got == [(1, w - 5, w + 9, 2), (1, 3 * w, 5 * w + 2, 3), (2, 0, 1, 1)]


def test_drop_all_keeps_foreign_tables(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("stage_user_data")
    mine = staging.written_by(spark.range(5), "id", 2)
    assert mine.count() == 5
    names = list(staging._named(spark))
    staging.drop_all(spark)
    left = {t.name for t in spark.catalog.listTables()}
    assert "stage_user_data" in left and not left & set(names)
    spark.sql("DROP TABLE stage_user_data")


def test_versions_and_options(spark, tmp_path):
    pairs = [("1.2", "1.10"), ("2", "1.9.9.9"), ("1.2.3.4", "1.2.3.4"), ("x", "0.0.1"), ("1..2", "0.0.0.1")]
    got = spark.createDataFrame(pairs, "a string, b string").select((version.version("a") < version.version("b")).alias("less")).collect()
    assert [r.less for r in got] == [version.parse(a) < version.parse(b) for a, b in pairs] == [True, False, False, True, True]
    empty = tmp_path / "empty.fa"
    empty.write_text("")
    wrong = Options(Shape("XXXX"), reads=[str(empty), str(tmp_path / "none.fq")], taxid_bits=50, share=1.5, strategy="other").wrong(spark)
    assert len(wrong) == 6
    with pytest.raises(ValueError):
        Options(Shape("XXXX")).check(spark)
    assert Options(Shape("X" * 12)).check(spark)


def test_synthetic_reads(spark):
    fixed = shapes.synthetic_reads(spark, 50, 40, mutations=5)
    assert {r["count"] for r in fixed.distinct().groupBy("read").count().collect()} == {5} and fixed.filter("position not between 0 and 39").isEmpty()
    n = shapes.synthetic_reads(spark, 400, 90, rate=0.05, third=0.8).count()
    assert abs(n / (400 * 90) - 0.05) < 0.005


def test_sensitivity_grows_with_the_limit(spark):
    shape = Shape("XX_XX")
    got = shapes.sensitivity_by_limit(spark, variants.train(spark, shape, 8), shape, 8, [1, 3], [1, 8], length=40, reads=60).collect()
    by = {(r.mutations, r.told_at_most): r.sensitivity for r in got}
    assert by[1, 8] > 0.5 and by[3, 8] >= by[3, 1]


def test_shape_file_and_history(spark, tmp_path):
    (tmp_path / "shape.txt").write_text("# a comment\nXX_X|X_XX\n")
    assert shapes.load(spark, str(tmp_path / "shape.txt")).text == "XX_XX_XX"
    shapes.save(variants.train(spark, Shape("X_X"), 4), [("X_X", 0.5)], str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out" / "history"), sep="\t", header=True).first().shape == "X_X"


def test_profile_rows(spark):
    ab = spark.createDataFrame([(2, 0.25), (3, 0.75), (10, 1.0), (1, 1.0)], "id int, abundance double")
    nodes = spark.createDataFrame([(2, "species", True), (3, "species", True), (10, "genus", False), (1, "root", False)], "id int, rank string, leaf boolean")
    lineage = spark.createDataFrame([(2, "10|2", "g|a"), (3, "10|3", "g|b"), (10, "10|", "g|"), (1, "|", "|")], "id int, taxpath string, namepath string")
    got = profile.profile_rows(ab, nodes, lineage, ["genus", "species"]).orderBy("place", F.desc("percentage")).collect()
    assert [(r.taxid, r.rank, r.taxpath) for r in got] == [("3.1", "strain", "10|3"), ("2.1", "strain", "10|2"), ("3", "species", "10|3"), ("2", "species", "10|2"), ("10", "genus", "10"), ("1", "root", "")]


def test_from_files_to_profile(spark, tmp_path):
    rng = random.Random(8)
    genes = {(t, g): "".join(rng.choices("ACGT", k=400)) for t in (2, 3) for g in (1, 2, 3)}
    (tmp_path / "ref.fa").write_text("".join(f">{t}_{g}\n{s}\n" for (t, g), s in genes.items()))
    nodes = spark.createDataFrame([(1, 1, "root"), (10, 1, "genus"), (2, 10, "species"), (3, 10, "species")], "id int, parent_id int, rank string")
    comp = str.maketrans("ACGT", "TGCA")
    first, second, where = [], [], {}
    for i in range(40):
        t, g = (2, 1 + i % 3)
        at = rng.randint(0, 200)
        a, b = genes[t, g][at : at + 80], genes[t, g][at + 90 : at + 170][::-1].translate(comp)
        if i == 0:
            base = "ACGT"[("ACGT".index(a[40]) + 1) % 4]
            a, where[0] = a[:40] + base + a[41:], (g, at + 40, base)
        if i == 1:
            base = "ACGT"[("ACGT".index(b[40]) + 1) % 4]
            b, where[1] = b[:40] + base + b[41:], (g, at + 169 - 40, base.translate(comp))
        first.append(f"@r{i}/1\n{a}\n+\n{'I' * 80}\n")
        second.append(f"@r{i}/2\n{b}\n+\n{'I' * 80}\n")
    (tmp_path / "s_1.fq").write_text("".join(first))
    (tmp_path / "s_2.fq").write_text("".join(second))
    shape = Shape("XXX_X_XX_X_XXX")
    db, out = str(tmp_path / "db"), str(tmp_path / "out")
    modes.build(spark, str(tmp_path / "ref.fa"), nodes, shape, db, ["genus", "species"], bits=12)
    modes.classify(spark, db, str(tmp_path / "s_1.fq"), out, str(tmp_path / "s_2.fq"), ranks=["genus", "species"])
    rows = results.classification(spark, f"{out}/classification").collect()
    assert len(rows) == 80 and {r.taxid for r in rows} == {2} and all(r.overlap == 80 for r in rows)
    told = {(r.gene_id, r.position, r.base) for r in results.snps(spark, f"{out}/snps").collect()}
    assert told == set(where.values())
    found = {(r.id, r.rank): r.abundance for r in modes.profiled(spark, db, out, reads=10).collect()}
    assert found == {(2, "species"): 1.0, (10, "genus"): 1.0}
    bad = results.as_classification(spark.createDataFrame([(1, 121)], "record_id long, gene_id int"))
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(PySparkException):
        results.classification(spark, str(tmp_path / "bad")).collect()


def test_stream_equals_batch(spark, tmp_path):
    from helixmill.operators import classify, index
    from helixmill.streaming import reads as stream

    rng = random.Random(5)
    shape = Shape("XXX_XX_XXX")
    genes = [(t, 10, 1, "".join(rng.choices("ACGT", k=200))) for t in (2, 3)]
    rows = kmers.kmers(spark.createDataFrame(genes, "species int, genus int, gene_id int, s string"), "s", shape, ["species", "genus", "gene_id"])
    index.build(rows, ["genus", "species"]).write.parquet(str(tmp_path / "index"))
    ix = spark.read.parquet(str(tmp_path / "index"))
    lineages = spark.createDataFrame([(1, None, None), (10, 10, None), (2, 10, 2), (3, 10, 3)], "id int, genus int, species int")
    given = [(f"r{i}", genes[i % 2][3][i : i + 60]) for i in range(20)]
    for part in range(2):
        spark.createDataFrame(given[part::2], "read string, sequence string").write.parquet(str(tmp_path / "in" / f"p{part}"))
    (tmp_path / "flat").mkdir()
    for n, f in enumerate(sorted((tmp_path / "in").rglob("*.parquet"))):
        f.rename(tmp_path / "flat" / f"{n}.parquet")
    arriving = stream.arriving(spark, str(tmp_path / "flat"), files_at_once=1)
    q = stream.classified(arriving, ix, lineages, ["genus", "species"], shape, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    q.awaitTermination()
    got = {(r.read, r.taxid, r.path_hits) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    all_of = spark.createDataFrame(given, "read string, sequence string")
    want = classify.assign(classify.read_taxa(classify.lookup(kmers.kmers(all_of, "sequence", shape, ["read"]), ix), "read"), "read", "descent", lineages=lineages, ranks=["genus", "species"])
    assert got == {(r.read, r.taxid, r.path_hits) for r in want.collect()} and len(got) == 20
    q = stream.running_hits(arriving, ix, shape).writeStream.format("memory").queryName("hits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.taxid, r.hits) for r in spark.table("hits").collect()} == {(r.taxid, r.hits) for r in stream.running_hits(all_of, ix, shape).collect()}


def test_inner_support_goes_to_the_first_leaf_that_agrees(spark):
    from helixmill.operators import classify

    closed = taxonomy.closure(spark.createDataFrame([(1, 1), (10, 1), (11, 1), (2, 10), (3, 10), (4, 11)], "id int, parent_id int"))
    schema = "read string, pos int, taxid int, gene_id int, gene_pos int"
    leaf = spark.createDataFrame([("r", 0, 3, 1, 50), ("r", 4, 2, 1, 54), ("r", 5, 4, 1, 55), ("r", 6, 2, 2, 90)], schema)
    # agrees with 3 and 2 (3 comes first in the read); wrong offset; another gene; reverse offset of gene 2; no ancestor of any
    inner = spark.createDataFrame([("r", 7, 10, 1, 57), ("r", 8, 10, 1, 70), ("r", 9, 10, 3, 59), ("r", 10, 1, 2, 86), ("r", 11, 12, 1, 61)], schema)
    got = classify.inner_support(inner, classify.fold_offsets(leaf, "read"), closed, "read").collect()
    assert {(r.taxid, r.gene_id, r.inner) for r in got} == {(3, 1, 1), (2, 2, 1)}
