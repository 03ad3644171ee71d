"""Stored indexes in buckets, lookups of distinct keys, genes read from their own bytes."""

import pytest
from helixmill.functions.dna import Shape
from helixmill.operators import classify, index, kmers
from helixmill.sources import fastx, store, tables
from pyspark.sql import functions as F

SHAPE = Shape("XX_XX_XX")


def reads(spark, n=60, repeat=1):
    base = "ACGTTGCAACGGTCATTGCAAGGCTTACGGATCCATTACGGCAT"
    return spark.createDataFrame([(i % 7, f"r{i}", (base[i % 30 :] + base[: i % 11]) * repeat + ("N" if i % 5 == 0 else "")) for i in range(n)], "num int, read string, sequence string")


def test_places_give_the_rows_of_every_kmer(spark, monkeypatch):
    df = reads(spark)
    df = df.union(spark.createDataFrame([(1, "none", None), (2, "short", "ACG"), (3, None, "ACGTACGTAC")], df.schema)).repartition(3)
    rows = sorted(map(tuple, kmers.kmers(df, "sequence", SHAPE, ["num", "read"]).select("key", "num", "read", "pos").collect()), key=str)
    places = kmers.occurrences(df, "sequence", SHAPE, ["num", "read"])
    assert sorted(map(tuple, places.select("key", F.inline("at")).collect()), key=str) == rows
    assert places.count() < len(rows) / 2  # distinct keys, not k-mers
    assert kmers.occurrences(df.limit(0), "sequence", SHAPE, ["num"]).count() == 0


def test_lookup_of_a_stored_index_does_not_move_it(spark, tmp_path):
    df = reads(spark)
    rows = kmers.kmers(df, "sequence", SHAPE, ["read"]).filter("key % 3 <> 0")
    ix = rows.groupBy("key").agg(F.lit(5).alias("taxid"), F.lit(1).alias("gene_id"), F.min("pos").alias("gene_pos"))
    path = f"file://{tmp_path}/index"
    store.save(ix, path, "key", 4)
    spark.sql(f"DROP TABLE {store._name(path)}")  # as in another session
    held = store.load(spark, path)
    assert held.dtypes == ix.dtypes and held.exceptAll(ix).isEmpty() and ix.exceptAll(held).isEmpty()
    want = sorted(map(tuple, classify.lookup(kmers.kmers(df, "sequence", SHAPE, ["read"]), ix).select("read", "pos", "key", "taxid", "gene_pos").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = classify.lookup_places(kmers.occurrences(df, "sequence", SHAPE, ["read"]), held)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
        assert sorted(map(tuple, found.select("read", "pos", "key", "taxid", "gene_pos").collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(Exception, match="exist"):
        store.save(ix, path, "key", 4)


@pytest.mark.parametrize("size", [1, 30, 10_000])
def test_spans_of_sequences(spark, tmp_path, size):
    fastx.register(spark)
    text = ">5_1 x\nACGT\nAC\n\n>5_2\n>7_3\nGG\r\nTT\r\n>7_4\nT"
    (tmp_path / "r.fa").write_bytes(text.encode())
    got = spark.read.format("fastx_spans").option("splitBytes", size).load(str(tmp_path / "r.fa")).orderBy("start").collect()
    assert [(r.header, "".join(text[r.start : r.end].split())) for r in got] == [("5_1 x", "ACGTAC"), ("5_2", ""), ("7_3", "GGTT"), ("7_4", "T")]


def test_wanted_genes_cost_their_own_bytes(spark, tmp_path):
    genes = {(t, g): "ACGGT" * (200_000 if (t, g) == (3, 1) else 20 + t + g) for t in range(1, 9) for g in (1, 2)}
    path = tmp_path / "ref.fa"
    path.write_text("".join(f">{t}_{g}\n" + "\n".join(s[i : i + 70] for i in range(0, len(s), 70)) + "\n" for (t, g), s in genes.items()))
    tables.write_reference_map(spark, str(path), str(tmp_path / "map"))
    known = tables.reference_map(spark, str(tmp_path / "map"))
    assert known.count() == 16
    got = tables.mapped_genes(str(path), known.filter("taxid in (2, 8)")).collect()
    assert {(r.taxid, r.gene_id): r.sequence for r in got} == {k: s for k, s in genes.items() if k[0] in (2, 8)}
    assert 0 < sum(r.bytes_read for r in got) < 4000 < path.stat().st_size
    whole = tables.mapped_genes(str(path), known).collect()
    assert {(r.taxid, r.gene_id): r.sequence for r in whole} == genes
    odd = spark.createDataFrame([(1, 1, None, None), (1, 2, 5, 5)], "taxid long, gene_id long, start long, end long")
    assert {r.sequence for r in tables.mapped_genes(str(path), odd).collect()} == {""}
    with pytest.raises(Exception, match="ends before"):
        tables.mapped_genes(str(path), spark.createDataFrame([(1, 1, 0, 1 << 40)], odd.schema)).collect()


def test_search_history(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("shape\t0.9_sens\t1_sens\t0.9_hits\t1_hits\nXX_X\t0.5\t1\t0.25\tx\n")
    assert [tuple(r) for r in tables.shape_history(spark, str(tmp_path / "h.tsv")).collect()] == [("XX_X", "0.9", 0.5, 0.25), ("XX_X", "1", 1.0, None)]
