"""Faults that showed on larger tables only."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from helixmill.functions.dna import Shape
from helixmill.operators import classify, kmers, taxonomy, variants
from helixmill.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.load()


def equals_sql(spark, name, folder, tables):
    """The query's rows on tables of a folder, others of SF, which are those of its SQL."""
    con = duckdb.connect()
    for t in {"documents", "benchmark"} - set(tables):
        (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    got = con.execute(catalog.ORACLES[name])
    rows = sorted((tuple(r) for r in df.select(*[d[0] for d in got.description]).collect()), key=str)
    assert rows == sorted(got.fetchall(), key=str)
    return df


@pytest.mark.parametrize("mates", [None, ["hits_1", "hits_2"]])
def test_share_is_exact(spark, mates):
    rows = []
    for r, total in enumerate([10, 90, 170, 180, 340, 1000]):
        most = total * 7 // 10
        rows += [(r, 2, most, most, 0), (r, 3, total - most, total - most, 0), (100 + r, 2, most + 1, most + 1, 0), (100 + r, 3, total - most - 1, total - most - 1, 0)]
    taxa = spark.createDataFrame(rows, "doc_id int, taxid int, hits long, hits_1 long, hits_2 long")
    lineages = spark.createDataFrame([(2, 2), (3, 3)], "id int, species int")
    got = classify.descend(taxa, lineages, ["species"], "doc_id", mates=mates)
    assert {r.doc_id for r in got.collect()} == {100 + r for r in range(6)}


def test_common_ancestors_keep_a_row_for_each_pair(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 1), (8, 8), (9, 8)], "id int, parent_id int")
    pairs = spark.createDataFrame([(3, 4), (3, 4), (4, 5), (3, 3), (2, 3), (3, 2), (1, 5), (3, 9), (9, 8), (7, 3), (None, 3)], "a int, b int")
    got = taxonomy.common_ancestors(pairs, taxonomy.closure(nodes))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5, 1), (2, 3, 2), (3, 2, 2), (3, 3, 3), (3, 4, 2), (4, 5, 1), (9, 8, 8)]
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner, (" in line and ("a#" in line or "b#" in line)]
    assert joins and not any("ancestor_id" in line for line in joins)


@pytest.mark.parametrize("longest", [1 << 22, 500])
def test_keys_of_a_sequence_are_not_shuffled(spark, tmp_path, monkeypatch, longest):
    monkeypatch.setattr(kmers, "LONG", longest, raising=False)
    twice = f"(SELECT * FROM '{SF}/documents.parquet' UNION ALL BY NAME SELECT * REPLACE (doc_id + 1 AS doc_id) FROM '{SF}/documents.parquet' WHERE doc_id % 50 = 0 UNION ALL BY NAME SELECT * REPLACE (NULL AS doc_id) FROM '{SF}/documents.parquet' WHERE doc_id % 70 = 1 UNION ALL BY NAME SELECT * REPLACE (doc_id + 1000 AS doc_id, CASE WHEN doc_id = 3 THEN NULL ELSE 'short one' END AS text) FROM '{SF}/documents.parquet' WHERE doc_id < 9)"
    duckdb.connect().execute(f"COPY {twice} TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    equals_sql(spark, "kmer_extract", tmp_path, ["documents"])
    plain = catalog.QUERIES["kmer_extract"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plain.split("\n") if "Exchange" in line]
    assert longest == 500 or moved and not any("key#" in line for line in moved)


def test_counting_keys_takes_bounded_memory(monkeypatch):
    class Frame:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(kmers, "_rows", lambda *a: Frame())
    run = kmers.counted(None, "s", Shape("XXXX_XX__XX_XXXX"))
    text = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(1).integers(0, 4, 9_000_000)].tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([text[i : i + 3000] for i in range(0, len(text), 3000)], pa.binary())], ["_sequence"])
    tracemalloc.start()
    n = sum(pa.compute.sum(b.column("n")).as_py() for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 3000 * (3000 - 15) and peak < 90e6


def test_only_hits_are_rows_of_windows(spark):
    """call_hits() tells what call() does from all k-mers, and hit_pattern_call moves no misses."""
    rng = np.random.default_rng(2)
    shape = Shape("XXXX_XX__XX_XXXX")
    rows = [(d, p, bool(h)) for d, n in enumerate([3, 6, 7, 40, 300, 600]) for p, h in enumerate(rng.random(n) < [0.5, 0.8][d % 2])]
    rows += [(9, p, p % 11 > 0) for p in range(50)]
    every = spark.createDataFrame(rows, "doc_id int, pos int, hit boolean")
    table = variants.train(spark, shape, 6)
    want = {tuple(r) for r in variants.call(every, table, "doc_id", shape, 6).collect()}
    sizes = every.groupBy("doc_id").count().withColumnRenamed("count", "n_kmers")
    got = variants.call_hits(every.filter("hit").drop("hit"), sizes, table, "doc_id", shape, 6).collect()
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)
    plan = catalog.QUERIES["hit_pattern_call"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "key#" not in plan


def test_hit_patterns_of_shared_ids(spark, tmp_path):
    twice = f"(SELECT * FROM '{SF}/documents.parquet' UNION ALL BY NAME SELECT * REPLACE (doc_id + 1 AS doc_id) FROM '{SF}/documents.parquet' WHERE doc_id % 20 = 0)"
    duckdb.connect().execute(f"COPY {twice} TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    equals_sql(spark, "hit_pattern_call", tmp_path, ["documents"])


@pytest.mark.parametrize("name", ["snp_call", "classification_rows", "classification_debug"])
def test_only_kmers_in_the_gene_move(spark, tmp_path, name):
    twice = f"(SELECT * FROM '{SF}/documents.parquet' UNION ALL BY NAME SELECT * REPLACE (doc_id + 1000 AS doc_id, left(text, 30 + doc_id % 90) AS text) FROM '{SF}/documents.parquet')"
    duckdb.connect().execute(f"COPY {twice} TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    df = equals_sql(spark, name, tmp_path, ["documents"])
    assert "documents.parquet" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["placement_vote", "ambiguous_placements", "mate_hits"])
def test_hits_meet_in_a_set_number_of_partitions(spark, tmp_path, name):
    plan = equals_sql(spark, name, tmp_path, [])._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    below = plan[plan.index("REPARTITION_BY_NUM") : plan.index("MapInArrow")]
    assert "Aggregate" not in below and "Sort" not in below
