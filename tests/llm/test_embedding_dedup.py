import numpy as np
import pytest
from helixmill.llm import embedding_dedup
from helixmill.llm.embedding_dedup import EmbeddingDedup
from pyspark.sql import functions as F


def brute(rows, threshold=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for d in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == d]
        x = np.array([rows[i][1] for i in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked[np.ix_(own, own)] = (x @ x.T >= threshold) & ~np.eye(len(own), dtype=bool)
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(linked[i]))]) for i in range(n)]
        if new == comp:
            break
        comp = new
    low = {}
    for i, c in enumerate(comp):
        low[c] = min(low.get(c, rows[i][0]), rows[i][0])
    return {rows[i][0]: (int(linked[i].sum()), low[comp[i]]) for i in range(n)}


def test_equals_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(16).astype(np.float32).tolist()) for i in range(500)]
    for base, n, noise in ((3, 300, 0.1), (7, 30, 0.25), (11, 3, 0.2), (20, 5, 0.0)):
        rows += [(1000 * base + i, (np.array(rows[base][1]) + noise * r.standard_normal(16)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(90001, None), (90002, [0.0] * 16), (90003, [1.0, None] * 8), (90004, [float("nan")] + [1.0] * 15), (90005, [float("inf")] + [1.0] * 15), (90006, [1.0, 0.0]), (90007, [2.0, 0.0]), (90008, []), (90009, rows[0][1])]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<float>, label int")
    op = EmbeddingDedup()
    got = {x.vec_id: (x.n_links, x.component_id) for x in op(docs).collect()}
    assert got == brute(rows)
    assert op.recall == 1.0


def test_nulls_repeats_and_empty(spark):
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 1.0])]
    got = EmbeddingDedup()(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in got), key=str) == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (5, 0, 5, True)], key=str)
    assert EmbeddingDedup()(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_audit_sees_missed_pairs_beside_a_dense_group(spark):
    r = np.random.default_rng(1)
    dense = r.standard_normal(32) + 0.02 * r.standard_normal((400, 32))
    pairs = np.repeat(r.standard_normal((400, 32)), 2, 0) + 0.02 * r.standard_normal((800, 32))
    vecs = np.concatenate([dense, pairs]).astype("<f4")
    classes = spark.createDataFrame([(f"{i:04d}", bytearray(v.tobytes()), 1) for i, v in enumerate(vecs)], "cls string, vec binary, copies long")
    op = EmbeddingDedup()
    op.kind = "<f4"
    found = [(f"{i:04d}", 399) for i in range(400)]
    assert op._audit(classes, spark.createDataFrame(found, "cls string, n long"), len(vecs)) < 0.1
    found += [(f"{i:04d}", 1) for i in range(400, 1200)]
    assert op._audit(classes, spark.createDataFrame(found, "cls string, n long"), len(vecs)) == 1.0
    assert op._audit(classes, spark.createDataFrame(found[:-80], "cls string, n long"), len(vecs)) == pytest.approx(0.9, abs=0.05)


def test_tables_grow_with_hyperplanes():
    for n in (10_000, 1_000_000, 10_000_000):
        bits = np.ceil(np.log2(n / embedding_dedup.CELL))
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** embedding_dedup.tables_for(n, 0.9) <= 1e-3
    assert embedding_dedup.tables_for(0, 0.9) == embedding_dedup.tables_for(10, 1.0) == embedding_dedup.TABLES


def test_no_links_below_the_target(spark, monkeypatch):
    monkeypatch.setattr(EmbeddingDedup, "_audit", lambda *a: 0.5)
    monkeypatch.setattr(embedding_dedup, "ATTEMPTS", 1)
    rows = [(i, [1.0, float(i)]) for i in range(4)]
    with pytest.raises(RuntimeError, match="recall"):
        EmbeddingDedup()(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("noise", [0.005, 0.12, 0.3])
def test_links_of_a_large_component_are_exact(spark, noise):
    """All of it near the root, about the threshold apart, and mostly apart."""
    r = np.random.default_rng(3)
    base = r.standard_normal(8)
    x = (base + noise * np.linalg.norm(base) * r.standard_normal((700, 8))).astype("<f4")
    rows = [(f"{i:04d}", bytearray(v.tobytes()), 1 + i % 3) for i, v in enumerate(x)]
    op = EmbeddingDedup()
    op.kind = "<f4"
    classes = spark.createDataFrame(rows, "cls string, vec binary, copies long")
    roots = spark.createDataFrame([(c, "0000") for c, *_ in rows[1:]], "vertex string, root string")
    got = {g.cls: g.n for g in op._links(classes, roots).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want = linked @ np.array([c for *_, c in rows])
    assert [got[f"{i:04d}"] for i in range(700)] == want.tolist()
    sure = op._ringed(classes.withColumn("root", F.lit("0000")), classes)
    if noise == 0.005:
        assert sure.filter("size(others) > 0").isEmpty()
