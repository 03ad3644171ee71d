import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helixmill.llm.features import ngrams
from helixmill.llm.quality import BITS, ImportanceResampling, best_cut, fixed, kth_largest, log_ratio
from pyspark.sql import functions as F


def buckets(text):
    """Buckets of a text's words and pairs, word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    one = lambda t: ngrams(pa.array([t]), BITS)[0].tolist()
    return [b for x in w for b in one(x)] + [one(f"{x} {y}")[2] for x, y in zip(w, w[1:], strict=False)]


ROWS = [(i, f"good words number {i % 7} about cats and dogs") for i in range(60)] + [(100 + i, f"%%% $$$ {i % 5} ### junk &&&") for i in range(30)] + [(200, None), (201, ""), (202, "cats"), (None, "dogs and cats"), (203, "%%% ###"), (203, "%%% ###")]
LABELS = [(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 30, 2)] + [(0, 1), (None, 1), (101, None), (999, 0)]


def test_weights_equal_brute_force(spark):
    docs = spark.createDataFrame([(a, b, 0) for a, b in ROWS], "doc_id long, text string, gumbel int")
    op = ImportanceResampling().fit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int"))
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    good = {k for k, q in LABELS if q == 1 and k is not None}
    for k, t in ROWS:
        for b in buckets(t):
            raw[b] += 1
            target[b] += k in good
    ratio = log_ratio(target, raw)
    want = Counter((k, round(sum(ratio[b] for b in buckets(t)), 6)) for k, t in ROWS)
    got = op.transform(docs).collect()
    assert Counter((r.doc_id, round(r.log_weight, 6)) for r in got) == want
    kept = {r.doc_id for r in got if r.kept}
    assert kept >= set(range(60)) and not kept & set(range(100, 130)) and 203 not in kept
    assert Counter(r.doc_id for r in op.keep(docs).collect()) == Counter(r.doc_id for r in got if r.kept)
    assert op.keep(docs).columns == docs.columns
    reached = sum(r.log_weight >= op.cut for r in got)
    assert sum(r.kept for r in got) >= reached


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert ImportanceResampling().fit(none, labels).transform(none).count() == 0
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert ImportanceResampling().fit(docs, labels).transform(docs).filter("kept").count() == len(ROWS)


def test_kth_largest(spark):
    values = [1.5, -2.25, 1.5, 1e12, 0.0, None, -1e-9, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    order = sorted((r[0] for r in df.select(fixed("x")).collect() if r[0] is not None), reverse=True)
    assert [kth_largest(df, "x", k) for k in range(0, 9)] == [None, *order, None]


def test_best_cut():
    assert best_cut(np.array([1.0, 2, 3, 4]), np.array([False, False, True, True])) == 2.5
    assert best_cut(np.array([1.0]), np.array([True])) == -math.inf


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = ImportanceResampling().fit(docs, labels).transform(docs).join(labels, "doc_id")
    rate = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.99 and rate[0] < 0.02
    assert rate[1] == pytest.approx(1, abs=0.01)
