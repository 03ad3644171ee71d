import numpy as np
import pytest
from helixmill.llm.toxicity import OrdinalToxicity
from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while birds sing".split()


def text(r, bad=0):
    w = [WORDS[i] for i in r.integers(0, len(WORDS), 30)]
    for _ in range(bad):
        w[r.integers(0, 30)] = "idiot"
    return " ".join(w)


def test_grades(spark):
    r = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(300):
        g = max(0, i % 6 - 3)
        rows.append((i, text(r, 0 if g == 0 else 1 if g == 1 else 8), "x"))
        labels.append((i, g))
    rows += [(None, None, "x"), (900, "", "x"), (901, "idiot idiot idiot idiot idiot idiot", "x"), (901, "idiot idiot idiot idiot idiot idiot", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    op = OrdinalToxicity().fit(docs, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int"))
    assert len(op.t) == 2 and op.t[0] < op.t[1]
    got = op.transform(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        assert 0 <= x.p2 <= x.p1 <= 1 and abs(x.severity - x.p1 - x.p2) < 1e-12
    mean = [np.mean([x.severity for x in got if x.doc_id is not None and x.doc_id < 300 and max(0, x.doc_id % 6 - 3) == g]) for g in range(3)]
    assert mean[0] < 0.3 < 0.7 < mean[1] < 1.3 < mean[2]
    assert {x.toxic for x in got if x.doc_id == 901} == {True} and not any(x.toxic for x in got if x.doc_id in (None, 900))
    assert op.clean(docs).count() == sum(not x.toxic for x in got) and op.clean(docs).columns == docs.columns


def test_one_kind_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    clean = OrdinalToxicity().fit(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert not any(x.toxic for x in clean.transform(docs).collect())
    none = OrdinalToxicity().fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.transform(docs.limit(0)).count() == 0 and not any(x.toxic for x in none.transform(docs).collect())


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    op = OrdinalToxicity().fit(docs, labels.filter(~fold))
    got = op.transform(docs).drop("toxic").join(labels.filter(fold), "doc_id").groupBy("toxic", F.col("severity") >= op.cut).count().collect()
    n = {(r[0], r[1]): r["count"] for r in got}
    assert n.get((0, True), 0) < 0.01 * n[0, False]
    assert n[1, True] > 0.8 * (n[1, True] + n.get((1, False), 0))  # a twentieth of the labels is noise


def test_severity_equals_its_formula_and_the_fit_is_a_minimum(spark):
    """Chances by plain Python from the text's words, their beginnings and pairs; no small change of the model fits better."""
    import math
    import random

    import numpy as np
    import pyarrow as pa
    from helixmill.llm import textvec
    from helixmill.llm.toxicity import BITS, RIDGE, STEMS

    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        grade = i % 3
        words = r.choices([f"plain{j}" for j in range(40)], k=25)
        for n in range(grade * 2):
            words[n * 3] = r.choice(["awful", "horrid", "nasty"])
        if grade and i % 10 == 0:
            words[0] = "plain0"
        rows.append((i, " ".join(words)))
        labels.append((i, grade))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = OrdinalToxicity().fit(docs, lab)
    assert len(model.t) == 2 and model.t[0] < model.t[1]
    place = {int(b): n for n, b in enumerate(model.features)}

    def x(text):
        out = np.zeros(len(model.w))
        column = pa.array([text])
        w = textvec.words(column)
        found = list(w.hashes) + [textvec.mix(np.array([a * np.uint64(0xA0761D6478BD642F) + b]))[0] for a, b in zip(w.hashes, w.hashes[1:], strict=False)]
        for word in text.split():
            for n in STEMS:
                if len(word) > n:
                    h, _ = next(textvec.prefixes(pa.array([word]), textvec.words(pa.array([word])), range(n, n + 1)))
                    found += list(h)
        for h in found:
            if (b := int(h) >> (64 - BITS)) in place:
                out[place[b]] += 1
        return np.log1p(out)

    got = {s.doc_id: s for s in model.transform(docs).collect()}
    with np.errstate(over="ignore"):
        xs = np.stack([x(t) for _, t in rows])
    for (i, _), v in zip(rows, xs, strict=True):
        p = [1 / (1 + math.exp(-(float(v @ model.w) - t))) for t in model.t]
        assert got[i].p1 == pytest.approx(p[0], abs=1e-9) and got[i].p2 == pytest.approx(p[1], abs=1e-9)
        assert got[i].severity == pytest.approx(sum(p), abs=1e-9) and got[i].toxic == (sum(p) >= model.cut)
    grades = np.array([g for _, g in labels])

    def loss(w, t):
        p = 1 / (1 + np.exp(-((xs @ w)[:, None] - t)))
        p = np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))])
        cell = np.maximum((p[:, :-1] - p[:, 1:])[np.arange(len(p)), grades], 1e-12)
        return -np.log(cell).mean() + RIDGE / 2 * (w @ w)

    base = loss(model.w, model.t)
    for n in range(len(model.w)):
        for d in (-0.3, 0.3):
            assert loss(model.w + d * np.eye(len(model.w))[n], model.t) > base - 2e-3
    for d in ([0.3, 0], [-0.3, 0], [0, 0.3], [0, -0.3]):
        assert loss(model.w, model.t + np.array(d)) > base - 2e-3
