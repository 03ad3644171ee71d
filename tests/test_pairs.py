"""Samples compared in blocks, windows by events."""

import random

import pytest
from helixmill.operators import correction, strains
from pyspark.sql import functions as F


def brute(major, ranges):
    out = {}
    cover, base = {}, {}
    for s, t, g, a, b in ranges:
        cover.setdefault((t, g, s), set()).update(range(a, b))
    for s, t, g, p, x in major:
        base[t, g, s, p] = x
    for t, g, a in cover:
        for t2, g2, b in cover:
            both = cover[t, g, a] & cover[t2, g2, b]
            if (t, g) == (t2, g2) and a != b and both:
                x, y = ({p: base[t, g, s, p] for p in both if (t, g, s, p) in base} for s in (a, b))
                shared = x.keys() & y.keys()
                out[t, g, a, b] = (len(both), len(shared), len(x.keys() - y.keys()), len(y.keys() - x.keys()), sum(x[p] != y[p] for p in shared))
    return out


@pytest.mark.parametrize("block", [1, 3, 256])
def test_samples_in_blocks_equal_brute_force(spark, monkeypatch, block):
    rng = random.Random(3)
    samples = [f"s{i}" for i in range(9)]
    ranges = [(s, t, g, a, a + rng.randint(1, 60)) for s in samples for t in (1, 2) for g in (1, 2, 3) for a in (rng.randint(-5, 40), 200 + rng.randint(0, 9000)) if rng.random() < 0.7]
    major = [(s, t, g, p, rng.choice("ACGT")) for s, t, g, a, b in ranges for p in range(a - 5, b + 5) if rng.random() < 0.3 and p >= 0]
    major = [(*k, x) for k, x in {r[:4]: r[4] for r in major}.items()]
    m = spark.createDataFrame(major, "sample string, taxid int, gene_id int, position int, base string")
    r = spark.createDataFrame(ranges + [("empty", 1, 1, 5, 5)], "sample string, taxid int, gene_id int, start int, end int")
    got = {tuple(x)[:4]: tuple(x)[4:] for x in strains.gene_distance(m, r, block).collect()}
    assert got == brute(major, ranges)
    assert strains.gene_distance(m, r.limit(0)).collect() == []


def test_windows_by_events(spark):
    rng = random.Random(4)
    rows = [(g, p, rng.choice([7, 8, 8])) for g in (1, 2) for p in range(40) if rng.random() < 0.6] + [(1, 3, 9), (1, 3, 9)]
    want = {}
    for g, p, t in rows:
        for i in range(max(p - 9, 4 - 10), p + 1):
            want[g, i, t] = want.get((g, i, t), 0) + 1
    df = spark.createDataFrame(rows, "g int, pos int, taxid int")
    got = correction.windows(df, ["g"], 10, 4)
    assert {(r.g, r.start, r.taxid): r.hits for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence") < plan.index("Window")  # windows become rows after the sums


def test_an_allele_outside_the_ranges_does_not_count(spark):
    m = spark.createDataFrame([(1, 1, 1, 50, "A"), (2, 1, 1, 5, "C")], "sample int, taxid int, gene_id int, position int, base string")
    r = spark.createDataFrame([(1, 1, 1, 0, 10), (2, 1, 1, 4, 20)], "sample int, taxid int, gene_id int, start int, end int")
    got = {(x.sample_a, x.sample_b): (x.shared_length, x.only_a, x.only_b) for x in strains.gene_distance(m, r).collect()}
    assert got == {(1, 2): (6, 0, 1), (2, 1): (6, 1, 0)}
    assert strains.gene_distance(m, r.filter(F.col("sample") == 1)).collect() == []
