import itertools
import random

import pytest
from helixmill.functions import dna, text
from helixmill.functions.dna import Shape
from helixmill.operators import classify, evaluate, index, intervals, kmers, profile, shapes, strains, taxonomy, variants
from pyspark.sql import functions as F

SHAPE = Shape("X__XX_X_XX__X")
SEQ = "ACGTACTACTGATCACTATCTAGCTAGTCGTAGC"


def keys(s, shape):
    code, out = {c: i for i, c in enumerate("ACGT")}, []
    rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for p in range(len(s) - len(shape) + 1):
        window, other = s[p : p + len(shape)], rc[len(s) - len(shape) - p : len(s) - p]
        if any(window[o] not in code or other[o] not in code for o in shape.take):
            out.append(None)
            continue
        out.append(min(sum(code[w[o]] * 4 ** (shape.k - 1 - i) for i, o in enumerate(shape.take)) for w in (window, other)))
    return out


@pytest.mark.parametrize("shape", [SHAPE, Shape("XX_X"), Shape("X")])
def test_kmers(spark, shape):
    seqs = [SEQ, "", "ACG", None, "ACGTNACGTACGTACGTACGT", "acgtACGTACGTACGTACGT", SEQ[::-1].translate(str.maketrans("ACGT", "TGCA"))]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string")
    got = kmers.kmers(df, "s", shape, ["id"], skip_ambiguous=False).collect()
    for i, s in enumerate(seqs):
        assert [r.key for r in sorted((r for r in got if r.id == i), key=lambda r: r.pos)] == keys(s or "", shape)
    if shape.palindromic:
        both = [sorted(r.key for r in got if r.id == i) for i in (0, 6)]
        assert both[0] == both[1] and len(both[0]) == len(SEQ) - len(shape) + 1


def test_shape_facts():
    assert (SHAPE.k, len(SHAPE), SHAPE.gaps, SHAPE.longest_gap, SHAPE.longest_run, SHAPE.gap_lengths) == (7, 13, 6, 2, 2, {1, 2})
    for bad in ("", "__", "XA", "X" * 32):
        with pytest.raises(ValueError):
            Shape(bad)


def test_scalar_functions(spark):
    r = spark.createDataFrame([("/a/b.c/x.fq.gz", ">12_7 words", "abcd", "abxd", 3_723_004)], "path string, header string, a string, b string, ms long").select(
        text.basename("path").alias("base"), text.directory("path").alias("dir"), text.strip_extension(text.basename("path")).alias("stem"), text.remove_suffix("path", ".gz").alias("cut"),
        text.header_id("header").alias("id"), *[c.alias(n) for c, n in zip(text.header_taxid_gene("header"), ("t", "g"), strict=True)], text.shared_prefix("a", "b").alias("shared"),
        text.format_milliseconds("ms").alias("clock"), text.choose(F.lit(30), F.lit(15)).alias("ways"), text.bit_string(F.lit(5), 6).alias("bits"), dna.apply_shape(F.lit("ACGT"), Shape("X_X")).alias("taken"),
        dna.key_to_dna(F.lit(27), 3).alias("bases"),
    ).first()
    assert tuple(r) == ("x.fq.gz", "/a/b.c", "x.fq", "/a/b.c/x.fq", "12_7", 12, 7, "ab", "1:02:03.004", 155117520, "000101", "AG", "CGT")
    v = dna.pack_value(F.lit(9), F.lit(5), F.lit(77), 7, 12)
    assert tuple(spark.range(1).select(*dna.unpack_value(v, 7, 12)).first()) == (9, 5, 77)


def test_index_ignores_order(spark):
    rows = [(k, g, p, 10, 20 + s % 2, 30 + s) for k, g, p, s in [(1, 1, 5, 0), (1, 1, 5, 0), (2, 1, 5, 0), (2, 2, 5, 2), (3, 1, 4, 0), (3, 1, 6, 0), (4, 1, 1, 0), (4, 1, 1, 1)]]
    want = {1: (30, 1, 5), 2: (20, 0, 0), 3: (30, 0, 0), 4: (10, 1, 1)}
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = index.build(spark.createDataFrame(rows, "key long, gene_id int, pos int, r0 int, r1 int, r2 int"), ["r0", "r1", "r2"])
        assert {r.key: (r.taxid, r.gene_id, r.gene_pos) for r in got.collect()} == want


def test_intervals_equal_sets(spark):
    r = random.Random(4)
    a = [(g, s, s + r.randint(1, 40)) for g in range(3) for s in (r.randint(0, 300) for _ in range(25))]
    b = [(g, s, s + r.randint(1, 90)) for g in range(3) for s in (r.randint(0, 300) for _ in range(8))]
    cover = lambda rows, g: {x for k, s, e in rows if k == g for x in range(s, e)}
    da, db = (spark.createDataFrame(x, "g int, start int, end int") for x in (a, b))
    ma, mb = intervals.merge(da, ["g"]), intervals.merge(db, ["g"])
    flat = lambda df: [(r.g, r.start, r.end) for r in df.select("g", "start", "end").collect()]
    both, merged = flat(intervals.intersect(ma, mb, ["g"])), flat(ma)
    for g in range(3):
        assert cover(merged, g) == cover(a, g) and cover(both, g) == cover(a, g) & cover(b, g)
        own = sorted(x for x in merged if x[0] == g)
        assert all(x[2] < y[1] for x, y in itertools.pairwise(own))
    assert flat(intervals.merge(ma.select("g", "start", "end"), ["g"])) and sorted(flat(intervals.merge(ma, ["g"]))) == sorted(merged)
    points = spark.createDataFrame([(g, p) for g in range(3) for p in range(0, 350, 7)], "g int, p int")
    for r in intervals.coverage_at(points, da, ["g"], "p").collect():
        assert r.coverage == sum(g == r.g and s <= r.p < e for g, s, e in a)
    runs = flat(intervals.runs(da, ["g"], 2, 30))
    deep = {g: {x for x in range(400) if sum(k == g and s <= x < e for k, s, e in a) >= 2} for g in range(3)}
    assert all(set(range(s, e)) <= deep[g] and e - s >= 30 and s - 1 not in deep[g] and e not in deep[g] for g, s, e in runs)
    touching = intervals.merge(spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 30, 31)], "g int, start int, end int"), ["g"])
    assert sorted(flat(touching)) == [(1, 0, 20), (1, 30, 31)]


@pytest.mark.parametrize("shape", [Shape("X_X"), Shape("XX_XX"), Shape("XXX")])
def test_patterns_equal_enumeration(spark, shape):
    bits = 5
    span = bits + len(shape) - 1
    masks = [sum(1 << (i + o) for o in shape.take) for i in range(bits)]
    want: dict[int, int] = {}
    for m in range(1, 1 << span):
        p = sum(1 << i for i in range(bits) if not m & masks[i])
        want[p] = want.get(p, (1 << span) - 1) & m
    want.pop((1 << bits) - 1, None)
    got = {r.pattern: sum(1 << j for j in r.mutations) for r in variants.train(spark, shape, bits).collect()}
    assert got == want
    m = spark.range(1, 40).select(F.col("id"), variants.hit_miss(F.col("id"), shape, bits).alias("p")).collect()
    assert all(r.p == sum(1 << i for i in range(bits) if not r.id & masks[i]) for r in m)


def test_calls_tell_a_lone_substitution(spark):
    shape, bits, at = Shape("XX_XX"), 8, 30
    hits = [(1, p, not (p <= at < p + len(shape) and (at - p) in shape.take)) for p in range(60)]
    got = variants.call(spark.createDataFrame(hits, "read int, pos int, hit boolean"), variants.train(spark, shape, bits), "read", shape, bits).collect()
    assert {r.position for r in got} <= {at}


def test_shape_search_never_tells_wrong(spark):
    rng = random.Random(1)
    pool = [shapes.propose(rng, 8, 4) for _ in range(4)]
    assert all(shapes.valid(s, 8, 4) and shapes.valid(shapes.alter(rng, s), 8, 4) for s in pool)
    rows = shapes.evaluate(spark, pool, [0.9, 0.97], 8, 100).collect()
    assert all(r.fp == 0 for r in rows) and sum(r.tp for r in rows) > 0
    best, score, tried = shapes.search(spark, 6, 2, 6, 2, 3, 50)
    assert shapes.valid(best, 6, 2) and score == max(t[1] for t in tried)


def test_descent_and_filters(spark):
    lin = spark.createDataFrame([(1, None, None), (10, 10, None), (20, 10, 20), (21, 10, 21)], "id int, a int, b int")
    taxa = spark.createDataFrame([("clear", 20, 9), ("clear", 10, 2), ("clear", 1, 1), ("split", 20, 3), ("split", 21, 3), ("weak", 20, 2)], "read string, taxid int, hits long")
    got = {r.read: (r.taxid, r.path_hits) for r in classify.descend(taxa, lin, ["a", "b"], "read").collect()}
    assert got == {"clear": (20, 12)}
    taxa = taxa.union(spark.createDataFrame([("split", 10, 4)], taxa.schema))
    assert {r.read: (r.taxid, r.path_hits) for r in classify.descend(taxa, lin, ["a", "b"], "read").collect()}["split"] == (10, 4)
    pairs = spark.createDataFrame([("x/1", "x/2"), ("x", "x"), ("x/2", "x/1"), ("x1", "y2")], "a string, b string").select(classify.valid_pair(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in pairs] == [True, True, False, False]


def test_small_formulas(spark):
    r = spark.range(1).select(profile.ani(F.lit(10), F.lit(20), 11, 2), profile.clip(F.lit(-5), F.lit(20), F.lit(100)), profile.clip(F.lit(95), F.lit(20), F.lit(100)), strains.jukes_cantor(F.lit(0.0)), strains.jukes_cantor(F.lit(0.8)), taxonomy.rank_id(F.lit("Superkingdom")), taxonomy.rank_id(F.lit("clade"))).first()
    assert tuple(r) == (1.0, 15, 5, 0.0, None, 0, -1)
    c = evaluate.confusion(spark.createDataFrame([(True, True), (True, False), (None, True), (False, False)], "t boolean, s boolean"), F.col("t"), F.col("s")).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.accuracy) == (1, 1, 1, 1, 0.5)


def test_closure_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, max(i - 1, 1), "x") for i in range(1, 14)], "id int, parent_id int, rank string")
    got = {(r.id, r.ancestor_id): r.distance for r in taxonomy.closure(chain).collect()}
    assert got == {(i, j): i - j for i in range(1, 14) for j in range(1, i + 1)}
