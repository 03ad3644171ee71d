"""Trees, vectors, profile files, sets, and training up to a number of candidates."""

from itertools import combinations

import pytest
from helixmill.functions.dna import Shape
from helixmill.operators import classify, profile, sets, shapes, taxonomy, trees, variants
from helixmill.sources import sinks
from pyspark.sql import functions as F

NODES = [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 4), (10, 3)]


def nodes(spark):
    return spark.createDataFrame(NODES, "id int, parent_id int")


def test_trees_of_all_reads(spark):
    taxa = spark.createDataFrame([("a", 6, 3), ("a", 5, 1), ("a", 2, 2), ("b", 1, 4), ("c", 10, 1), ("c", 4, 1)], "read string, taxid int, hits long")
    rows = trees.read_nodes(taxa, taxonomy.closure(nodes(spark)), "read")
    assert dict(map(tuple, trees.newick(rows, "read").collect())) == {
        "a": "(((6_hits=3)4_hits=0,5_hits=1)2_hits=2)1_hits=0;", "b": "1_hits=4;", "c": "((4_hits=1)2_hits=0,(10_hits=1)3_hits=0)1_hits=0;",
    }
    lines = dict(map(tuple, trees.indented(rows, "read", F.col("id").cast("string")).collect()))
    assert lines == {"a": "1\n  2\n    4\n      6\n    5", "b": "1", "c": "1\n  2\n    4\n  3\n    10"}
    assert trees.newick(rows.limit(0), "read").collect() == []


def test_vectors_and_an_ancestor_is_right(spark):
    scores = spark.createDataFrame([(7, 2, 4, 5), (7, 4, 1, 6), (7, 5, 1, 6), (8, 2, 3, 3)], "read int, taxid int, hits int, score int")
    got = {r.read: r for r in classify.score_vectors(scores, taxonomy.closure(nodes(spark)), "read", F.lit(6)).collect()}
    assert (got[7].taxid, got[7].own_vector, got[7].total_vector, got[7].correct) == (4, "1,1,4", "6,6,5", True)
    assert got[8].correct and not classify.score_vectors(scores, taxonomy.closure(nodes(spark)), "read", F.lit(10)).first().correct
    assert got[7].rank_confidence == pytest.approx(1 / 6) and got[7].candidate_confidence == pytest.approx(2 / 5)


def test_alternative_offsets(spark):
    hits = spark.createDataFrame([(1, 5, 1, 0, 10), (1, 5, 1, 1, 11), (2, 5, 1, 0, 10), (2, 5, 1, 1, 9), (3, 5, 1, 0, 10), (3, 5, 1, 4, 40), (3, 5, 1, 5, 41), (3, 6, 1, 6, 90), (3, 6, 1, 7, 70)], "read int, taxid int, gene_id int, pos int, gene_pos int")
    assert {tuple(r) for r in classify.ambiguous(hits, "read").collect()} == {(1, False, 0), (2, False, 0), (3, True, 2)}


def test_profile_file_with_strains_and_lineages(spark, tmp_path):
    shares = spark.createDataFrame([(7, 0.6), (8, 0.4), (3, 1.0)], "id int, abundance double")
    named = spark.createDataFrame([(7, "species", True), (8, "species", True), (3, "genus", False)], "id int, rank string, leaf boolean")
    paths = spark.createDataFrame([(7, "3|7", "g|s"), (8, "3|8", "g|t"), (3, "3|", "g|")], "id int, taxpath string, namepath string")
    sinks.profile_file(profile.profile_rows(shares, named, paths, ["genus", "species"]), str(tmp_path / "p"), "x", ["genus", "species"])
    lines = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*"))).splitlines()
    assert lines[:4] == ["@SampleID: x", "@Version: 0.9.1", "@Ranks:genus|species|strain", "@@TAXID\tRANK\tTAXPATH\tTAXPATHSN\tPERCENTAGE"]
    assert lines[4:] == ["7.1\tstrain\t3|7\tg|s\t60.000000", "8.1\tstrain\t3|8\tg|t\t40.000000", "7\tspecies\t3|7\tg|s\t60.000000", "8\tspecies\t3|8\tg|t\t40.000000", "3\tgenus\t3\tg\t100.000000"]


def test_matrices_of_given_samples(spark, tmp_path):
    d = spark.createDataFrame([(5, "a", "b", 0.25), (5, "b", "a", 0.25)], "taxid int, sample_a string, sample_b string, distance double")
    sinks.matrices(d, str(tmp_path / "m"), ["a", "b", "c"])
    text = sorted("".join(p.read_text() for p in (tmp_path / "m/taxid=5").glob("part-*")).splitlines())
    assert [x for x in text if not x.startswith("samples")] == ["a\t\t0.25\t", "b\t0.25\t\t"] and text[-1] == "samples\ta\tb\tc"


def test_sets_with_nulls_and_repeats(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (1, None), (2, 5)], "g int, p int")
    b = spark.createDataFrame([(1, 2), (1, 9), (3, 1), (None, None)], "g int, p int")
    assert [tuple(r) for r in sets.intersection(a, b, ["g", "p"]).collect()] == [(1, 2)]
    assert {tuple(r) for r in sets.difference(a, b, ["g", "p"]).collect()} == {(1, None), (2, 5)}
    assert {tuple(r) for r in sets.compared(a, b, ["g", "p"], ["g"]).collect()} == {(1, 1, 1, 1), (2, 0, 1, 0), (3, 0, 0, 1), (None, 0, 0, 1)}


def brute(shape, bits):
    """{pattern: (positions mutated in every set of candidates that causes it, candidates)}, over all sets."""
    span, out = bits + len(shape) - 1, {}
    taken = [{i + o for o in shape.take} for i in range(bits)]
    for p in range((1 << bits) - 1):
        free = set(range(span)) - set().union(*(t for i, t in enumerate(taken) if p >> i & 1))
        causes = [set(c) for k in range(1, len(free) + 1) for c in combinations(sorted(free), k) if all((p >> i & 1) == (not t & set(c)) for i, t in enumerate(taken))]
        if causes:
            out[p] = (sorted(set.intersection(*causes)), len(free))
    return out


@pytest.mark.parametrize("text", ["XX", "X_X", "X_XX"])
def test_levels_of_candidates_equal_all_subsets(spark, tmp_path, text):
    shape, bits = Shape(text), 5
    want = brute(shape, bits)
    rows = lambda df: {r.pattern: (r.mutations, r.candidates) for r in df.collect()}
    assert rows(variants.trained(spark, shape, bits)) == want
    for lower, limit in ((0, 3), (3, 5), (2, 2)):
        assert rows(variants.trained(spark, shape, bits, limit, lower)) == {p: x for p, x in want.items() if lower < x[1] <= limit}
    path = str(tmp_path / "table")
    for limit in (3, 5, 4):  # later levels are added, and none is trained twice
        assert rows(variants.train_to(spark, path, shape, bits, limit)) == {p: x for p, x in want.items() if x[1] <= limit}
    assert sorted(p.name for p in (tmp_path / "table").iterdir()) == ["limit=3", "limit=5"]
    got = {r.candidates: (r.patterns, r.told) for r in shapes.told_by_candidates(variants.trained(spark, shape, bits), bits).collect()}
    assert got == {k: (sum(x[1] == k for x in want.values()), sum(len(x[0]) for x in want.values() if x[1] == k)) for k in {x[1] for x in want.values()}}


def test_sensitivity_grows_with_the_limit(spark):
    shape = Shape("XX_X")
    rows = shapes.sensitivity_by_limit(spark, variants.trained(spark, shape, 6), shape, 6, [2], [3, 9], length=40, reads=30, of="candidates").collect()
    told = {r.candidates_at_most: r.tp for r in rows}
    assert told[3] <= told[9] and told[9] > 0
