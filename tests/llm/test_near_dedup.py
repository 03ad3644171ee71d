import random
import re

import pytest
from helixmill.llm.components import components
from helixmill.llm.near_dedup import NearDedup


def brute(rows, k, percent):
    """Component and set size of each (id, text), comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), key), key)
    return {key: (len(sets[i]), low[find(i)]) for i, (key, _) in enumerate(rows)}


def texts(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = ["", " \t", "One", "one", "one two", "A b C", "a B c"]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(5, 120))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            new = list(base)
            for _ in range(r.randint(0, 5)):
                new[r.randrange(len(new))] = r.choice(words)
            out.append(" ".join(new))
    passage = " ".join(r.choice(words) for _ in range(60))
    out += [passage + " " + " ".join(r.choice(words) for _ in range(n)) for n in (1, 2, 5, 20, 60, 90)]
    return out


@pytest.mark.parametrize("small", [2048, 4])
@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent, small):
    rows = list(enumerate(texts()))
    rows += [(1000 + i, rows[40][1]) for i in range(5)]
    want = brute(rows, k, percent)
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, cls string, node int")
    got = NearDedup(k, percent, small)(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_and_repeats(spark):
    rows = [(1, None), (2, ""), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "lone words here now")]
    got = NearDedup(3, 85)(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 2, None, True)], key=str
    )
    assert NearDedup()(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)] + [(200, i) for i in range(201, 260)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100} | {i: 200 for i in range(201, 260)}


def test_keep(spark):
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 60)) for _ in range(60)) for _ in range(6)]
    rows = [(i, t, f"{i}") for i, t in enumerate(base)] + [(100 + i, t + " more", "copy") for i, t in enumerate(base[:4])]
    rows += [(0, base[0], "0"), (None, None, "n"), (None, None, "n"), (7, "", "e"), (None, base[5], "null key")]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, _key string, near_key int, Near_Hash int")
    got = NearDedup(5, 80).keep(docs)
    assert got.columns == docs.columns
    want = [*map(str, range(6)), "n", "n", "e"]
    assert sorted(x["_key"] for x in got.collect()) == sorted(want)
    assert NearDedup().keep(docs.limit(0)).count() == 0


def test_large_groups_are_cut_and_lose_no_link(spark, monkeypatch):
    from helixmill.llm import near_dedup

    monkeypatch.setattr(near_dedup, "GROUP_SHINGLES", 300)
    rows = list(enumerate(texts(2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in NearDedup(3, 85)(docs).collect()} == brute(rows, 3, 85)


def test_least_agreeing():
    import math

    from helixmill.llm.near_dedup import MISS, POSITIONS, least_agreeing

    for percent in (50, 80, 85, 99):
        p = percent / 100
        tail = [sum(math.comb(POSITIONS, i) * p**i * (1 - p) ** (POSITIONS - i) for i in range(n)) for n in range(POSITIONS + 1)]
        n = least_agreeing(percent)
        assert tail[n] <= MISS < tail[n + 1]
