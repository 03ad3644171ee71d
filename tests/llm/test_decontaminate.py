import random
import re

from helixmill.llm.decontaminate import MISS, clean, containments, functions_for, minwise


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, items, threshold=0.8):
    out = set()
    for d, t in docs:
        s = shingles(t)
        for i, u in items:
            q = shingles(u)
            if q and len(q & s) >= threshold * len(q) - 1e-9:
                out.add((d, i, round(len(q & s) / len(q), 9)))
    return out


def test_equals_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([3, 5, 6, 9, 15, 30, 60, 200])]
    docs = []
    for _, w in items:
        docs.append(list(w))
        for n in (10, 3000):
            new = list(w)
            docs.append(text(n) + new + text(n))
            new = list(w)
            new[len(new) // 2] = "changed"
            docs.append(text(n) + new + text(n))
            docs.append(text(n) + w[: len(w) // 2] + text(n))
    rows = [(i, " ".join(d).upper()) for i, d in enumerate(docs)] + [(None, None), (None, ""), (7, " ".join(items[5][1]))]
    bench = [(i, " ".join(w)) for i, w in items] + [(50, None), (51, ""), (None, " ".join(items[6][1]))]
    got = containments(spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, item_id int"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(x.doc_id, x.item_id, round(x.containment, 9)) for x in got.collect()} == brute(rows, bench)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert containments(docs, items).count() == 0
    assert containments(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_functions():
    import math

    import numpy as np

    for size in (1, 5, 16):
        assert functions_for(size, 0.8) == (size, math.ceil(0.8 * size))
    for size in (17, 40, 300, 100_000):
        n, need = functions_for(size, 0.8)
        assert sum(math.comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(need)) <= MISS
        assert need > 1 and n > functions_for(size // 4, 0.8)[0] - 1
    probes, chosen = minwise(np.arange(100, dtype=np.uint64), 12)
    assert len(probes) <= 12 and chosen.sum() == 12


def test_clean_and_clashing_names(spark):
    item = "one two three four five six seven eight"
    docs = [(1, "x " + item + " y", "a"), (2, "nothing of it", "b"), (None, None, "c"), (3, "", "d"), (2, "nothing of it", "b"), (4, item.upper(), "e")]
    df = spark.createDataFrame(docs, "item_id long, text string, item string")
    bench = spark.createDataFrame([(9, item), (10, None)], "item_id long, text string")
    assert sorted(map(str, clean(df, bench).collect())) == sorted(map(str, df.filter("item not in ('a', 'e')").collect()))
    got = containments(df, bench, key="item_id")
    assert got.columns == ["item_id", "item", "containment"] and {(r.item_id, r["item"]) for r in got.collect()} == {(1, 9), (4, 9)}
    assert clean(df.limit(0), bench).count() == 0 and clean(df, bench.limit(0)).count() == len(docs)


def test_blocks_of_items_lose_nothing(spark, monkeypatch):
    from helixmill.llm import decontaminate

    r = random.Random(5)
    items = [(i, " ".join(f"v{r.randint(0, 500)}" for _ in range(r.choice([4, 9, 40, 120])))) for i in range(30)]
    docs = [(i, "a b " + t + " c d") for i, t in items]
    want = brute(docs, items)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 800)
    got = containments(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id, round(x.containment, 9)) for x in got.collect()} == want


def test_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(x.doc_id, x.item_id, round(x.containment, 9)) for x in containments(d, b).collect()}
    assert got == brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "x y z u v w"), (3, None)], "doc_id long, text string")
    for kind, ids in (("string", ["q-1", "q-2", None]), ("binary", [b"\xff", b"q", None]), ("int", [1, 2, None])):
        items = spark.createDataFrame([(ids[0], "a b c d e f"), (ids[1], "none of this is there"), (ids[2], "x y z u v w")], f"item_id {kind}, text string")
        out = containments(docs, items)
        assert dict(out.dtypes)["item_id"] == kind
        got = {(r.doc_id, bytes(r.item_id) if kind == "binary" and r.item_id is not None else r.item_id) for r in out.collect()}
        assert got == {(1, ids[0]), (2, None)}
