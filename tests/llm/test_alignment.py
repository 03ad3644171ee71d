import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixmill.llm import alignment
from helixmill.llm.vocabulary import pair


@pytest.fixture(scope="module")
def tokenizers():
    p = pair()
    return p, alignment.ByteLevel(p.a), alignment.Pieces(p.b)


def brute(texts, a, b):
    """Each text's row by the definition, over whole texts."""
    found, seen = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        x = a.tokenizer.encode(raw.decode(), add_special_tokens=False).ids if t else []
        y = b.model.encode(t) if t else []
        if b"".join(a.bytes[i] for i in x) != raw or b"".join(b.bytes[i] for i in y) != raw:
            found.append(None)
            continue
        ends = []
        for ids, table in ((x, a.bytes), (y, b.bytes)):
            at, out = 0, []
            for i in ids:
                at += len(table[i])
                out.append((at, i))
            ends.append(out)
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        lo, groups = 0, []
        for hi in cuts:
            groups.append(tuple([i for e, i in side if lo < e <= hi] for side in ends))
            lo = hi
        links = Counter((i, j) for g in groups for i in g[0] for j in g[1])
        seen.update(links.keys())
        found.append((x, y, groups, links))
    top = defaultdict(int)
    for (i, _), n in seen.items():
        top[i] = max(top[i], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, groups, links = f
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        best = sum(n for k, n in links.items() if seen[k] == top[k[0]])
        out.append((len(x), len(y), len(groups), sum(links.values()), best, sum(n * seen[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


ODD = [
    None, "", " ", "  ", "\n", "a", "don't stop", "  two  spaces  ", "tab\tand\r\nlines\n\n\nthree", "in ▁ it", "<|endoftext|> <s> <0x41>", "日本語のテキスト、 漢字", "🙂🙂 a🙂b", "x\0y \0", "1,000.50²³½ 3",
    "Привет, мир! Ёлка.", "é é́ ́", "a b c　 d", "foo_bar.baz(qux);\r\n\tif (x) {\r\n}", "word " * 300, "don't stop", "Aİß ﬁ ﬀ", "x" * 3000, "​ ​", "it's we're I'M", "=== --- ###!!!",
]


def rows(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_texts_equal_brute_force(spark, tokenizers):
    p, a, b = tokenizers
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, groups string")
    want = [(i, *w) for i, w in enumerate(brute(ODD, a, b))]
    assert rows(alignment.align(docs, p)) == sorted(want, key=str)
    # the same whatever the blocks
    assert rows(alignment.align(docs.repartition(3), p, block_bytes=1)) == sorted(want, key=str)


def test_whole_table_equals_brute_force(spark, tokenizers):
    p, a, b = tokenizers
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = docs.select("doc_id", "text").collect()
    assert rows(alignment.align(docs, p, block_bytes=50_000)) == sorted(((r["doc_id"], *w) for r, w in zip(got, brute([r["text"] for r in got], a, b), strict=True)), key=str)


def test_keys_of_any_type_repeats_and_groups(spark, tokenizers):
    p, a, b = tokenizers
    docs = spark.createDataFrame([(b"\xff", "one two"), (None, "one two"), (b"\xff", "one two")], "k binary, t string")
    got = alignment.align(docs, p, "k", "t", with_groups=True).collect()
    assert Counter(None if r["k"] is None else bytes(r["k"]) for r in got) == {b"\xff": 2, None: 1}
    want = brute(["one two"] * 3, a, b)[0]
    for r in got:
        assert (r["n_a"], r["count_sum"], r["groups_sha256"]) == (want[0], want[5], want[6])
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == want[6]


def test_empty_table(spark, tokenizers):
    assert alignment.align(spark.createDataFrame([], "doc_id int, text string"), tokenizers[0]).collect() == []


def test_segments_are_encoded_as_in_their_text(tokenizers):
    import re

    _, a, b = tokenizers
    find = re.compile(alignment.segment_pattern(b.pieces)).findall
    for t in ODD:
        if t and "▁" not in t:
            cut = find(" " + t)
            assert "".join(cut) == " " + t
            assert sum(a.encode(cut), []) == a.tokenizer.encode(" " + t, add_special_tokens=False).ids
            assert sum(b.encode(cut), []) == b.model.encode(t)


def test_vocabularies_that_join_over_a_cut_make_one_segment(spark):
    assert alignment.segment_pattern(["a", "b▁c"]) == alignment.segment_pattern([".\n"]) == r"(?s).+"
    assert "\\Z" in alignment.segment_pattern(["a", "▁▁a"])


def test_ids_joined_in_groups_of_several(spark):
    """Tokens of lengths 2, 1, 3 against 1, 2, 3: groups (0, 1 | 7, 8) and (2 | 7)."""
    units = spark.createDataFrame([(5, [0, 1, 2], [2, 1, 3], [7, 8, 7], [1, 2, 3])], "unit long, a array<int>, a_len array<int>, b array<int>, b_len array<int>")
    ends = alignment.tokens(units)
    assert [tuple(r) for r in alignment.groups(ends).collect()] == [(5, 3, 3, 2, 5, "0,1|7,8;2|7")]
    got = alignment.links(ends).select("unit", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n").collect()
    assert sorted(tuple(r) for r in got) == [(5, 0, 7, 1), (5, 0, 8, 1), (5, 1, 7, 1), (5, 1, 8, 1), (5, 2, 7, 1)]


def test_units_in_buckets_do_not_move(spark):
    from helixmill.llm import stage

    units = spark.range(200).selectExpr("id AS unit", "array(1, 2) AS a", "array(1, 2) AS a_len", "array(3) AS b", "array(3) AS b_len")
    with stage.joined_in_place(spark):
        found = stage.written_by(alignment.tokens(stage.written_by(units.repartition(4, "unit"), "unit", 4)), "unit", 4)
        for df in (alignment.tokens(stage.written_by(units, "unit", 4)), alignment.groups(found), alignment.links(found)):
            assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
