import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helixmill.llm import ctw

D = ctw.DEPTH


def stream(t):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    return b"".join(x + b" " for x in w) + b"\n", w


def brute(rows, folds=10):
    """Scores from a recursive context tree held in dictionaries."""
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % folds == 0 for k, _ in rows}
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)
    tokens, ends = Counter(), 0

    def paths(t):
        s = b"\n" * D + stream(t)[0]
        for i in range(D, len(s)):
            for j in range(8):
                yield s[i - D : i], (1 << j) | (s[i] >> (8 - j)), (s[i] >> (7 - j)) & 1

    for k, t in rows:
        if not held[k]:
            tokens.update(stream(t)[1])
            ends += 1
            for c, p, bit in paths(t):
                for d in range(D + 1):
                    counts[c[D - d :], p][bit] += 1
                    if d < D:
                        kids[c[D - d :], p].add((c[D - d - 1 :], p))
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(node):
        if node not in memo:
            own = kt(*counts[node])
            if len(node[0]) == D:
                memo[node] = own, own, None
            else:
                below = sum(weighted(x)[0] for x in kids[node])
                memo[node] = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below))), own, below
        return memo[node]

    def bit_p(c, p, bit, d=0):
        node = (c[D - d :], p)
        a = counts[node] if node in counts else [0, 0]
        est = (a[bit] + 0.5) / (a[0] + a[1] + 1)
        if d == D:
            return est
        _, own, below = weighted(node) if node in counts else (0, 0, 0)
        w = 1 / (1 + math.exp(below - own))
        return w * est + (1 - w) * bit_p(c, p, bit, d + 1)

    n, v = sum(tokens.values()) + ends, len(tokens) + (ends > 0)
    out = {}
    for k, t in rows:
        w = stream(t)[1]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in [*(tokens[y] for y in w), ends])
        out[k] = held[k], len(w) + 1, sum(tokens[y] > 0 for y in w) + (ends > 0), n, base, sum(math.log10(bit_p(*x)) for x in paths(t)), len(stream(t)[0])
    return out


def compare(spark, rows, monkeypatch):
    want = brute(rows)
    docs = spark.createDataFrame([(a, b, 3) for a, b in rows], "doc_id long, text string, score int")
    got = ctw.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        h, n, known, total, base, value, size = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.n_bytes) == (h, n, known, total, size)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(value, rel=1e-6)


def test_equals_brute_force(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "The cat sat on the mat"), (4, "the cat"), (5, " the\tCAT  sat\n"), (None, "été naïve"), (7, "a" * 40), (8, "日本 語")]
    rows += [(i, f"words {i} and more words {i * i}") for i in range(9, 40)]
    compare(spark, rows, monkeypatch)
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 100)
    compare(spark, rows, monkeypatch)


def test_without_training_rows(spark):
    rows = [(k, t) for k, t in ((None, "one two"), (None, None))]
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_bytes for r in got) == [1, 9] and all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert all(r.score == pytest.approx(-8 * r.n_bytes * math.log10(2)) for r in got)
    assert ctw.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_beats_word_counts_on_held_out_text(spark):
    got = ctw.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
