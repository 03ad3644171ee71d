import random

import pytest
from helixmill.llm import language
from helixmill.llm.language import Model, evaluate, fit, letters, predict


def phrases(text, known):
    """Greedy longest-match phrases of the whole text."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def test_phrases_equal_brute_force():
    r = random.Random(2)
    texts = {n: ["".join(r.choice(a) for _ in range(200)) for _ in range(4)] for n, a in (("x", "abc "), ("y", "bcd "), ("z", "éß日"))}
    model = Model(texts)
    known = [" ".join(texts[n][0::2])[: language.LETTERS] for n in model.names]
    asked = ["", "a", "zzz", "abcabcabc", "é", *("".join(r.choice("abcdéß日z ") for _ in range(n)) for n in (5, 50, 2047, 2048, 2049, 5000))]
    assert model.phrases(asked).tolist() == [[phrases(t, k) for k in known] for t in asked]


def test_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "123 !!!", "fr"), (5, "", None), (None, "the dog and the cat", None), (7, "le chien et le chat", None), (7, "le chien et le chat", None)]
    docs = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "doc_id long, text string, lang string, score string")
    got = {(r.doc_id, r.lang_pred) for r in predict(docs, fit(docs)).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (None, "en"), (7, "fr")} <= got
    assert all(0 <= r.score <= 1 for r in predict(docs, fit(docs)).collect())
    assert {r.lang_pred for r in predict(docs, fit(docs.limit(0))).collect()} == {"und"}
    assert evaluate(docs.limit(0)).count() == 0


def test_letters():
    assert letters("Hello,  WORLD 42 é!") == "hello world é" and letters(None) == ""


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = evaluate(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) == pytest.approx(1, abs=0.02)


def test_all_sampled_texts_teach_beyond_a_shared_opening(spark, monkeypatch):
    r = random.Random(4)
    opening = "licence words " * 200
    rows = [(i, opening + "".join(r.choice("abcdefgh ") for _ in range(6000)), "x") for i in range(60)]
    rows += [(100 + i, rows[0][1], "x") for i in range(40)]
    taught = {}
    monkeypatch.setattr(language, "Model", lambda texts: taught.update(texts))
    fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(taught["x"]) == 60
    own = sum(not set(t) - set("abcdefgh ") for t in taught["x"])
    assert own > 30
    assert len(" ".join(["z" * language.SAMPLE_LETTERS] * (language.SAMPLE_DOCS // 2))) <= language.LETTERS


@pytest.mark.parametrize("dense", [64, 2])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 2048])
def test_pieces_change_nothing(monkeypatch, size, dense):
    monkeypatch.setattr(language, "PIECE", size)
    monkeypatch.setattr(language, "DENSE", dense)
    r = random.Random(size)
    loop = "abcde" * 60
    model = Model({"x": [loop, loop, loop], "y": ["".join(r.choice("abc de") for _ in range(150)) for _ in range(4)]})
    known = [" ".join({"x": [loop, loop], "y": None}["x"])[: language.LETTERS]]
    asked = [loop[3:90] + "z" + loop[:40], loop, "".join(r.choice("abcde z") for _ in range(200)), "e" * 30, "", "a"]
    assert [x[0] for x in model.phrases(asked).tolist()] == [phrases(t, known[0]) for t in asked]


def test_marks_alone_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "\u0301\u0302 \u0301", None), (3, "12 \u0301!", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(docs, fit(docs)).collect()}
    assert got[2] == got[3] == ("und", 0.0) and got[1][0] == "en"
