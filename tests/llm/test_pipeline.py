"""The pipeline against the operators' own verdicts and brute force, on documents with all that is awkward."""

import hashlib
import random
import struct

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from helixmill.llm.quality import ImportanceResampling, fixed
from helixmill.llm.toxicity import OrdinalToxicity

from .test_decontaminate import brute as contained
from .test_near_dedup import brute as linked


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    r = random.Random(11)
    good, junk, bad = ([f"{p}{i}" for i in range(150)] for p in ("g", "j", "t"))
    docs, labels = [], []
    for i in range(300):
        kind = i % 5
        words = r.choices(good if kind < 3 else good + bad[:20] if kind == 3 else junk, k=r.randint(20, 90))
        if kind == 3:
            words[::4] = r.choices(bad[:12], k=len(words[::4]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind != 4), int(kind == 3)))
    item = " ".join(r.choices(good, k=30))
    docs += [(1000 + i, docs[i][1]) for i in range(40)] + [(1100 + i, docs[i][1] + " tail") for i in range(20)]
    docs += [(2000, "g1 " + item + " g2"), (2001, None), (2002, ""), (2003, " ".join(r.choices(good, k=30_000))), (None, docs[0][1]), (5, docs[5][1]), (2004, "One two")]
    labels += [(None, 1, 0), (3, None, None), (7, 1, 0)]
    spark.createDataFrame([(a, b, "en", "s", len(b or ""), 1) for a, b in docs], "doc_id long, text string, lang string, source string, n_chars long, gumbel int").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def plain(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_every_stage(spark, folder):
    docs, labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "decontamination", "bpe"]
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["quality"](spark, docs, folder)
    assert kept.columns == docs.columns
    model = ImportanceResampling().fit(docs, labels)
    drawn = model.transform(docs).withColumn("f", fixed("gumbel")).collect()
    k = sum(r.log_weight >= model.cut for r in drawn)
    last = sorted((r.f for r in drawn), reverse=True)[k - 1]
    assert [r.kept for r in drawn] == [r.f >= last for r in drawn]
    want = {r.doc_id for r in drawn if r.kept}
    assert {r[0] for r in plain(kept)} == want and kept.count() == sum(r.kept for r in drawn) < docs.count()

    docs = kept
    kept = stage["toxicity"](spark, docs, folder)
    said = OrdinalToxicity().fit(docs, labels).transform(docs).collect()
    assert kept.columns == docs.columns and sorted((r[0] for r in plain(kept)), key=str) == sorted((r.doc_id for r in said if not r.toxic), key=str)

    docs = kept
    rows = plain(docs)
    kept = stage["near_dedup"](spark, docs, folder)
    many = [(i if i is not None else 10**9 + n, t) for n, (i, t) in enumerate(dict.fromkeys(rows))]
    low = linked(many, 5, 80)
    want = sorted({i for i, _ in many if low[i][1] == i})
    assert kept.columns == docs.columns and sorted(i if i is not None else 10**9 for i, _ in plain(kept)) == [i if i < 10**9 else 10**9 for i in want]

    docs = kept
    kept = stage["decontamination"](spark, docs, folder)
    dirty = {d for d, *_ in contained(plain(docs), [(r.item_id, r.text) for r in bench.collect()])}
    assert kept.columns == docs.columns and plain(kept) == [x for x in plain(docs) if x[0] not in dirty]

    out = {r.doc_id: r for r in stage["bpe"](spark, kept, folder).collect()}
    ranks = corpus_pipeline.vocabulary()[0]
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(out) == kept.count()
    for i, t in plain(kept):
        ids = enc.encode_ordinary(t or "")
        assert list(out[i].ids) == ids and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {i: r.ids_sha256 for i, r in out.items()}


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
