import zlib
from collections import Counter, defaultdict

from helixmill.llm.sharding import shard


def check(rows, got, shards):
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, size = defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    share = sum(size.values()) / shards
    longest = max((r.size for r in got), default=0)
    assert all(abs(size[s] - share) <= longest for s in range(shards))


def test_laws(spark):
    rows = [(i, "x" * (i % 97)) for i in range(900)] + [(5000 + i, "the same text") for i in range(700)]
    rows += [(None, None), (None, "é"), (7, "dup"), (7, "dup"), (8, "")]
    got = shard(spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, rng int"), 10).collect()
    check(rows, got, 10)


def test_one_hot_text(spark):
    rows = [(i, "copy") for i in range(4000)]
    check(rows, shard(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect(), 40)


def test_empty(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check([(r.doc_id, r.text) for r in d.collect()], shard(d).collect(), 40)


def test_equal_texts_lie_together(spark):
    rows = [(i, "the hot text") for i in range(6000)] + [(10_000 + i, f"pair {i // 2}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard(docs, 40).collect()
    check(rows, got, 40)
    of = defaultdict(set)
    for r in got:
        if r.doc_id >= 10_000:
            of[(r.doc_id - 10_000) // 2].add(r.shard)
    assert sum(len(s) > 1 for s in of.values()) <= 39


def test_layout_changes_nothing(spark):
    rows = [(i, f"text {i % 700}") for i in range(3000)] + [(None, None), (5, "text 5"), (5, "text 5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (Counter(map(tuple, shard(docs.repartition(n), 10).collect())) for n in (1, 7))
    assert a == b


def test_bytes_equal_sql_sums(spark):
    """Sizes of shards against the law stated plainly: records in order, cut where the byte at their middle falls."""
    rows = [(i, "y" * (i * 37 % 211)) for i in range(1200)]
    got = sorted(shard(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect(), key=lambda r: (r.shard, r.slot))
    total, before = sum(r.size for r in got), 0
    for r in got:
        assert r.shard == (before + r.size // 2) * 12 // total
        before += r.size
    assert [r.text_crc32 for r in got] == sorted(r.text_crc32 for r in got)
