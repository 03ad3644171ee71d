"""Record ordinals, mates by number, and selection by rank."""

import gzip
import random
import statistics

import pytest
from helixmill.operators import order
from helixmill.sources import fastx, samples
from pyspark.sql import functions as F


def fastq(ids):
    return "".join(f"@{x}\n{'ACGT' * (len(x) % 5 + 1)}\n+\n{'@+II' * (len(x) % 5 + 1)}\n" for x in ids)


@pytest.mark.parametrize("size", [1, 37, 200, 10_000])
def test_ordinals_at_any_split_size(spark, tmp_path, size):
    names = [f"r{'x' * (i % 7)}{i}" for i in range(60)]
    (tmp_path / "a.fq").write_text(fastq(names))
    (tmp_path / "b.fa").write_text("".join(f">{n}\nAC\nGT\n" for n in names[:9]))
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write(fastq(names[:5]))
    (tmp_path / "d.fq").write_text("")
    got = {}
    for r in fastx.with_ordinals(spark, str(tmp_path), size).collect():
        got.setdefault(r.file[-4:], {})[r.ordinal] = r.id
    assert {f: [x[i] for i in range(len(x))] for f, x in got.items()} == {"a.fq": names, "b.fa": names[:9], "q.gz": names[:5]}
    assert fastx.record_count(spark, str(tmp_path), size) == 74


@pytest.mark.parametrize("size", [53, 10_000])
def test_mates_by_number_whatever_their_ids(spark, tmp_path, size):
    first, second = [f"left{i}" for i in range(40)], [f"{'r' * (i % 4)}{i * 7}" for i in range(40)]
    (tmp_path / "s_1.fq").write_text(fastq(first))
    with gzip.open(tmp_path / "s_2.fq.gz", "wt") as f:
        f.write(fastq(second))
    s = samples.Sample("s", str(tmp_path / "s_1.fq"), str(tmp_path / "s_2.fq.gz"))
    assert samples.detected(spark, s) == s
    pairs = samples.side_by_side(samples.mates(spark, s, size)).orderBy("pair").collect()
    assert [(r.pair, r.id_1, r.id_2) for r in pairs] == list(zip(range(40), first, second, strict=True))
    assert all(len(r.sequence_2) == len(r.quality_2) for r in pairs)
    (tmp_path / "s_1.fq").write_text(fastq(first[:30]))
    with pytest.raises(samples.UnpairedRecords, match="30 and 40"):
        samples.mates(spark, s, size)
    assert samples.mates(spark, s, size, strict=False).groupBy("read_num").count().orderBy("read_num").collect() == [(1, 30), (2, 30)]


@pytest.mark.parametrize("size", [41, 10_000])
def test_mates_in_turn(spark, tmp_path, size):
    path = tmp_path / "t.fq"
    path.write_text(fastq([f"q{i}/{m}" for i in range(25) for m in (1, 2)]))
    s = samples.detected(spark, samples.Sample("t", str(path)))
    assert s.both and s.paired
    pairs = samples.side_by_side(samples.mates(spark, s, size)).orderBy("pair").collect()
    assert [(r.sample, r.pair, r.id_1, r.id_2) for r in pairs] == [("t", i, f"q{i}/1", f"q{i}/2") for i in range(25)]
    path.write_text(fastq(["a/1", "a/2", "b/1"]))
    assert not samples.detected(spark, samples.Sample("t", str(path))).both
    with pytest.raises(samples.UnpairedRecords):
        samples.mates(spark, samples.Sample("t", str(path), both=True))
    alone = samples.mates(spark, samples.Sample("t", str(path)), size).orderBy("pair").collect()
    assert [(r.pair, r.read_num, r.id) for r in alone] == [(0, 1, "a/1"), (1, 1, "a/2"), (2, 1, "b/1")]


def test_numbered_is_the_rank_in_each_group(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("at"))
    got = order.numbered(rows, ["g"], "at", 10**7).collect()
    for g in range(3):
        mine = sorted((r["at"], r.ordinal) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(1000))


@pytest.mark.parametrize("held", [0, 5, 1 << 16])
@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_equal_percentile(spark, held, share):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, -2.5, 0.0, -0.0, float(rng.randint(-9, 9)), rng.random()])) for _ in range(900)]
    rows += [(4, None), (5, 1.0), (6, 1.0), (6, 2.0), *[(7, 3.0)] * 50]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", F.lit(share)).alias("p")).collect()}
    got = {r.g: r["median"] for r in order.quantiles(df, ["g"], "v", share, held=held).collect()}
    assert got.keys() == want.keys() and got[4] is None
    assert all(got[g] == pytest.approx(want[g], abs=1e-12) for g in want if want[g] is not None)


def test_weighted_median_of_a_hot_group_in_ranges(spark):
    rows = [("hot", float(i * 7919 % 1000), i % 4) for i in range(4000)] + [("cold", 5.0, 2), ("cold", 9.0, 2), ("none", 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = {r.g: r.m for r in order.quantiles(df, ["g"], "v", weight=F.col("n"), name="m", held=100).collect()}
    assert got == {"hot": statistics.median(v for g, v, n in rows for _ in range(n) if g == "hot"), "cold": 7.0, "none": None}


def test_running_sums_lie_in_ranges(spark):
    rows = spark.range(2000).select(F.lit("one").alias("g"), (F.col("id") * 31 % 997).alias("v"), F.lit(2).cast("long").alias("w"))
    got = order.ranged(rows, ["g", "v"], 6, weight="w").orderBy("part", "r").collect()
    assert len({r.part for r in got}) == 6  # one group in several ranges
    assert [r.v for r in got] == sorted(r.v for r in got) and all(r.before == 2 * r.r for r in got)


def test_paths_without_a_scheme(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert fastx.qualified(spark, "/a/b") == "/a/b"
    try:
        conf.set("fs.defaultFS", "hdfs://name:8020/")
        assert fastx.qualified(spark, "/a/b") == "hdfs://name:8020/a/b" and fastx.qualified(spark, "s3a://x/y") == "s3a://x/y"
    finally:
        conf.set("fs.defaultFS", before)
