"""Intervals of very different lengths against brute force, awkward files, and bit and byte helpers at their edges."""

import gzip
import random

import pytest
from helixmill.functions import dna, text
from helixmill.operators import intervals
from helixmill.sources import fastx, tables
from pyspark.sql import functions as F


def some(seed: int, n: int, longest: int) -> list[tuple[str, int, int]]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        start = rng.randrange(0, longest)
        out.append((rng.choice("ab"), start, start + rng.choice([0, 1, 5, 64, 1024, 1025, 70_000, longest])))
    return out


SCHEMA = "g string, start long, end long"


def test_intersect_is_every_overlap(spark):
    x, y = some(1, 60, 3_000_000), some(2, 60, 3_000_000)
    got = intervals.intersect(spark.createDataFrame(x, SCHEMA), spark.createDataFrame(y, SCHEMA), ["g"])
    want = [(g, max(s, t), min(e, f)) for g, s, e in x for h, t, f in y if g == h and s < e and t < f and max(s, t) < min(e, f)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert intervals.intersect(spark.createDataFrame(x, SCHEMA), spark.createDataFrame([], SCHEMA), ["g"]).count() == 0


def test_one_long_interval_is_few_rows(spark):
    one = spark.createDataFrame([("a", 0, 10**9)], SCHEMA)
    assert intervals._own(one, "start", "end").count() <= 18


def test_sweep_and_points_over_many_stretches(spark):
    x = [r for r in some(3, 40, 400_000) if r[1] < r[2]]
    rows = spark.createDataFrame(x, SCHEMA)
    swept = [tuple(r) for r in intervals.sweep(rows, ["g"]).collect()]
    want = []
    for g in "ab":
        at = sorted({p for h, s, e in x if h == g for p in (s, e)})
        depth = [sum(s <= p < e for h, s, e in x if h == g) for p in at]
        change = [i for i in range(len(at)) if i == 0 or depth[i] != depth[i - 1]]
        want += [(g, at[i], at[j], depth[i]) for i, j in zip(change, change[1:], strict=False) if depth[i]]
    assert sorted(swept) == sorted(want)
    points = [(g, p) for g in "abc" for p in random.Random(4).sample(range(500_000), 50)]
    got = intervals.coverage_at(spark.createDataFrame(points, "g string, p long"), rows, ["g"], "p").collect()
    assert sorted(tuple(r) for r in got) == sorted((g, p, sum(h == g and s <= p < e for h, s, e in x)) for g, p in points)
    merged = intervals.merge(rows, ["g"])
    inside = intervals.containing(spark.createDataFrame(points, "g string, p long"), merged, ["g"], "p").select("g", "p").collect()
    assert sorted(tuple(r) for r in inside) == sorted((g, p) for g, p in points if any(h == g and s <= p < e for h, s, e in x))


def test_null_groups_are_swept(spark):
    rows = spark.createDataFrame([(None, 0, 5), (None, 3, 9)], SCHEMA)
    assert sorted(tuple(r)[1:] for r in intervals.sweep(rows, ["g"]).collect()) == [(0, 3, 1), (3, 5, 2), (5, 9, 1)]


def test_gzip_is_told_without_a_suffix(spark, tmp_path):
    fastx.register(spark)
    path = tmp_path / "reads.fq"
    path.write_bytes(gzip.compress(b"".join(b"@r%d\nACGT\n+\nIIII\n" % i for i in range(500))))
    got = spark.read.format("fastx").option("splitBytes", "100").load(str(path))
    assert got.count() == 500 and got.select("id").distinct().count() == 500
    assert fastx.headers(spark, str(path), 3).count() == 3


def test_malformed_record_in_a_later_split_is_an_error(spark, tmp_path):
    fastx.register(spark)
    path = tmp_path / "reads.fq"
    good = "".join(f"@r{i}\nACGT\n+\n@III\n" for i in range(50))
    path.write_text(good)
    assert spark.read.format("fastx").option("splitBytes", "37").load(str(path)).count() == 50
    path.write_text(good + "junk\n" * 200 + good)
    with pytest.raises(Exception, match="no FASTQ record"):
        spark.read.format("fastx").option("splitBytes", "300").load(str(path)).count()


def test_first_name_of_the_file_where_none_is_scientific(spark, tmp_path):
    path = tmp_path / "names.dmp"
    path.write_text("".join(f"{i}\t|\t{n}\t|\t\t|\t{c}\t|\n" for i, n, c in [(1, "zeta", "synonym"), (1, "alpha", "synonym"), (2, "x", "synonym"), (2, "b", "scientific name")]))
    assert {tuple(r) for r in tables.names_dump(spark, str(path), first_seen=True).collect()} == {(1, "zeta"), (2, "b")}


def test_bits_and_bytes_at_their_edges(spark):
    values = [0, 1, -1, 1 << 62, -(1 << 63), 0x0102030405060708, 5]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    for row in df.select("x", text.with_bit("x", 0, True).alias("on"), text.with_bit("x", 0, False).alias("off"), text.first_set_bit("x", 64).alias("f"), text.information_content("x", 63).alias("i"), text.swapped_bytes("x").alias("s")).collect():
        u = row.x & ((1 << 64) - 1)
        assert row.on == signed(u | 1 << 63) and row.off == u & ~(1 << 63)
        assert row.f == 64 - u.bit_length()
        low = f"{u & ((1 << 63) - 1):063b}"
        assert row.i == sum(a != b for a, b in zip(low, low[1:], strict=False))
        assert row.s == int.from_bytes(u.to_bytes(8, "big"), "little", signed=True)
    bases = ["", "A", "ACGT", "TTTTT", "GATTACA" * 9, "ACN", None]
    df = spark.createDataFrame([(b,) for b in bases], "s string").withColumn("b", dna.dna_to_bytes("s"))
    for row in df.withColumn("back", dna.bytes_to_dna("b", F.length("s"))).collect():
        assert row.back == (None if row.s in ("ACN", None) else row.s)
        if row.back is not None:
            assert len(row.b) == (len(row.s) + 3) // 4
