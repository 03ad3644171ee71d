"""Which files make up which samples."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fastx

_FIRST = re.compile(r"^(.*[_.])1(\..*)$")


@dataclass(frozen=True)
class Sample:
    name: str
    first: str
    second: str | None = None
    both: bool = False  # first has the mates in turn

    @property
    def paired(self) -> bool:
        return self.second is not None or self.both


def _name(path: str) -> str:
    return re.sub(r"\.(fa|fasta|fna|fq|fastq)(\.gz)?$", "", path.rsplit("/", 1)[-1])


def is_pair(a: str, b: str) -> bool:
    """Whether two file names differ only by _1 and _2 (or .1 and .2) before the extension."""
    m = _FIRST.match(a)
    return bool(m) and b == f"{m[1]}2{m[2]}"


def discover(paths: Iterable[str]) -> list[Sample]:
    """Samples of a list of files: pairs by name, and single files for the rest; the order of the list does not matter."""
    left, out = sorted(set(paths)), []
    while left:
        a = left.pop(0)
        m = _FIRST.match(a)
        mate = f"{m[1]}2{m[2]}" if m else None
        if mate in left:
            left.remove(mate)
            out.append(Sample(_name(m[1].rstrip("_.")), a, mate))
        else:
            out.append(Sample(_name(a), a))
    return out


def interleaved(ids: list[str]) -> bool:
    """Whether the ids of a file's first records are mates in turn: /1, /2, /1, /2."""
    pairs = list(zip(ids[::2], ids[1::2], strict=False))
    return bool(pairs) and all(a.endswith("/1") and b.endswith("/2") and a[:-2] == b[:-2] for a, b in pairs)


#: Records of a file's start that tell whether mates come in turn.
LOOKED_AT = 200


def detected(spark: SparkSession, sample: Sample) -> Sample:
    """The sample, with `both` set where the first records of its one file are mates in turn. No more than LOOKED_AT are read."""
    if sample.second is not None:
        return sample
    fastx.register(spark)
    reader = fastx.FastxReader({"path": fastx.qualified(spark, sample.first), "splitBytes": fastx.SPLIT_BYTES})
    ids = [row[0] for row, _ in zip(reader.records(reader.partitions()[0]), range(LOOKED_AT), strict=False)]
    return replace(sample, both=len(ids) % 2 == 0 and interleaved(ids))


class UnpairedRecords(ValueError):
    """Two mate files with different numbers of records, or one file of mates with an odd number."""


def mates(spark: SparkSession, sample: Sample, split_bytes: int = fastx.SPLIT_BYTES, strict: bool = True) -> DataFrame:
    """(sample, pair, read_num, id, sequence, quality): record i of the second file is the mate of record i of the first, and in a
    file of mates in turn record 2i + 1 of record 2i, whatever their ids. pair: i, from 0. An unpaired sample has read_num 1 alone.

    strict: records without a mate are an error; otherwise they are left out of a paired sample."""
    rows = lambda path: fastx.with_ordinals(spark, path, split_bytes)
    keep = ["id", "sequence", "quality"]
    name = F.lit(sample.name).alias("sample")
    if sample.second is None and not sample.both:
        return rows(sample.first).select(name, F.col("ordinal").alias("pair"), F.lit(1).alias("read_num"), *keep)
    counts = [fastx.record_count(spark, p, split_bytes) for p in (sample.first, sample.second) if p is not None]
    if strict and (counts[0] % 2 if sample.both else counts[0] != counts[1]):
        raise UnpairedRecords(f"sample {sample.name}: {' and '.join(map(str, counts))} records")
    if sample.both:
        pair, num, most = F.floor(F.col("ordinal") / 2), (F.col("ordinal") % 2 + 1).cast("int"), counts[0] // 2
        return rows(sample.first).filter(pair < most).select(name, pair.alias("pair"), num.alias("read_num"), *keep)
    sides = [rows(p).filter(F.col("ordinal") < min(counts)).select(name, F.col("ordinal").alias("pair"), F.lit(i).alias("read_num"), *keep) for i, p in ((1, sample.first), (2, sample.second))]
    return sides[0].unionByName(sides[1])


def side_by_side(rows: DataFrame) -> DataFrame:
    """(sample, pair, id_1, sequence_1, quality_1, id_2, ...) of mates(): one row for each pair, met by number in one shuffle."""
    side = lambda c, n: F.max(F.when(F.col("read_num") == n, F.col(c))).alias(f"{c}_{n}")
    return rows.groupBy("sample", "pair").agg(*[side(c, n) for n in (1, 2) for c in ("id", "sequence", "quality")])
