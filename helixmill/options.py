"""Options of a run, checked before any job starts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from helixmill.functions.dna import Shape


@dataclass
class Options:
    """What build, classify and profile need. check() says all that is wrong at once."""

    shape: Shape
    reads: list[str] = field(default_factory=list)
    reference: list[str] = field(default_factory=list)
    taxid_bits: int = 24
    gene_bits: int = 8
    position_bits: int = 16
    bucket_bits: int = 20
    most_pos: int | None = None
    share: float = 0.7
    least_hits: int = 3
    strategy: str = "descent"

    def wrong(self, spark: SparkSession) -> list[str]:
        out = []
        value = self.taxid_bits + self.gene_bits + self.position_bits
        if value > 64:
            out.append(f"a value of {value} bits does not fit 64")
        if self.bucket_bits > 2 * self.shape.k:
            out.append(f"{self.bucket_bits} bucket bits, but keys have {2 * self.shape.k}")
        if 2 * self.shape.k - self.bucket_bits + value > 64:
            out.append("what is left of a key beside its bucket does not fit 64 bits with its value")
        if not 0 < self.share < 1:
            out.append("share must lie between 0 and 1")
        if self.most_pos is not None and self.most_pos >= 1 << self.position_bits:
            out.append("most_pos does not fit its bits")
        if self.strategy not in ("descent", "pathsum", "pathsum_lca"):
            out.append(f"no strategy {self.strategy!r}")
        for path in [*self.reads, *self.reference]:
            size = _size(spark, path)
            if size is None:
                out.append(f"{path} does not exist")
            elif size == 0:
                out.append(f"{path} is empty")
        return out

    def check(self, spark: SparkSession) -> Options:
        if found := self.wrong(spark):
            raise ValueError("; ".join(found))
        return self


def _size(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file or folder in any file system that Spark reads; None if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength() if fs.exists(at) else None
