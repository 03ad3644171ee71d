"""Whitening of embeddings by hierarchical merging of singular value decompositions.

1. Vectors become whole numbers; equal ones meet in a shuffle, combined before it, and each distinct one is written once (the fit list).
2. Each partition streams its vectors into a summary: count, exact sums, and the singular values and vectors, at full rank, of its
   centred rows. Two summaries merge without loss: the rows of both (values times vectors) and one row that corrects for the distance of
   their means are decomposed again.
3. Partitions' summaries are merged in a tree, FAN at a time; each level is a Spark job over the one before. No more than
   one summary, of a size that depends on the dimension alone, reaches the driver.
4. Every vector is projected; the covariance of the projections of the fit list is added up in the same way and compared with the identity.

Awkward rows: null vectors and those with a null or non-finite entry are left out; so are those of another dimension than most vectors have
(of equally frequent ones the larger), and empty ones. Repeated rows and null ids are rows of their own; other columns are not read.
Components without variance (their eigenvalue is within rounding of 0: fewer distinct vectors than dimensions, constant entries) are
not returned, so an empty table or one distinct vector gives no rows. Entries beyond 2 ** 46 in size, and a deviation beyond a long, are errors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stage

COMPONENTS = 16
STEP, ORIGIN = 64.0, 1_000_000
#: Summaries merged at a time, and vectors that a task decomposes at once.
FAN, CHUNK = 8, 8192
#: A summary holds dimension ** 2 numbers; larger dimensions are refused.
MOST_DIMENSIONS = 8192
_LARGEST = float(1 << 46)
_EPS = np.finfo(np.float64).eps


@dataclass
class Summary:
    """n vectors: exact sums of their entries (less ORIGIN), and rows with the scatter of the centred vectors: rows.T @ rows."""

    n: int
    sums: np.ndarray  # of Python integers
    rows: np.ndarray  # singular values times right singular vectors

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        """x: whole numbers less ORIGIN, as int64. They are centred on a whole number first, so nothing is lost to their size."""
        n = len(x)
        sums = x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) * n >= 2**62 else x.sum(axis=0).astype(object)
        near = np.array([int(s) // n for s in sums], np.int64)
        rest = np.array([int(s - int(m) * n) / n for s, m in zip(sums, near, strict=True)])
        return Summary(n, sums, _reduced((x - near).astype(np.float64) - rest))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        # difference of means, from whole numbers: (s1 n2 - s2 n1) / (n1 n2)
        apart = np.array([int(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        correction = np.sqrt(self.n / n * other.n) * apart
        return Summary(n, self.sums + other.sums, _reduced(np.vstack([self.rows, other.rows, correction])))

    def components(self, most: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Unit eigenvectors (in columns) and eigenvalues of the covariance, by falling eigenvalue, and its trace. A vector's
        entry of largest size is positive."""
        _, s, v = np.linalg.svd(self.rows, full_matrices=False)
        e = s * s / self.n
        there = s > (s[0] if len(s) else 0.0) * max(self.rows.shape[1], 1) * _EPS * 4
        k = min(most, int(there.sum()))
        v = v[:k] * np.sign(v[np.arange(k), np.abs(v[:k]).argmax(axis=1)])[:, None]
        return v.T, e[:k], float(e.sum())


def _reduced(rows: np.ndarray) -> np.ndarray:
    """At most as many rows as columns, of the same scatter: singular values times vectors."""
    _, s, v = np.linalg.svd(np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows, full_matrices=False)
    return s[:, None] * v


_SUMMARY = "node long, n long, sums array<decimal(38,0)>, rows binary"


def _packed(node: int, s: Summary) -> pa.RecordBatch:
    from decimal import Decimal

    sums = pa.array([[Decimal(int(x)) for x in s.sums]], pa.list_(pa.decimal128(38, 0)))
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([s.n], pa.int64()), sums, pa.array([s.rows.tobytes()], pa.binary())], ["node", "n", "sums", "rows"])


def _unpacked(row: dict) -> Summary:
    d = len(row["sums"])
    return Summary(row["n"], np.array([int(x) for x in row["sums"]], object), np.frombuffer(row["rows"]).reshape(-1, d))


def _numbers(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    total = None
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            part = Summary.of(_numbers(batch.column(0)[lo : lo + CHUNK]) - ORIGIN)
            total = part if total is None else total.merged(part)
    if total is not None:
        yield _packed(TaskContext.get().partitionId(), total)


def _merge(table: pa.Table) -> pa.Table:
    total = None
    for row in sorted(table.to_pylist(), key=lambda r: r["node"]):
        total = _unpacked(row) if total is None else total.merged(_unpacked(row))
    return pa.Table.from_batches([_packed(table.column("node")[0].as_py() // FAN, total)])


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the rows that can be used: x is floor(64 c) + 1000000 of each entry c, as array<long>."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col(key).alias("key"), x.alias("x")).filter(good & (F.size("x") > 0))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; at most {MOST_DIMENSIONS}")
    whole = F.transform("x", lambda c: F.when(F.abs(c) > _LARGEST, F.raise_error(F.lit("an entry is beyond 2 ** 46"))).otherwise((F.floor(c * STEP) + ORIGIN).cast("long")))
    return rows.filter(F.size("x") == d).select("key", whole.alias("x"))


def fitted(fit_list: DataFrame) -> Summary | None:
    """The summary of a table of distinct vectors (x array<long>), merged in a tree; None if it is empty."""
    level = stage.written(fit_list.select("x").mapInArrow(_leaf, _SUMMARY))
    while level.count() > 1:
        level = stage.written(level.groupBy(F.expr(f"node div {FAN}")).applyInArrow(_merge, _SUMMARY))
    row = level.first()
    return None if row is None else _unpacked(row.asDict())


@dataclass
class Model:
    """What a projection needs: the mean as whole numbers and rests, eigenvectors over the roots of their eigenvalues."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    @staticmethod
    def of(s: Summary, most: int) -> Model:
        v, e, trace = s.components(most)
        return Model(s.n, s.sums, v / np.sqrt(e), e / trace if trace else e)

    def projected(self, y: np.ndarray) -> np.ndarray:
        near = np.array([int(s) // self.n for s in self.sums], np.int64)
        rest = np.array([int(s - int(m) * self.n) / self.n for s, m in zip(self.sums, near, strict=True)])
        return ((y - near).astype(np.float64) - rest) @ self.axes

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n y - sums) squared, exactly."""
        about = ((self.n * y.astype(np.float64) - self.sums.astype(np.float64)) ** 2).sum(axis=1).max(initial=0)
        if about < 2.0**62:
            return ((self.n * y - self.sums.astype(np.int64)) ** 2).sum(axis=1)
        exact = [int(sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(row, self.sums, strict=True))) for row in y]
        if max(exact) >= 2**63:
            raise OverflowError("a deviation does not fit a long")
        return np.array(exact, np.int64)


def identity_error(fit_list: DataFrame, model: Model) -> float:
    """The largest entry of the fit list's covariance after whitening, less the identity."""
    sent = fit_list.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = sent.value.axes.shape[1]
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                z = sent.value.projected(_numbers(batch.column(0)) - ORIGIN)
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    k = model.axes.shape[1]
    sums = fit_list.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    off = F.abs(F.col("v") / model.n - F.when(F.col("at") % (k + 1) == 0, 1.0).otherwise(0.0))
    return sums.agg(F.max(off)).first()[0]


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component, from 1 by
    falling eigenvalue. Components with variance are as many as asked for at most."""
    rows = whole_numbers(vectors, key, vector)
    fit_list = stage.written(rows.select("x").distinct())
    summary = fitted(fit_list)
    kind = vectors.schema[key].dataType
    schema = f"key {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = None if summary is None else Model.of(summary, components)
    if model is None or not model.axes.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    error = identity_error(fit_list, model)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = m.axes.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _numbers(batch.column("x")) - ORIGIN
            n = len(y)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, m.n), pa.int64()),
                    pa.array(np.repeat(m.deviations(y), k), pa.int64()), pa.array(m.projected(y).ravel()), pa.array(np.tile(m.explained, n)), pa.array(np.full(n * k, error)),
                ],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
