"""Quality by importance resampling: documents are drawn in proportion to how much likelier a model of the target text
makes them than a model of the raw text.

Both models are bags of hashed words and word pairs: bucket counts of all target documents and of all raw documents,
smoothed. A document's log weight is the sum over its n-grams of log(target / raw). A Gumbel variate is added and the
documents with the largest sums are kept: a draw without replacement in proportion to the weights (Gumbel top-k).

k is not given by hand: it is the number of documents whose log weight reaches `cut`, the log weight that best parts
labelled target documents from the others. The k-th largest sum is found exactly by counting the documents in ranges of
the sum, each range narrower than the last, so that no sort of all documents is needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import textvec
from .features import hash_unit, labelled_sample, ngrams, unused
from .stage import written

BITS = 16
#: Labelled documents from which the target's model and the cut are fitted, at most (expected number).
LABELLED = 12_000
SMOOTHING = 0.5
_DIGIT = 16


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts; one vector of 2 ** BITS numbers for each task is added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in textvec.slices(batches, "text"):
            total += np.bincount(ngrams(batch.column("text"), BITS)[0], minlength=1 << BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(1 << BITS, np.int64)
    got = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) of each bucket, each model smoothed towards the other's total shape by SMOOTHING counts."""
    p = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    q = (target + SMOOTHING * len(target) * p) / (target.sum() + SMOOTHING * len(target))
    return np.log(q) - np.log(p)


def weigh(rows: DataFrame, ratio: np.ndarray, text: str = "text") -> DataFrame:
    """rows with n_words and log_weight of a text column added (columns of these names are replaced)."""
    shared = rows.sparkSession.sparkContext.broadcast(ratio)
    rows = rows.drop("n_words", "log_weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.slices(batches, text):
            bucket, doc, w = ngrams(batch.column(text), BITS)
            total = np.bincount(doc, shared.value[bucket], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w.counts.astype(np.int64)), pa.array(total)], [*batch.schema.names, "n_words", "log_weight"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("n_words", LongType()), StructField("log_weight", DoubleType())]))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that parts good from bad with the fewest errors, halfway between two labelled weights; with one kind
    only, the weight that keeps them all."""
    if not len(weights) or good.all():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order].astype(np.int64)
    # cutting before row i: good rows below are lost, bad rows from i on are kept
    errors = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum((1 - g)[::-1])[::-1], [0]])
    best = int(np.argmin(errors))
    if best == 0:
        return float("-inf")
    return float((w[best - 1] + w[min(best, len(w) - 1)]) / 2)


def fixed(column: str) -> Column:
    """A double as a long in the same order: steps of 2 ** -32, held within 2 ** 30."""
    limit = float(1 << 30)
    held = F.least(F.greatest(F.col(column), F.lit(-limit)), F.lit(limit))
    return F.when(F.col(column).isNotNull(), F.floor(held * float(1 << 32)).cast("long"))


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest fixed() value of a column, exactly: four passes, each counting the values of the next 16 bits
    among the rows that share the bits found so far; None if there are fewer than k rows or k is 0."""
    raw = df.select(fixed(column).alias("b")).filter("b is not null")
    prefix, left = None, k
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        part = raw if prefix is None else raw.filter(F.shiftright("b", shift + _DIGIT) == prefix)
        counts = part.groupBy(F.shiftright("b", shift).alias("d")).count().collect()  # 65,536 rows at most
        for d, n in sorted(((r[0], r[1]) for r in counts), reverse=True):
            if n >= left > 0:
                prefix = d
                break
            left -= n
        else:
            return None
    return prefix


class ImportanceResampling:
    """key, n_words, log_weight, gumbel and kept for each row of documents.

    labels: key and a target column, of which 1 marks target text and 0 other text. Null and empty texts have log weight
    0. Rows with the same key and text get the same draw. Documents that tie with the k-th sum are all kept. Without
    labels of both kinds nothing can be told apart, and all rows are kept. Other columns are ignored."""

    def __init__(self, labelled: int = LABELLED, seed: int = 1):
        self.labelled, self.seed = labelled, seed

    def fit(self, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "quality"):
        sample = written(labelled_sample(docs, labels, [target], self.labelled, key, text))
        raw = bucket_counts(docs.select(F.col(text).alias("text")))
        counts = bucket_counts(sample.filter(F.col(target) == 1))
        self.ratio = log_ratio(counts, raw)
        got = weigh(sample, self.ratio).select(target, "log_weight").toArrow()
        self.cut = best_cut(got.column("log_weight").to_numpy(), got.column(target).to_numpy() == 1)
        return self

    def _drawn(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """rows with log_weight, n_words and gumbel: the same for the same key and text, whenever they are asked for."""
        u = (hash_unit(F.col(key), F.xxhash64(text), F.lit(self.seed)) * float(1 << 40) + 0.5) / float(1 << 40)
        return weigh(rows, self.ratio, text).withColumn("gumbel", F.col("log_weight") - F.log(-F.log(u)))

    def _last(self, drawn: DataFrame) -> int | None:
        k = drawn.filter(F.col("log_weight") >= F.lit(self.cut)).count()
        return kth_largest(drawn, "gumbel", k)

    def transform(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        drawn = self._drawn(docs.select(key, text), key, text).select(key, "n_words", "log_weight", "gumbel")
        drawn = written(drawn)
        last = self._last(drawn)
        return drawn.withColumn("kept", F.lit(False) if last is None else fixed("gumbel") >= last)

    def keep(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The rows of docs that are kept, with their columns. Weights are found twice, so that no text is shuffled."""
        last = self._last(written(self._drawn(docs.select(key, text), key, text).select("log_weight", "gumbel")))
        if last is None:
            return docs.limit(0)
        made = ("n_words", "log_weight", "gumbel")
        # columns of these names are put aside under names that no column has
        names = {c: unused(docs, f"aside_{c}") for c in docs.columns if c.lower() in made}
        hidden = docs.withColumnsRenamed(names)
        return self._drawn(hidden, names.get(key, key), names.get(text, text)).filter(fixed("gumbel") >= last).drop(*made).withColumnsRenamed({v: k for k, v in names.items()})
