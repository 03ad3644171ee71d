"""Toxicity by cumulative-link ordinal regression on sparse word features.

Grades 0 < 1 < ... < K share one weight vector w; thresholds t_1 < ... < t_K part them: P(grade >= j) is
logistic(w.x - t_j). The expected severity is the sum of these over j.

x: log(1 + count) of each of a chosen set of hashed words, word beginnings and word pairs. The buckets are chosen on
the labelled sample by the chi-square of their presence against grade > 0. The fit is by gradient steps on the driver over
a bounded sample of labelled rows; scoring runs in Spark over all rows.

The labels say toxic or not. A toxic document's grade is 1 or 2 by how many of the chosen toxic words it has: 2 above
the median of the toxic sample. The operator itself takes any integer grades."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .features import labelled_sample, ngrams
from .stage import written

BITS = 20
#: Bytes of a word's beginning that are features too, so that unseen forms of a word are known by their stem.
STEMS = range(4, 9)
#: Labelled rows that are fitted, at most (expected number), and features of the model.
LABELLED = 12_000
FEATURES = 512
#: Chi-square that a feature must reach: chance alone gives none of 2 ** BITS buckets as much.
EVIDENCE = 30.0
STEPS, RATE, RIDGE = 400, 0.1, 1e-4


def _presence(features: np.ndarray | None):
    """(row, bucket, count) of each text's buckets; of the given buckets, if any."""
    wanted = None
    if features is not None:
        wanted = np.full(1 << BITS, -1, np.int32)
        wanted[features] = np.arange(len(features))

    def chosen(bucket: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if wanted is None:
            return bucket, doc
        bucket = wanted[bucket]
        return bucket[bucket >= 0], doc[bucket >= 0]

    def of(column: pa.Array) -> tuple[np.ndarray, ...]:
        bucket, doc, w = ngrams(column, BITS)
        found = [chosen(bucket, doc)]
        for h, rows in textvec.prefixes(column, w, STEMS):
            found.append(chosen((h >> np.uint64(64 - BITS)).astype(np.int64), rows))
        bucket, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        code, count = np.unique(doc.astype(np.int64) << BITS | bucket, return_counts=True)
        return code >> BITS, code & ((1 << BITS) - 1), count, w.counts

    return of


class OrdinalToxicity:
    """fit() on documents and labels, then transform(): key, p1..pK (chances of grade >= j), severity and toxic.

    severity: expected grade. toxic: severity reaches `cut`, chosen on the labelled sample for the fewest errors. Null and
    empty texts have no features and get the severity of such a text. Without toxic labels, or without others, every
    severity is that grade's. Repeated rows get equal results; other columns are ignored."""

    def __init__(self, labelled: int = LABELLED, features: int = FEATURES):
        self.labelled, self.n_features = labelled, features

    def fit(self, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "toxic"):
        sample = written(labelled_sample(docs, labels, [grade], self.labelled, key, text).select(F.col(grade).cast("int").alias("grade"), "text"))
        self._choose(sample)
        rows, cols, vals, grades = self._features(sample)
        if grades.max(initial=0) == 1:
            grades = self._degrees(rows, cols, vals, grades)
        self._regress(rows, cols, vals, grades)
        return self

    def _choose(self, sample: DataFrame) -> None:
        """Buckets whose presence depends most on grade > 0, from counts added up in Spark."""
        of = _presence(None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 1 << BITS), np.int64)
            n = np.zeros(2, np.int64)
            for batch in textvec.slices(batches, "text"):
                bad = batch.column("grade").to_numpy() > 0
                doc, bucket, *_ = of(batch.column("text"))
                n += [(~bad).sum(), bad.sum()]
                for side in (0, 1):
                    total[side] += np.bincount(bucket[bad[doc] == bool(side)], minlength=1 << BITS)
            used = np.flatnonzero(total.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[0][used], n[0])), pa.array(np.append(total[1][used], n[1]))], ["bucket", "clean", "bad"])

        got = sample.mapInArrow(run, "bucket long, clean long, bad long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).toArrow().to_pandas()
        ends = got[got.bucket == -1]
        clean, bad = float(ends.clean.sum()), float(ends.bad.sum())
        got = got[got.bucket >= 0]
        a, b = got.bad.to_numpy(float), got.clean.to_numpy(float)
        # signed chi-square of a 2 x 2 table: presence against grade
        c, d = bad - a, clean - b
        chi = (a * d - b * c) * np.abs(a * d - b * c) / np.maximum((a + b) * (c + d) * bad * clean, 1)
        rank = np.lexsort((got.bucket.to_numpy(), -np.abs(chi)))[: self.n_features]
        rank = rank[np.abs(chi[rank]) * (clean + bad) >= EVIDENCE]
        self.features = got.bucket.to_numpy()[rank]
        self.telling = chi[rank] > 0  # on the side of toxic text

    def _features(self, sample: DataFrame):
        of = _presence(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in textvec.slices(batches, "text"):
                doc, col, count, words = of(batch.column("text"))
                at = textvec.bounds(doc, batch.num_rows)
                cols = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(col, pa.int32()))
                vals = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(count, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(words.astype(np.int64)), cols, vals], ["grade", "words", "cols", "vals"])

        got = sample.mapInArrow(run, "grade int, words long, cols array<int>, vals array<int>").toArrow().combine_chunks()
        n = got.num_rows
        empty = np.zeros(0, np.int64)
        self._words = got.column("words").to_numpy() if n else empty
        size = got.column("cols").combine_chunks().value_lengths().to_numpy() if n else empty
        cols = got.column("cols").combine_chunks().flatten().to_numpy() if n else empty
        vals = got.column("vals").combine_chunks().flatten().to_numpy() if n else empty
        return np.repeat(np.arange(n), size), cols, vals, (got.column("grade").to_numpy() if n else empty)

    def _degrees(self, rows, cols, vals, grades):
        told = np.bincount(rows, vals * self.telling[cols], minlength=len(grades))
        bad = grades > 0
        return np.where(bad & (told > np.median(told[bad])), 2, grades)

    def _regress(self, rows, cols, vals, grades) -> None:
        n, k = len(grades), max(1, int(grades.max(initial=0)))
        x = np.log1p(vals)
        w = np.zeros(max(len(self.features), 1))
        # thresholds: the first, and logs of the steps to the next ones, so that their order is kept
        share = [np.clip((grades >= j).mean() if n else 0.0, 1e-6, 1 - 1e-6) for j in range(1, k + 1)]
        t = np.maximum.accumulate(np.log(1 / np.array(share) - 1) + np.arange(k) * 1e-3)
        theta = np.concatenate([w, t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        onehot = np.eye(k + 1)[np.clip(grades, 0, k)] if n else np.zeros((0, k + 1))
        for step in range(1, STEPS + 1 if n else 1):
            w, t = theta[: len(w)], theta[len(w)] + np.concatenate([[0], np.cumsum(np.exp(theta[len(w) + 1 :]))])
            z = np.bincount(rows, x * w[cols], minlength=n)[:, None] - t
            p = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.zeros((n, 1))])
            cell = np.maximum(p[:, :-1] - p[:, 1:], 1e-12)
            # d(-log cell) / d z_j: z_j bounds grade j from below and grade j - 1 from above
            q = onehot / cell
            dz = (q[:, :-1] - q[:, 1:]) * p[:, 1:-1] * (1 - p[:, 1:-1])
            gw = np.bincount(cols, x * dz.sum(1)[rows], minlength=len(w)) / n + RIDGE * w
            gt = -dz.sum(0) / n
            rest = np.cumsum(gt[::-1])[::-1]
            grad = np.concatenate([gw, rest[:1], rest[1:] * np.exp(theta[len(w) + 1 :])])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w, self.t = theta[: len(w)], theta[len(w)] + np.concatenate([[0], np.cumsum(np.exp(theta[len(w) + 1 :]))])
        s = self._severity(np.bincount(rows, x * self.w[cols], minlength=n)).sum(1)
        bad = grades > 0
        order = np.argsort(s, kind="stable")
        g = bad[order].astype(int)
        errors = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum((1 - g)[::-1])[::-1], [0]])
        best = int(np.argmin(errors))
        s = np.concatenate([[0.0], s[order], [float(k) + 1]])
        self.cut = float((s[best] + s[best + 1]) / 2) if n else float("inf")

    def _severity(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.t, -30, 30)))

    def transform(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        k = len(self.t)
        names = [f"p{j}" for j in range(1, k + 1)]
        model = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in textvec.slices(batches, "text"):
                p = model.value.chances(batch.column("text"))
                s = p.sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(p[:, j]) for j in range(k)), pa.array(s), pa.array(s >= model.value.cut)], ["key", *names, "severity", "toxic"])

        kind = rows.schema["key"].dataType.simpleString()
        return rows.mapInArrow(run, f"key {kind}, {', '.join(f'{n} double' for n in names)}, severity double, toxic boolean").withColumnRenamed("key", key)

    def chances(self, column: pa.Array) -> np.ndarray:
        """P(grade >= j) of each text, for j from 1."""
        doc, col, count, _ = _presence(self.features)(column)
        return self._severity(np.bincount(doc, np.log1p(count) * self.w[col], minlength=len(column)).astype(float))

    def clean(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows of docs that are not toxic, with their columns."""
        model = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in textvec.slices(batches, text):
                yield batch.filter(pa.array(model.value.chances(batch.column(text)).sum(1) < model.value.cut))

        return docs.mapInArrow(run, docs.schema)
