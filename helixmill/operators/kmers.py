"""Spaced k-mers of sequences and what is counted on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from helixmill.functions.dna import Shape
from helixmill.staging import written


#: Positions of one Arrow batch: rows made from a long sequence leave in pieces of so many.
PIECE = 1 << 18
#: Positions whose keys are combined before they leave Python.
COMBINED = 1 << 22
#: A sequence with more positions is not made distinct in one piece.
LONG = 1 << 22

_CODE = np.full(256, -1, np.int8)
_CODE[list(b"ACGT")] = range(4)


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base codes of all rows end to end (-1: not A, C, G or T), and the n + 1 offsets of the rows. A letter of several bytes
    is one position."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if len(raw) and raw.max() > 127:
        first = (raw & 0xC0) != 0x80
        raw, off = raw[first], np.concatenate([[0], np.cumsum(first)])[off]
    return _CODE[raw], off


def _keys(code: np.ndarray, take: tuple[int, ...], length: int, reverse: bool) -> np.ndarray:
    """The packed key at each position of a run of codes; -1 where a taken position has no base."""
    n = len(code) - length + 1
    key, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for o in take:
        c = code[length - 1 - o : length - 1 - o + n] if reverse else code[o : o + n]
        bad |= c < 0
        key <<= 2
        key |= (3 - c if reverse else c).astype(np.int64)
    key[bad] = -1
    return key


def _some_rows(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, codes, offsets) of successive rows of a batch whose sequences have about `most` bytes together, or of one longer row."""
    column = batch.column("_sequence")
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, *_coded(column.slice(at, end - at))
        at = end


def _stretches(batch: pa.RecordBatch, shape: Shape, fill: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, position, forward key, reverse key, bad) of all positions of a batch's sequences, PIECE at a time."""
    length, take = len(shape), shape.take
    for base, code, off in _some_rows(batch, 8 * PIECE):
        if fill is not None:
            code = np.where(code < 0, np.int8(fill), code)
        for at in range(0, len(code) - length + 1, PIECE):
            part = code[at : at + PIECE + length - 1]
            fw, rv = _keys(part, take, length, False), _keys(part, take, length, True)
            start = np.arange(at, at + len(fw))
            row = np.searchsorted(off, start, "right") - 1
            own = start + length <= off[row + 1]
            row, fw, rv = row[own], fw[own], rv[own]
            yield row + base, start[own] - off[row], fw, rv, (fw < 0) | (rv < 0)


def kmers(df: DataFrame, sequence: str, shape: Shape, keep: list[str], skip_ambiguous: bool = True, strands: bool = False, unknown_as: str | None = None) -> DataFrame:
    """keep, pos and canonical key (and fw, rv, the keys of either strand) of every position of every sequence.

    Each sequence is coded once in an Arrow batch, and a key is a sum of shifted slices of the codes, so no substring is cut
    and a sequence of any length leaves in pieces of PIECE rows. A key over a letter other than A, C, G, T (lower case too)
    is skipped, or null (skip_ambiguous=False), or reads that letter as the base unknown_as. Null sequences and those
    shorter than the shape have no keys. The reverse key is that of the reverse complement, read under the same shape; with
    a palindromic shape the canonical key is the same from either strand. Columns that are not kept never reach Python;
    kept columns may not be called pos, key, fw or rv."""
    made = ["pos", "key", *(["fw", "rv"] if strands else [])]
    rows = _rows(df, sequence, keep, made)
    fill = None if unknown_as is None else "ACGT".index(unknown_as)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pos, fw, rv, bad in _stretches(batch, shape, fill):
                own = np.flatnonzero(~bad) if skip_ambiguous else np.arange(len(row))
                if not len(own):
                    continue
                none = None if skip_ambiguous else bad
                columns = [batch.column(c).take(pa.array(row[own])) for c in keep]
                columns.append(pa.array(pos[own].astype(np.int32)))
                columns += [pa.array(k[own], mask=none) for k in (np.minimum(fw, rv), *((fw, rv) if strands else ()))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *made])

    fields = [rows.schema[c] for c in keep] + [StructField("pos", IntegerType()), *(StructField(c, LongType()) for c in made[1:])]
    return rows.mapInArrow(run, StructType(fields))


def counted(df: DataFrame, sequence: str, shape: Shape, keep: list[str] | None = None) -> DataFrame:
    """(keep, key, n, n_forward): how often canonical keys occur, and how often the forward key is the smaller one.

    Keys of COMBINED positions of whatever sequences are combined before they leave Python, so that fewer rows than positions do;
    a key may come in several rows, which the caller adds up. They are sorted in place in one array that a task keeps, with the
    strand in the lowest bit. With keep, Spark adds up the keys by keep. Ambiguous keys are skipped."""
    if keep:
        each = kmers(df, sequence, shape, keep, strands=True)
        return each.groupBy(*keep, "key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fw") < F.col("rv")).alias("n_forward"))
    rows = _rows(df, sequence, [], ["key", "n", "n_forward"])

    def emitted(packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        packed.sort()
        at = 0
        while at < len(packed):
            end = int(np.searchsorted(packed, packed[min(at + PIECE, len(packed)) - 1] | 1, "right"))  # not within a key's run
            part, at = packed[at:end], end
            key = part >> 1
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(np.diff(np.append(first, len(key)))), pa.array(np.add.reduceat(part & 1, first))], ["key", "n", "n_forward"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(COMBINED, np.int64), 0
        for batch in batches:
            for _, _, fw, rv, bad in _stretches(batch, shape, None):
                packed = (np.minimum(fw, rv) << 1 | (fw < rv))[~bad]
                if n + len(packed) > COMBINED:
                    yield from emitted(held[:n])
                    n = 0
                held[n : n + len(packed)] = packed
                n += len(packed)
        yield from emitted(held[:n])

    return rows.mapInArrow(run, "key long, n long, n_forward long")


def by_sequence(df: DataFrame, sequence: str, shape: Shape, by: str) -> DataFrame:
    """(by, n_kmers, n_distinct, min_key, max_key, n_forward) of the sequences of each value of `by` that have a key.

    A sequence is whole in its Arrow batch, so its distinct keys are counted there and one row leaves Python. Only keys of sequences
    longer than LONG, and of values of `by` that come in several rows, are made distinct by a shuffle. Ambiguous keys are skipped."""
    made = ["n_kmers", "n_distinct", "min_key", "max_key", "n_forward"]
    rows = _rows(df, sequence, [by], made)
    length, bits = len(shape), 2 * shape.k + 1

    def summed(row: np.ndarray, packed: np.ndarray, whole: bool) -> list[np.ndarray]:
        if whole and bits + int(row[-1]).bit_length() < 63:
            joint = row << bits | packed
            joint.sort()
            row, packed = joint >> bits, joint & ((1 << bits) - 1)
        elif whole:
            order = np.lexsort((packed, row))
            row, packed = row[order], packed[order]
        key = packed >> 1
        other = np.concatenate([[True], row[1:] != row[:-1]])
        at = np.flatnonzero(other)
        new = other | np.concatenate([[True], key[1:] != key[:-1]])
        return [row[at], np.diff(np.append(at, len(row))), np.add.reduceat(new.astype(np.int64), at), np.minimum.reduceat(key, at), np.maximum.reduceat(key, at), np.add.reduceat(packed & 1, at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, code, off in _some_rows(batch, min(PIECE, LONG)):
                whole = len(code) <= LONG
                for at in range(0, len(code) - length + 1, LONG):
                    part = code[at : at + LONG + length - 1]
                    fw, rv = _keys(part, shape.take, length, False), _keys(part, shape.take, length, True)
                    start = np.arange(at, at + len(fw))
                    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(fw)] if whole else np.zeros(len(fw), np.int64)
                    own = (start + length <= off[row + 1]) & (fw >= 0) & (rv >= 0)
                    if not own.any():
                        continue
                    row, *values = summed(row[own], (np.minimum(fw, rv) << 1 | (fw < rv))[own], whole)
                    values = [pa.array(v) for v in values]
                    if not whole:
                        values[1] = pa.nulls(len(row), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array(row + base)), *values], [by, *made])

    each = written(rows.mapInArrow(run, StructType([rows.schema[by], *(StructField(c, LongType()) for c in made)])))
    total = each.groupBy(by).agg(F.sum("n_kmers").alias("n_kmers"), F.sum("n_distinct").alias("n_distinct"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.sum("n_forward").alias("n_forward"), F.count("n_distinct").alias("_done"), F.count(F.lit(1)).alias("_rows"))
    done = (F.col("_done") == 1) & (F.col("_rows") == 1)
    if total.filter(~done).isEmpty():
        return total.select(by, *made)
    total = written(total)
    open_ = total.filter(~done).select(F.col(by).alias("_by"))
    keys = kmers(df.join(open_, F.col(by).eqNullSafe(F.col("_by")), "left_semi"), sequence, shape, [by]).select(by, "key").distinct()
    n = keys.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    joined = total.join(n, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.select(by, "n_kmers", F.when(done, F.col("n_distinct")).otherwise(F.col("_n")).alias("n_distinct"), *made[2:])


def occurrences(df: DataFrame, sequence: str, shape: Shape, keep: list[str]) -> DataFrame:
    """(key, at): the places of each canonical key, at array<struct<keep, pos>>. Keys of COMBINED positions, of whatever sequences,
    are made distinct before they leave Python; a key may come in several rows. Ambiguous keys are skipped.

    A join on the key thus moves distinct keys with lists of places, and places become rows after it: explode("at")."""
    rows = _rows(df, sequence, keep, ["pos", "key", "at"])
    fields = [rows.schema[c] for c in keep] + [StructField("pos", IntegerType())]

    def emitted(waiting: list[tuple[np.ndarray, list[pa.Array]]]) -> pa.RecordBatch:
        key = np.concatenate([k for k, _ in waiting])
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        columns = [pa.concat_arrays(list(c)).take(pa.array(order)) for c in zip(*(p for _, p in waiting), strict=True)]
        places = pa.StructArray.from_arrays(columns, [*keep, "pos"])
        return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.ListArray.from_arrays(pa.array(np.append(at, len(key)), pa.int32()), places)], ["key", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, list[pa.Array]]] = []
        for batch in batches:
            for row, pos, fw, rv, bad in _stretches(batch, shape, None):
                own = np.flatnonzero(~bad)
                if not len(own):
                    continue
                columns = [batch.column(c).take(pa.array(row[own])) for c in keep]
                waiting.append((np.minimum(fw, rv)[own], [*columns, pa.array(pos[own].astype(np.int32))]))
                if sum(len(k) for k, _ in waiting) >= COMBINED:
                    yield emitted(waiting)
                    waiting = []
        if waiting:
            yield emitted(waiting)

    return rows.mapInArrow(run, StructType([StructField("key", LongType()), StructField("at", ArrayType(StructType(fields)))]))


def _rows(df: DataFrame, sequence: str, keep: list[str], made: list[str]) -> DataFrame:
    if clash := set(keep) & set(made):
        raise ValueError(f"kept columns clash with {sorted(clash)}")
    return df.select(*keep, F.col(sequence).cast("string").alias("_sequence"))


def pieces(df: DataFrame, sequence: str, shape: Shape, length: int) -> DataFrame:
    """df with long sequences cut into pieces of `length` positions (which overlap by the shape) and the column `start` of
    each piece, so that one chromosome is the work of many tasks once the pieces are repartitioned."""
    n = F.greatest(F.length(sequence) - (len(shape) - 1), F.lit(1))
    starts = F.sequence(F.lit(0), F.floor((n - 1) / length).cast("int"))
    rows = df.withColumn("start", F.explode(F.transform(starts, lambda i: i * length)))
    return rows.withColumn(sequence, F.substring(sequence, F.col("start") + 1, F.lit(length + len(shape) - 1)))


def prefix_histogram(counts: DataFrame, key_bits: int, prefix_bits: int) -> DataFrame:
    """k-mers and distinct k-mers of each key prefix, from counted(). Keys are added up first, so that the distinct count
    needs one shuffle of distinct keys and a second one of prefixes only."""
    each = counts.groupBy("key").agg(F.sum("n").alias("n"))
    return each.groupBy(F.shiftright("key", key_bits - prefix_bits).alias("prefix")).agg(F.sum("n").alias("n_kmers"), F.count(F.lit(1)).alias("n_distinct"))


def prefix_estimate(rows: DataFrame, key_bits: int, prefix_bits: int) -> DataFrame:
    """Approximate distinct keys of each prefix, with a relative standard deviation of 0.02: sketches are merged, keys are not shuffled."""
    return rows.groupBy(F.shiftright("key", key_bits - prefix_bits).alias("prefix")).agg(F.approx_count_distinct("key", 0.02).alias("n_distinct"))


def multiplicities(counts: DataFrame) -> DataFrame:
    """How many keys occur how often, from counted()."""
    each = counts.groupBy("key").agg(F.sum("n").alias("times"))
    return each.groupBy("times").agg(F.count(F.lit(1)).alias("n_keys"))
