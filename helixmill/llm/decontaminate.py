"""Benchmark decontamination: MinHash containment search for short items in documents of any length.

Containment of an item in a document is the share of the item's distinct shingles that the document holds. For a hash
function, the item's minwise shingle is a uniform draw from its shingles, so a document that contains a share t of them
holds that one with probability t: the share of an item's functions whose minwise shingle a document holds estimates the
containment, at any length of the document. No signature of the document is needed, which is what defeats a plain MinHash
comparison of short items with long documents.

Items are partitioned by their number of shingles into powers of two. A partition has its own number of functions, and its
own number of them that must be held before a document is a candidate: items of few shingles are asked for by all of them,
which is exact; larger ones by more functions the larger they are, as many of which must be held as a containment at the
threshold falls short of with a chance of at most MISS. So a shingle that very many documents share makes no candidates of
them. Candidates are confirmed by exact shingle containment on the whole document.

Sets and minwise shingles of items are made in Spark. Blocks of items of like size, of BLOCK_BYTES each, are broadcast; every
block is held against all documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec

MISS = 1e-9
#: Items of at most so many shingles are asked for by all of them.
WHOLE = 16
#: Bytes of shingles of the items in one broadcast; an item with more is alone.
BLOCK_BYTES = 32 << 20
_FILTER_BITS = 22


def partition_of(size: int) -> int:
    """The partition of items with so many shingles: the power of two that holds them."""
    return max(0, math.ceil(math.log2(max(size, 1))))


def functions_for(size: int, threshold: float) -> tuple[int, int]:
    """How many minwise shingles an item of `size` shingles is asked for by, and how many of them a candidate holds."""
    if size <= WHOLE:
        return size, math.ceil(threshold * size - 1e-9)
    n = 16 + 4 * (partition_of(size) - 4)
    below, need = 0.0, 0
    while need < n:
        below += math.comb(n, need) * threshold**need * (1 - threshold) ** (n - need)
        if below > MISS:
            break
        need += 1
    return n, max(need, 1)


def minwise(shingles: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct minwise shingles of a set under n hash functions, and how many functions chose each; the whole set, each
    once, if it has no more than n."""
    if len(shingles) <= n:
        return shingles, np.ones(len(shingles), np.int64)
    salts = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique([shingles[np.argmin(textvec.mix(shingles ^ s))] for s in salts], return_counts=True)


class Items:
    """A block of items: their shingle sets and, sorted, the minwise shingles by which documents find them."""

    def __init__(self, ids: list, sets: list[np.ndarray], threshold: float):
        self.ids, self.sets = ids, sets
        plans = [functions_for(len(s), threshold) for s in sets]
        found = [minwise(s, n) for s, (n, _) in zip(sets, plans, strict=True)]
        probe = np.concatenate([*(f for f, _ in found), np.zeros(0, np.uint64)]).astype(np.uint64)
        chosen = np.concatenate([*(c for _, c in found), np.zeros(0, np.int64)]).astype(np.int64)
        item = np.repeat(np.arange(len(sets)), [len(f) for f, _ in found])
        order = np.argsort(probe, kind="stable")
        self.probe, self.item, self.chosen = probe[order], item[order], chosen[order]
        self.need = np.array([need for _, need in plans], np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.probe >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True


def _search(items: Items, column: pa.Array, k: int, threshold: float) -> tuple[list[int], list[int], list[float]]:
    """Rows of a text column, items of the block that they contain, and how much of the item."""
    h, doc = textvec.shingles(textvec.words(column), k)
    at = textvec.bounds(doc, len(column))
    some = np.flatnonzero(items.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    lo, hi = np.searchsorted(items.probe, h[some], "left"), np.searchsorted(items.probe, h[some], "right")
    hit = np.flatnonzero(hi > lo)
    # a document asks once for each distinct shingle
    pair = np.stack([doc[some[hit]], lo[hit], hi[hit]], 1)
    pair = np.unique(pair, axis=0) if len(pair) else pair
    n = pair[:, 2] - pair[:, 1]
    ends = np.cumsum(n)
    place = np.repeat(pair[:, 1] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    code, at_code = np.unique(np.repeat(pair[:, 0], n) * len(items.ids) + items.item[place], return_inverse=True)
    held = np.bincount(at_code, items.chosen[place], minlength=len(code))
    row, item = np.divmod(code, max(len(items.ids), 1))
    good = held >= items.need[item]
    rows, ids, share, of, own = [], [], [], -1, h[:0]
    for d, i in zip(row[good].tolist(), item[good].tolist(), strict=True):
        if d != of:
            of, own = d, np.unique(h[at[d] : at[d + 1]])
        both = len(np.intersect1d(items.sets[i], own, assume_unique=True))
        if both >= threshold * len(items.sets[i]) - 1e-9:
            rows.append(d)
            ids.append(i)
            share.append(both / len(items.sets[i]))
    return rows, ids, share


def _item_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.slices(batches, "text"):
            h, doc = textvec.shingles(textvec.words(batch.column("text")), k)
            at = textvec.bounds(doc, batch.num_rows)
            sets = [np.unique(h[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
            part = [partition_of(len(s)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(part, pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["item", "part", "shingles"])

    return run


def _blocks(benchmark: DataFrame, k: int, threshold: float) -> Iterator[Items]:
    """Blocks of items, partition by partition; in the driver is one block at a time."""
    rows = benchmark.select(F.col("item_id").alias("item"), "text").filter("text is not null")
    sets = rows.mapInArrow(_item_sets(k), f"item {_kind(benchmark)}, part int, shingles binary").filter("part is not null").orderBy("part")
    ids, held, size = [], [], 0
    for r in sets.toLocalIterator():
        if size and size + len(r.shingles) > BLOCK_BYTES:
            yield Items(ids, held, threshold)
            ids, held, size = [], [], 0
        ids.append(r["item"])
        held.append(np.frombuffer(r.shingles, np.uint64))
        size += len(r.shingles)
    if ids:
        yield Items(ids, held, threshold)


def _kind(benchmark: DataFrame) -> str:
    return benchmark.schema["item_id"].dataType.simpleString()


def containments(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, containment) for each row of docs and each item, whose id may have any type, with at least `threshold` of the item's distinct
    k-word shingles in the row's text; an item of fewer than k words is one shingle of all its words, which only a
    document of exactly these words has.

    Where the key is called item_id, the item's column is `item`. Null and empty texts and items contain nothing and are contained in nothing. Null keys and repeated rows give rows
    like others; items with a null id are searched too; other columns are ignored."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    item = "item" if key == "item_id" else "item_id"
    schema = f"key {kind}, {item} {_kind(benchmark)}, containment double"
    out = None
    for items in _blocks(benchmark, k, threshold):
        part = _found(rows, benchmark, items, k, threshold, schema, item)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("key", key)


def _found(rows: DataFrame, benchmark: DataFrame, items: Items, k: int, threshold: float, schema: str, name: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    shared, item_type = rows.sparkSession.sparkContext.broadcast(items), to_arrow_type(benchmark.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.slices(batches, "text"):
            row, item, share = _search(shared.value, batch.column("text"), k, threshold)
            ids = [shared.value.ids[i] for i in item]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int64())), pa.array(ids, item_type), pa.array(share, pa.float64())], ["key", name, "containment"])

    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with their columns."""
    for items in _blocks(benchmark, k, threshold):
        docs = _without(docs, items, k, threshold, text)
    return docs


def _without(docs: DataFrame, items: Items, k: int, threshold: float, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.slices(batches, text):
            keep = np.ones(batch.num_rows, bool)
            keep[_search(shared.value, batch.column(text), k, threshold)[0]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
