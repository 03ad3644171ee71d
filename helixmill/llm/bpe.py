"""Byte-level BPE encoding and decoding over a global shuffle of distinct pre-tokens.

1. Each task cuts its documents into blocks. A block numbers its distinct pre-tokens and keeps, for every document, the
   numbers in text order (the positions). Blocks are written once, bucketed by block.
2. The blocks' distinct pre-tokens meet in a shuffle by pre-token. There each distinct pre-token is encoded once.
3. The ids go back to their blocks in a second shuffle; the positions do not move. Each document is put together from
   its positions. Decoding gathers the bytes of each id from the token table.

What moves is a sorted list of pre-tokens for each block and part of the hash space, not a row for each occurrence, so a
pre-token that is in every document costs one entry in each block."""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stage
from .textvec import slices

BLOCK_BYTES = 24 << 20
#: Encoded pre-tokens that a task holds (about 150 bytes each).
KNOWN = 2_000_000
#: A vocabulary is broadcast; a larger one than this is refused.
MAX_VOCABULARY = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank. The file is read on the driver."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_VOCABULARY} are broadcast")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: again and again the adjacent pair of lowest rank is joined, the leftmost of equals first.

    The pairs wait in a heap, so that a very long pre-token takes n log n steps."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not alive[i] or mid >= n or end[mid] != stop:
            continue  # one of its two parts has changed meanwhile
        end[i], alive[mid] = stop, False
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _pack(items: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, items), np.uint32, len(items))
    return zlib.compress(len(items).to_bytes(4, "little") + sizes.tobytes() + b"".join(items), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    raw = zlib.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, np.uint32, n, 4), raw[4 + 4 * n :]


_BLOCK = "block long, row_ids array<binary>, n array<int>, at binary, parts array<binary>"


def _blocks(pattern: str, n_parts: int, key: str, text: str):
    class Numbers(dict):
        def __missing__(self, k: str) -> int:
            v = self[k] = len(self)
            return v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        block = (TaskContext.get().partitionId() << 32) - 1
        for batch in slices(batches, text, BLOCK_BYTES):
            block += 1
            numbers = Numbers()
            number = numbers.__getitem__
            ids = [None if k is None else str(k).encode() for k in batch.column(key).to_pylist()]
            at, counts = [], []
            for x in batch.column(text):
                found = find(x.as_py() or "")
                counts.append(len(found))
                at.append(np.fromiter(map(number, found), np.uint32, len(found)))
            parts: list[list[tuple[bytes, int]]] = [[] for _ in range(n_parts)]
            for w, i in numbers.items():
                b = w.encode()
                parts[zlib.crc32(b) % n_parts].append((b, i))
            renumber, done = np.zeros(len(numbers), np.uint32), 0
            for p in parts:
                p.sort()
                renumber[[i for _, i in p]] = np.arange(done, done + len(p), dtype=np.uint32)
                done += len(p)
            places = renumber[np.concatenate(at)] if at else renumber[:0]
            packed = [_pack([b for b, _ in p]) if p else None for p in parts]
            yield pa.RecordBatch.from_pydict(
                {"block": [block], "row_ids": [ids], "n": pa.array([counts], pa.list_(pa.int32())), "at": [zlib.compress(places.tobytes(), 1)], "parts": pa.array([packed], pa.list_(pa.binary()))}
            )

    return run


def _encoded(ranks: Broadcast):
    """Rows of one pre-token are all in one task, which encodes it when it first comes. At most KNOWN encoded pre-tokens are
    held; then they are forgotten and encoded anew when they come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = ranks.value, {}
        for batch in batches:
            for block, part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, data = _unpack(packed)
                out, start = [], 0
                for n in sizes.tolist():
                    w = data[start : start + n]
                    start += n
                    ids = seen.get(w)
                    if ids is None:
                        if len(seen) >= KNOWN:
                            seen.clear()
                        ids = seen[w] = np.array(merge(w, table), np.uint32).tobytes()
                    out.append(ids)
                yield pa.RecordBatch.from_pydict({"block": [block], "part": pa.array([part], pa.int32()), "ids": [_pack(out)]})

    return run


def _gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[offsets[w]:offsets[w + 1]] for each w of which, end to end, and where each ends."""
    size = (offsets[1:] - offsets[:-1])[which]
    ends = np.cumsum(size)
    index = np.repeat(offsets[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return values[index], ends


def _assembled(key_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
                for x in row["lists"] or []:
                    s, data = _unpack(x["ids"])
                    sizes.append(s // 4)
                    ids.append(np.frombuffer(data, np.uint32))
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
                flat = np.concatenate(ids)
                at = np.frombuffer(zlib.decompress(row["at"]), np.uint32)
                counts = np.concatenate([[0], np.cumsum(row["n"], dtype=np.int64)])
                keys = pa.array([None if k is None else k.decode() for k in row["row_ids"]], pa.string()).cast(key_kind)
                for lo in range(0, len(keys), 256):  # so that ids of a few documents are in memory at once
                    hi = min(lo + 256, len(keys))
                    got, ends = _gather(flat, offsets, at[counts[lo] : counts[hi]])
                    ends = np.concatenate([[0], ends])[counts[lo : hi + 1] - counts[lo]]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(got.astype(np.int32), pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys[lo:hi], lists], ["key", "ids"])

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", then=None, then_schema: str | None = None) -> DataFrame:
    """key and ids array<int> of each row's text; null and empty texts have no ids, repeated rows and keys stay as they are.

    then: a function from batches of (key, ids) to batches of then_schema, run in the tasks that put the ids together."""
    spark = docs.sparkSession
    n = stage.partitions(spark)
    rows = docs.select(F.col(key), F.col(text))
    blocks = stage.written_by(rows.mapInArrow(_blocks(pattern, n, key, text), _BLOCK), "block", n)
    lists = (
        blocks.select("block", F.posexplode("parts").alias("part", "words")).filter("words is not null").repartition(n, "part")
        .mapInArrow(_encoded(spark.sparkContext.broadcast(ranks)), "block long, part int, ids binary")
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("lists"))
    )
    kind = rows.schema[key].dataType.simpleString()
    put = _assembled(_arrow_kind(rows, key))
    both = blocks.select("block", "row_ids", "n", "at").join(lists, "block", "left")
    if then is None:
        return both.mapInArrow(put, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
    return both.mapInArrow(lambda batches: then(put(batches)), then_schema)


def _arrow_kind(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


class TokenBytes:
    """The token table as one vector of bytes with offsets: its join with ids is a gather."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = {i: b for b, i in ranks.items()}
        top = max(by_id, default=-1) + 1
        self.data = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(by_id.get(i, b"")) for i in range(top)], dtype=np.int64)])

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.offsets) - 1):
            raise ValueError("an id is outside the vocabulary")
        return _gather(self.data, self.offsets, ids)[0].tobytes()


def decode(encoded: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the decoded bytes of each row's ids (null ids: empty); an id outside the vocabulary is an error."""
    table = encoded.sparkSession.sparkContext.broadcast(TokenBytes(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [table.value.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """For each row: key, n_tokens, (with_ids: ids,) and SHA-256 of its ids (little-endian, 32 bits each) and of the bytes they decode to."""
    table = docs.sparkSession.sparkContext.broadcast(TokenBytes(ranks))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: Any = batch.column(1)
            flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
            n, coded, plain = [], [], []
            for i in range(len(lists)):
                ids = flat[off[i] : off[i + 1]]
                n.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                plain.append(hashlib.sha256(table.value.decode(ids)).hexdigest())
            ids = [lists] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *ids, pa.array(coded), pa.array(plain)], names)

    names = ["key", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string"
    return encode(docs, ranks, pattern, key, text, digest, schema).withColumnRenamed("key", key)
