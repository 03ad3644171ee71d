"""Alignment of two tokenizers' tokens over the same bytes.

The relational core (`tokens`, `groups`, `links`) works on units of text with two lists of tokens: tokens are exploded with their
positions, a window adds up their lengths, the two sides meet in an equi-join on unit and end, a running count of the
ends that both have is the group of each token, and links come from a join of each group's distinct ids.

Documents are not exploded into rows of tokens. They are cut into segments, only where neither tokenizer can join what lies on the
two sides (`segment_pattern`), so that every segment's end is an end of both and a segment is aligned alike wherever it occurs:

1. Each task numbers the distinct segments of a block of documents; the documents keep the numbers in text order.
2. Distinct segments meet in one shuffle, are encoded once by each tokenizer, and are aligned by the relational core.
3. What was found goes back to the segments' blocks, where each document counts a pair once; the counts are added up for all documents.
4. The counts of a block's distinct pairs go back, and each document adds up its segments and hashes their groups.

What moves is a compressed list for each block and part of the hash space, of distinct segments and what was found for them,
whatever the number of occurrences. A task holds the distinct segments of its part, which are fewer the more shuffle partitions there are.

Awkward rows: null and empty texts, and texts that either tokenizer does not give back byte for byte, have zeros and '' and count for no
pair. Repeated rows and keys are documents of their own; keys may be null; other columns are not read. A text without a place to cut is
one segment, whatever its length. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stage
from .bpe import _gather
from .textvec import slices

BLOCK_BYTES = 10 << 20
#: Segments that become an Arrow array at once, and marks of documents for pairs that are held at once.
AT_ONCE, MARKS = 100_000, 4 << 20
#: Distinct segments that a task remembers while it leaves out repeated ones.
KNOWN = 2_000_000
#: Both vocabularies are sent to every executor; larger files than this are refused.
MAX_FILE = 64 << 20
_SPACE = "▁"
#: Latin and Cyrillic letters: a part of all letters, and the ones that cuts before punctuation are made after.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ʯЀ-ҁҊ-ԯ"


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class ByteLevel:
    """A byte-level BPE from a `tokenizers` file. Special tokens inside texts are plain text."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.encode_special_tokens = True
        table = _byte_of_char()
        entries = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(entries.values(), default=-1) + 1)
        for token, i in entries.items():
            self.bytes[i] = bytes(table[c] for c in token)

    def encode(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]


class Pieces:
    """A `sentencepiece` model that puts a space before a text and falls back to bytes."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        n = self.model.vocab_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    def encode(self, segments: list[str]) -> list[list[int]]:
        """Of segments of text with its space before it. One that begins with a space has it as the model's own; before another,
        a line end stands in for what was cut off, since no piece joins it with anything: it costs two pieces."""
        own = [s[:1] == " " and s != " " for s in segments]  # nothing is put before an empty text
        got = self.model.encode([s[1:] if o else "\n" + s for s, o in zip(segments, own, strict=True)], num_threads=1)
        return [g if o else g[2:] for g, o in zip(got, own, strict=True)]


def segment_pattern(pieces: list[str]) -> str:
    """A pattern whose matches cut a text where neither tokenizer joins the two sides.

    Byte-level pre-tokens hold white space only at their start or throughout, so they end before white space that follows anything
    else, and between a letter and punctuation. Pieces: as this vocabulary shows. A space begins pieces and is never
    inside one; nothing is joined with a line end; no piece has a letter followed by the punctuation that is cut before.
    Where the vocabulary is otherwise, a text is one segment."""
    whole = r"(?s).+"
    joined = [p for p in pieces if len(p) > 1]
    if any("\n" in p for p in joined) or any(_SPACE in p.lstrip(_SPACE) for p in joined):
        return whole
    import re

    after = [re.findall(rf"(?<=[{_LETTERS}])[{re.escape(string.punctuation)}]", p) for p in joined]
    bars = set(string.punctuation) - {c for found in after for c in found}
    cut = re.escape("".join(sorted(bars)))
    head = rf"\s*[{_LETTERS}]+(?=[{cut} \n]|\Z)|" if bars else ""
    return rf"{head}\s*\S+(?:[^\S \n]\s*\S*)*|\s+"


@dataclass(frozen=True)
class Pair:
    """The files of the two tokenizers, as bytes."""

    a: bytes
    b: bytes

    @staticmethod
    def load(path_a: str, path_b: str) -> Pair:
        """Both files are read on the driver."""
        out = []
        for path in (path_a, path_b):
            with open(path, "rb") as f:
                out.append(f.read(MAX_FILE + 1))
            if len(out[-1]) > MAX_FILE:
                raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
        return Pair(*out)


# ---- the relational core ----


def _ends(units: DataFrame, ids: str, lengths: str, name: str) -> DataFrame:
    """(unit, end, name) of each token: its end is the sum of the lengths up to it."""
    rows = units.select("unit", F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col(lengths).alias("n"))).alias("pos", "t"))
    up_to = Window.partitionBy("unit").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("unit", F.sum("t.n").over(up_to).alias("end"), F.col("t.id").alias(name))


def tokens(units: DataFrame) -> DataFrame:
    """(unit, end, a, b, grp): the tokens of both sides of units (unit, a, a_len, b, b_len), one of a and b null. grp: how many ends
    that both sides have lie before the token's own.

    Windows and joins all keep units together: with units in buckets and stage.joined_in_place() no row moves."""
    sides = {x: _ends(units, x, f"{x}_len", x) for x in "ab"}
    before = Window.partitionBy("unit").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for x, y in ("ab", "ba"):
        both = sides[x].join(sides[y].select("unit", "end", F.lit(1).alias("common")), ["unit", "end"], "left")
        grp = F.coalesce(F.sum("common").over(before), F.lit(0))
        out.append(both.select("unit", "end", F.col(x), F.lit(None).cast("int").alias(y), grp.alias("grp")))
    return out[0].unionByName(out[1])


def _listed(side: str):
    rows = F.sort_array(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", side))))
    return F.concat_ws(",", F.transform(rows, lambda x: x[side].cast("string")))


def groups(found: DataFrame) -> DataFrame:
    """(unit, n_a, n_b, n_groups, n_links, groups) of tokens(): groups is each group's `a1,a2|b1`, parted by `;`, in order."""
    each = found.groupBy("unit", "grp").agg(F.count("a").alias("x"), F.count("b").alias("y"), F.concat(_listed("a"), F.lit("|"), _listed("b")).alias("text"))
    text = F.concat_ws(";", F.transform(F.sort_array(F.collect_list(F.struct("grp", "text"))), lambda g: g["text"]))
    return each.groupBy("unit").agg(
        F.sum("x").alias("n_a"), F.sum("y").alias("n_b"), F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("x") * F.col("y")).alias("n_links"), text.alias("groups")
    )


def links(found: DataFrame) -> DataFrame:
    """(unit, pair, n): how often each pair of ids is linked in a unit. A pair is a long: a's id above b's. Ids repeated in a
    group are counted before the sides are joined."""
    a, b = (found.filter(F.col(x).isNotNull()).groupBy("unit", "grp", x).agg(F.count(F.lit(1)).alias(f"n_{x}")) for x in "ab")
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    return a.join(b, ["unit", "grp"]).groupBy("unit", pair.alias("pair")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))


def counted(pair_docs: DataFrame) -> DataFrame:
    """(pair, docs, best) of (pair, docs): best is whether no other pair of the same a has more documents."""
    top = pair_docs.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("top"))
    return pair_docs.withColumn("a", F.shiftright("pair", 32)).join(top, "a").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best"))


# ---- documents as lists of segments ----


def _small(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _large(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: zeros lie together."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _packed_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return _small(len(words).to_bytes(8, "little") + _planes(sizes) + b"".join(words))


def _listed_words(packed: bytes) -> list[bytes]:
    raw = _large(packed)
    n = int.from_bytes(raw[:8], "little")
    ends = (np.cumsum(_numbers(raw[8 : 8 + 4 * n], "<u4"), dtype=np.int64) + 8 + 4 * n).tolist()
    return [raw[lo:hi] for lo, hi in zip([8 + 4 * n, *ends], ends, strict=False)]


def _blocks(pattern: str, key: str, text: str, size: int, n_parts: int, kind: pa.DataType):
    def made(batch: pa.RecordBatch, block: int, find) -> pa.RecordBatch:
        chunks, waiting, counts = [], [], []
        for x in batch.column(text):
            t = x.as_py()
            found = find(" " + t) if t else []
            counts.append(len(found))
            waiting += found
            if len(waiting) >= AT_ONCE:
                chunks.append(pa.array(waiting, pa.string()))
                waiting = []
        coded = pa.chunked_array([*chunks, pa.array(waiting, pa.string())]).dictionary_encode()
        words = coded.chunk(coded.num_chunks - 1).dictionary.cast(pa.binary()).to_pylist()  # all chunks have one dictionary
        at = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        del chunks, waiting, coded
        parts: list[list[tuple[bytes, int]]] = [[] for _ in range(n_parts)]
        for i, w in enumerate(words):
            parts[zlib.crc32(w) % n_parts].append((w, i))
        renumber, done = np.zeros(len(words), np.uint32), 0
        for p in parts:
            p.sort()
            renumber[[i for _, i in p]] = np.arange(done, done + len(p), dtype=np.uint32)
            done += len(p)
        packed = [_packed_words([w for w, _ in p]) if p else None for p in parts]
        keys = batch.column(key)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.cast(kind)), pa.array([counts], pa.list_(pa.int32())),
                pa.array([_small(_planes(renumber[at]))], pa.binary()), pa.array([packed], pa.list_(pa.binary())),
            ],
            ["block", "row_ids", "n", "at", "parts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        from pyspark import TaskContext

        find = re.compile(pattern).findall
        block = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(slices(batches, text, size)):
            yield made(batch, block + i, find)  # nothing of a block is held while the next one is made
            pa.default_memory_pool().release_unused()

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of lists, most of the repeated ones left out: a task remembers KNOWN of them."""
    seen: set[bytes] = set()
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            fresh = [w for w in _listed_words(packed) if w not in seen]
            if len(seen) >= KNOWN:
                seen.clear()
            seen.update(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.binary()).cast(pa.string())], ["word"])


_ENCODED = "word string, a array<int>, a_len array<int>, b array<int>, b_len array<int>, ok boolean"


def _encoded(files):
    def side(coder, segments: list[str]):
        table = np.array([len(x) for x in coder.bytes], np.int32)
        ids = coder.encode(segments)
        flat = np.fromiter((i for x in ids for i in x), np.int32)
        off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        same = [b"".join(map(coder.bytes.__getitem__, x)) == s.encode() for x, s in zip(ids, segments, strict=True)]
        return flat, table[flat], off, np.array(same, bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coders = ByteLevel(files.value.a), Pieces(files.value.b)
        for batch in slices(batches, "word", 1 << 18):
            words = batch.column("word").to_pylist()
            (a, a_len, a_off, a_ok), (b, b_len, b_off, b_ok) = (side(c, words) for c in coders)
            ok, lists = a_ok & b_ok, []
            for flat, off in ((a, a_off), (a_len, a_off), (b, b_off), (b_len, b_off)):
                lists.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("word"), *lists, pa.array(ok)], ["word", "a", "a_len", "b", "b_len", "ok"])

    return run


def _dense(numbers: list[np.ndarray], text: bytes) -> bytes:
    """Columns of whole numbers, and a text."""
    head = np.array([*map(len, numbers), len(text)], np.int64).tobytes()
    return _small(head + b"".join(_planes(x.astype("<i8")) for x in numbers) + text)


def _loose(packed: bytes, columns: int) -> tuple[list[np.ndarray], bytes]:
    raw = _large(packed)
    sizes = np.frombuffer(raw, np.int64, columns + 1).tolist()
    at, out = 8 * (columns + 1), []
    for n in sizes[:-1]:
        out.append(_numbers(raw[at : at + 8 * n], "<i8"))
        at += 8 * n
    return out, raw[at:]


#: Of each segment: whether both tokenizers give it back, its sums, and how long its groups' text and its list of pairs are.
_PER_UNIT = ["ok", "n_a", "n_b", "n_groups", "text", "links"]


class _Part:
    """What was found for the distinct segments of a part, and the lists of a block's segments with it."""

    def __init__(self, rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        self.index = {w.encode(): i for i, w in enumerate(t.column("word").to_pylist())}
        text = t.column("groups").combine_chunks().cast(pa.large_string()).fill_null("").cast(pa.large_binary())
        _, off, data = text.buffers()
        self.text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.text_off = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
        links = t.column("pairs").combine_chunks()
        sizes = links.value_lengths().fill_null(0).to_numpy()
        self.link_off = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.pairs, self.times = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("pairs", "times"))
        numbers = [t.column("ok").combine_chunks().cast(pa.int64()), *(t.column(c).combine_chunks().fill_null(0) for c in _PER_UNIT[1:4])]
        self.numbers = [*(x.to_numpy() for x in numbers), np.diff(self.text_off), sizes]

    def found(self, packed: bytes) -> bytes:
        words = _listed_words(packed)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        text, pairs, times = _gather(self.text, self.text_off, at)[0], _gather(self.pairs, self.link_off, at)[0], _gather(self.times, self.link_off, at)[0]
        return _dense([*(x[at] for x in self.numbers), pairs, times], text.tobytes())


def _attached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, part, found) for each list of a block. Rows come part by part, of each what was found for its segments first."""
    part, rows, held = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, lists = batch.column("part").to_numpy(), batch.column("block").is_valid().to_numpy(zero_copy_only=False)
        turns = np.flatnonzero((parts[1:] != parts[:-1]) | (lists[1:] != lists[:-1])) + 1
        for lo, hi in zip([0, *turns], [*turns, len(parts)], strict=True):
            if parts[lo] != part:
                part, rows, held = parts[lo], [], None
            run = batch.slice(lo, hi - lo)
            if not lists[lo]:
                rows.append(run)
                continue
            if held is None:
                held, rows = _Part(rows), []
            for block, packed in zip(run.column("block").to_pylist(), run.column("words").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([held.found(packed)], pa.binary())], ["block", "part", "found"])


def _shares(docs_off: np.ndarray, most: int, docs: int) -> Iterator[tuple[int, int]]:
    """Runs of documents with about so many segments, and at most so many documents."""
    lo = 0
    while lo < len(docs_off) - 1:
        hi = max(lo + 1, int(np.searchsorted(docs_off, docs_off[lo] + most, "right")) - 1)
        hi = min(hi, lo + docs)
        yield lo, hi
        lo = hi


class _Block:
    """A block's documents (offsets into at, which of them hold), its segments in text order, and what was found for each of these."""

    def __init__(self, row: dict):
        counts = np.array(row["n"], np.int64)
        self.at = _numbers(_large(row["at"]), "<u4")
        self.off = np.concatenate([[0], np.cumsum(counts)])
        lists = [_loose(x["found"], len(_PER_UNIT) + 2) for x in row["lists"] or []]
        columns = [np.concatenate([x[0][i] for x in lists]) if lists else np.zeros(0, np.int64) for i in range(len(_PER_UNIT) + 2)]
        self.units = dict(zip(_PER_UNIT, columns, strict=False))
        self.pairs, self.times = columns[-2:]
        self.texts = [x[1] for x in lists]
        self.link_off = np.concatenate([[0], np.cumsum(self.units["links"])])
        bad = np.concatenate([[0], np.cumsum(self.units["ok"][self.at] == 0 if len(self.at) else np.zeros(0, bool))])
        self.good = (counts > 0) & (bad[self.off[1:]] == bad[self.off[:-1]])

    def over_links(self, values: np.ndarray) -> np.ndarray:
        """For each segment the sum of values over its links."""
        running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return running[self.link_off[1:]] - running[self.link_off[:-1]]

    def pair_docs(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs and in how many documents each is linked: a few documents at a time have a mark for each pair."""
        pairs, local = np.unique(self.pairs, return_inverse=True)
        total, width = np.zeros(len(pairs), np.int64), max(len(pairs), 1)
        for lo, hi in _shares(self.off, 1 << 20, max(1, MARKS // width)):
            doc = np.repeat(np.arange(hi - lo), np.diff(self.off[lo : hi + 1]))
            keep = self.good[lo:hi][doc]
            found, ends = _gather(local, self.link_off, self.at[self.off[lo] : self.off[hi]][keep])
            marks = np.zeros((hi - lo) * width, bool)
            marks[np.repeat(doc[keep] * width, np.diff(ends, prepend=0)) + found] = True
            total += marks.reshape(hi - lo, width).sum(axis=0)
        return pairs[total > 0], total[total > 0]


def _pair_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            pairs, docs = _Block(row).pair_docs()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["block"]), pa.int64()), pa.array(pairs), pa.array(docs)], ["block", "pair", "docs"])


_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _documents(kind: pa.DataType, with_groups: bool):
    def made(one: pa.RecordBatch) -> pa.RecordBatch:
        block = _Block(one.select(["n", "at", "lists"]).to_pylist()[0])
        pairs, docs, best = (one.column("counts").flatten().field(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("pair", "docs", "best"))
        order = np.argsort(pairs)
        pairs, docs, best = pairs[order], docs[order], best[order]
        # pairs of documents that do not hold have no count
        where = np.minimum(np.searchsorted(pairs, block.pairs), max(len(pairs) - 1, 0))
        known = pairs[where] == block.pairs if len(pairs) else np.zeros(len(block.pairs), bool)
        docs, best = (np.where(known, x[where], 0) if len(pairs) else np.zeros(len(block.pairs), np.int64) for x in (docs, best))
        units = block.units | {"n_links": block.over_links(block.times), "n_best": block.over_links(block.times * best), "count_sum": block.over_links(block.times * docs)}
        columns = []
        for c in _SUMS:
            running = np.concatenate([[0], np.cumsum(units[c][block.at] if len(block.at) else np.zeros(0, np.int64), dtype=np.int64)])
            columns.append(pa.array(np.where(block.good, running[block.off[1:]] - running[block.off[:-1]], 0), pa.int64()))
        raw, ends = b"".join(block.texts), np.cumsum(units["text"]).tolist()
        text = [raw[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)].__getitem__
        digests, texts = [], []
        for j, fits in enumerate(block.good.tolist()):
            whole = b";".join(map(text, block.at[block.off[j] : block.off[j + 1]].tolist())) if fits else b""
            digests.append(hashlib.sha256(whole).hexdigest() if fits else "")
            texts.append(whole.decode() if with_groups else "")
        keys = one.column("row_ids").flatten().cast(kind)
        some = [pa.array(texts, pa.string())] if with_groups else []
        return pa.RecordBatch.from_arrays([keys, *columns, *some, pa.array(digests, pa.string())], ["key", *_SUMS, *(["groups"] if with_groups else []), "groups_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield made(batch.slice(i, 1))
                pa.default_memory_pool().release_unused()

    return run


def align(docs: DataFrame, pair: Pair, key: str = "doc_id", text: str = "text", with_groups: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum, (with_groups: groups,) groups_sha256.

    A is the byte-level tokenizer over a space and the text, B the piece tokenizer over the text. A pair's count is the number of
    documents in which it is linked; n_best counts the links whose count is the highest that their A id has."""
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    n, kind = stage.partitions(spark), to_arrow_type(docs.schema[key].dataType)
    name = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text))
    pattern = segment_pattern(Pieces(pair.b).pieces)
    files = spark.sparkContext.broadcast(pair)
    shape = f"block long, row_ids array<{name}>, n array<int>, at binary, parts array<binary>"
    blocks = stage.written_by(rows.mapInArrow(_blocks(pattern, key, text, block_bytes, n, kind), shape), "block", n)
    lists = blocks.select("block", F.posexplode("parts").alias("part", "words")).filter("words is not null")
    words = lists.repartition(n, "part").select("words").mapInArrow(_distinct, "word string").distinct()
    # words are in order before they are numbered, so a task that runs again gives the same numbers
    encoded = words.sortWithinPartitions("word").mapInArrow(_encoded(files), _ENCODED).withColumn("unit", F.monotonically_increasing_id())
    encoded = stage.written_by(encoded.repartition(n, "unit"), "unit", n)
    with stage.joined_in_place(spark):
        found = stage.written_by(tokens(encoded.filter("ok").select("unit", "a", "a_len", "b", "b_len")), "unit", n)
        linked = links(found).groupBy("unit").agg(F.collect_list(F.struct("pair", "n")).alias("l"))
        of_unit = encoded.select("unit", "word", "ok").join(groups(found).join(linked, "unit"), "unit", "left")
        part = F.pmod(F.crc32(F.encode("word", "utf-8")), F.lit(n)).cast("int")
        of_unit = of_unit.select(part.alias("part"), "word", "ok", "n_a", "n_b", "n_groups", "groups", F.col("l.pair").alias("pairs"), F.col("l.n").alias("times"))
        both = of_unit.unionByName(lists, allowMissingColumns=True).repartition(n, "part").sortWithinPartitions("part", F.col("block").isNotNull())
        back = both.mapInArrow(_attached, "block long, part int, found binary").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "found"))).alias("lists"))
        back = stage.written_by(back, "block", n)
    at = blocks.select("block", "row_ids", "n", "at").join(back, "block", "left")
    per_block = stage.written(at.select("block", "n", "at", "lists").mapInArrow(_pair_docs, "block long, pair long, docs long"))
    totals = counted(stage.written(per_block.groupBy("pair").agg(F.sum("docs").alias("docs"))))
    counts = per_block.select("block", "pair").join(totals, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "docs", "best")).alias("counts"))
    schema = f"key {name}, {', '.join(f'{c} long' for c in _SUMS)}, {'groups string, ' if with_groups else ''}groups_sha256 string"
    return at.join(counts, "block", "left").mapInArrow(_documents(kind, with_groups), schema).withColumnRenamed("key", key)
