"""Language-model scores by context-tree weighting over bytes, with a word unigram score beside them.

A text is coded as its lower-cased words, each followed by a space, and one end byte. The next byte is predicted as eight
binary decisions; each decision has a tree of contexts: the last 0 to DEPTH bytes. A node holds a Krichevsky-Trofimov
estimate from its counts in the training texts and is weighted, half and half before the data, against the product of its
children. The probability of a bit is the weighted mixture along its path. Code length per byte follows from the score.

How it runs: tasks cut the documents into blocks. A block lists its distinct (DEPTH + 1)-byte grams and its distinct
words with their counts in training texts; lists are dealt out by the two bytes before the predicted one (grams) or by hash (words).
Counts of all blocks are added up there. A subtree below two context bytes is complete in one part, so its weights are found
there too; the upper nodes, of which there are fewer than 65,536 however large the corpus, are summed up on the driver.
The gram's log probability and the word's count then go back to the blocks that asked, and each block sums them up by
document. Blocks themselves, with their texts, do not move."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stage, textvec

DEPTH = 5
#: Blocks whose lists for one part are added up in one task, and answered in one.
FAN = 64
BLOCK_BYTES = 4 << 20
_PAD, _GAP = 0x0A, 0x20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = 1 << 16
_HASHES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0x94D049BB133111EB)]


def coded(column: pa.Array, w: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of the rows, each after DEPTH padding bytes, and the offset of each row's padding."""
    raw, off = textvec.text_bytes(column)
    n = len(off) - 1
    solid = ~_SPACE[raw]
    first = np.zeros(len(raw), bool)
    first[w.starts] = True
    before = np.cumsum(first[solid], dtype=np.int32) - 1  # the word of each byte
    doc = w.doc.astype(np.int32)[before]
    size = np.bincount(doc, minlength=n) + w.counts + DEPTH + 1
    ends = np.cumsum(size)
    begins = ends - size
    out = np.full(int(ends[-1]) if n else 0, _GAP, np.uint8)
    # before a byte come the bytes before it, a gap for each earlier word, and the padding and ends of earlier rows
    place = np.arange(len(before), dtype=np.int32) + before
    place += doc * np.int32(DEPTH + 1) + np.int32(DEPTH)
    out[place] = _LOWER[raw[solid]]
    for j in range(DEPTH):
        out[begins + j] = _PAD
    out[ends - 1] = _PAD
    return out, begins


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, in no order, and the place of each code among them: codes are thrown into a table, those that
    find themselves there are done, and the others are thrown again with another hash."""
    bits = max(8, int(len(codes)).bit_length())
    place, found, done = np.empty(len(codes), np.int32), [], 0
    rest = np.arange(len(codes), dtype=np.int32)
    table = np.empty(1 << bits, np.int32)
    for odd in _HASHES:
        c = codes[rest] if done else codes
        slot = ((c ^ (c >> np.uint64(29))) * odd) >> np.uint64(64 - bits)
        own = np.arange(len(c), dtype=np.int32)
        table[slot] = own
        there = table[slot]
        same = c[there] == c
        first = np.flatnonzero(there == own)
        number = np.empty(len(c), np.int32)
        number[first] = np.arange(done, done + len(first), dtype=np.int32)
        place[rest[same]] = number[there[same]]
        found.append(c[first])
        done += len(first)
        rest = rest[~same]
        if not len(rest):
            break
    else:
        more, at = np.unique(codes[rest], return_inverse=True)
        place[rest] = done + at
        found.append(more)
    return np.concatenate(found), place


def grams(out: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the distinct grams (the predicted byte lowest, older bytes higher), the gram of each coded byte, and where
    each row's coded bytes begin among them."""
    codes = out[DEPTH:].astype(np.uint64)
    for j in range(1, DEPTH + 1):
        codes |= out[DEPTH - j : len(out) - j].astype(np.uint64) << np.uint64(8 * j)
    # codes[i] ends at byte i + DEPTH; grams that end in the padding of a later row are not wanted
    wanted = np.ones(len(codes), bool)
    for j in range(DEPTH):
        wanted[begins[1:] + j - DEPTH] = False
    lengths = np.append(begins[1:], len(out)) - begins - DEPTH
    return *distinct(codes[wanted]), np.cumsum(lengths) - lengths


def log_gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """log gamma(i + 1/2) and log gamma(i + 1) for i below _TABLE."""
    i = np.arange(1, _TABLE)
    half = np.concatenate([[0.5 * np.log(np.pi)], 0.5 * np.log(np.pi) + np.cumsum(np.log(i - 0.5))])
    return half, np.concatenate([[0.0], np.cumsum(np.log(i))])


_HALF, _WHOLE = log_gamma_tables()


def _log_gamma(n: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    x = np.maximum(n + add, 1.0)
    stirling = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _TABLE, table[np.minimum(n, _TABLE - 1)], stirling)


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a, _HALF, 0.5) + _log_gamma(b, _HALF, 0.5) - _log_gamma(a + b, _WHOLE, 1.0) - np.log(np.pi)


def weigh(a: np.ndarray, b: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of a node and the share of its own estimate in it."""
    own = kt(a, b)
    return np.logaddexp(own, children) - np.log(2), 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


class Subtrees:
    """The trees below two context bytes for a set of grams with counts (0: only asked for)."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        symbol, context = (codes & np.uint64(255)).astype(np.int64), (codes >> np.uint64(8)).astype(np.int64)
        j = np.arange(8)
        prefix = (1 << j) | (symbol[:, None] >> (8 - j))  # the decisions so far, after a leading 1
        self.bit = (symbol[:, None] >> (7 - j)) & 1
        key = (context[:, None] << 8 | prefix).ravel()
        keys, self.leaf = np.unique(key, return_inverse=True)
        n = np.repeat(counts, 8)
        one = self.bit.ravel().astype(bool)
        a, b = (np.bincount(self.leaf, n * side, minlength=len(keys)).astype(np.int64) for side in (~one, one))
        self.levels = [(a, b, np.ones(len(keys)), None)]
        log_p = kt(a, b)
        for depth in range(DEPTH - 1, 1, -1):
            up = ((keys >> 8) & ((1 << 8 * depth) - 1)) << 8 | (keys & 255)
            keys, parent = np.unique(up, return_inverse=True)
            a, b = (np.bincount(parent, x, minlength=len(keys)).astype(np.int64) for x in (a, b))
            log_p, own = weigh(a, b, np.bincount(parent, log_p, minlength=len(keys)))
            self.levels.append((a, b, own, parent))
        self.keys, self.log_p = keys, log_p

    def top(self) -> pa.RecordBatch:
        """What the nodes at one context byte get from those at two."""
        up, at = np.unique((self.keys >> 8 & 255) << 8 | (self.keys & 255), return_inverse=True)
        a, b, *_ = self.levels[-1]
        sums = [np.bincount(at, x, minlength=len(up)) for x in (a, b, self.log_p)]
        return pa.RecordBatch.from_arrays([pa.array(up), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])], ["node", "zeros", "ones", "log_p"])

    def score(self, upper: Upper) -> np.ndarray:
        """log10 probability of each gram's last byte after the bytes before it."""
        q, at = None, self.leaf
        one = self.bit.ravel()
        for a, b, own, parent in self.levels:
            if parent is not None:
                at = parent[at]
            est = (np.where(one == 1, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1.0)
            q = est if q is None else own[at] * est + (1 - own[at]) * q
        node = (self.keys[at] >> 8 & 255) << 8 | (self.keys[at] & 255)
        for (a, b, own), of in ((upper.one, node), (upper.none, node & 255)):
            est = (np.where(one == 1, b[of], a[of]) + 0.5) / (a[of] + b[of] + 1.0)
            q = own[of] * est + (1 - own[of]) * q
        return np.log10(q).reshape(-1, 8).sum(1)


class Upper:
    """The nodes at one context byte and at none: tables of 65,536 and 256."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_p: np.ndarray):
        a, b, below = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16)
        a[node], b[node], below[node] = zeros, ones, log_p
        log_one, own = weigh(a, b, below)
        self.one = (a, b, own)
        a, b, below = (x.reshape(256, 256).sum(0) for x in (a, b, log_one))
        self.none = (a, b, weigh(a, b, below)[1])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of a vector's numbers, the first bytes of all of them first: like bytes are neighbours and compress."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys, as steps, and counts."""
    steps = np.diff(keys, prepend=keys.dtype.type(0))
    return zlib.compress(len(keys).to_bytes(8, "little") + _planes(steps) + _planes(counts), 1)


def _unpack(packed: bytes, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    n = int.from_bytes(raw[:8], "little")
    put = lambda at, t: np.frombuffer(raw, np.uint8, n * np.dtype(t).itemsize, at).reshape(np.dtype(t).itemsize, n).T.copy().view(t).ravel()
    return np.cumsum(put(8, np.uint64), dtype=np.uint64), put(8 + 8 * n, kind)


def _part_of_gram(codes: np.ndarray, parts: int) -> np.ndarray:
    return (textvec.mix(codes >> np.uint64(8) & np.uint64(0xFFFF)) % np.uint64(parts)).astype(np.int64)


def _order(keys: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by part and then key, and the place of each key in it."""
    order = np.lexsort((keys, part))
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return order, place


def _dealt(keys: np.ndarray, counts: np.ndarray, part: np.ndarray, parts: int) -> list[bytes | None]:
    """Sorted keys with counts for each part."""
    order, _ = _order(keys, part)
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    k, c = keys[order], counts[order].astype(np.uint32)
    return [_pack(k[i:j], c[i:j]) if j > i else None for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


class _Block:
    """The distinct grams and words of a block, found alike whenever they are needed."""

    def __init__(self, texts: pa.Array):
        w = textvec.words(texts)
        self.codes, self.gram, self.gram_at = grams(*coded(texts, w))
        self.words, self.word = np.unique(w.hashes, return_inverse=True)
        self.n_words = w.counts
        self.lengths = np.diff(np.append(self.gram_at, len(self.gram)))

    def parts_of(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        return _part_of_gram(self.codes, parts), (self.words % np.uint64(parts)).astype(np.int64)

    def lists(self, parts: int, training: np.ndarray) -> list[list[bytes | None]]:
        g, w = self.parts_of(parts)
        in_grams = np.bincount(self.gram[np.repeat(training, self.lengths)], minlength=len(self.codes))
        in_words = np.bincount(self.word[np.repeat(training, self.n_words)], minlength=len(self.words))
        return [_dealt(self.codes, in_grams, g, parts), _dealt(self.words, in_words, w, parts)]

    def places(self, parts: int) -> list[np.ndarray]:
        return [_order(k, p)[1] for k, p in zip((self.codes, self.words), self.parts_of(parts), strict=True)]


def _blocks(parts: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in textvec.slices(batches, "text", size):
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            b = _Block(texts)
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            g, w = b.lists(parts, ~held)
            del b
            listed = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.string()))
            row = {"block": [number], "row_ids": [batch.column("row_id").to_pylist()], "held": [held.tolist()], "texts": listed, "grams": pa.array([g], pa.list_(pa.binary())), "words": pa.array([w], pa.list_(pa.binary()))}
            yield pa.RecordBatch.from_pydict(row)
            number += 1

    return run


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), minlength=len(k)).astype(np.int64)


class _Sums:
    """Counts of one part's keys, added up as lists come; in memory are the part's distinct keys and a few lists."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

    def add(self, packed: bytes, kind: type = np.uint32) -> None:
        k, c = _unpack(packed, kind)
        self.keys.append(k)
        self.counts.append(c.astype(np.int64))
        self.waiting += len(k)
        if self.waiting > 1_000_000 + 2 * len(self.keys[0]):
            self.end()

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = _merged(self.keys, self.counts)
        self.keys, self.counts, self.waiting = [k], [c], 0
        return k, c


def _summed(batches: Iterator[pa.RecordBatch], by: list[str], kind: type) -> Iterator[tuple[int, _Sums, _Sums]]:
    """Part, grams and words of each run of rows that agree in `by`, one run at a time: rows come sorted."""
    key, g, w = None, _Sums(), _Sums()
    for batch in batches:
        for *own, gs, ws in zip(*(batch.column(c).to_pylist() for c in (*by, "g", "w")), strict=True):
            if own != key:
                if key is not None:
                    yield key[0], g, w
                key, g, w = own, _Sums(), _Sums()
            for packed, s in ((gs, g), (ws, w)):
                if packed is not None:
                    s.add(packed, kind)
    if key is not None:
        yield key[0], g, w


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, g, w): the lists of a part from some FAN blocks as one list each."""
    for part, g, w in _summed(batches, ["part", "salt"], np.uint32):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_pack(*g.end())]), pa.array([_pack(*w.end())])], ["part", "g", "w"])


def _totals(kind: type):
    """(part, grams, words, tokens, known, nodes): all counts of a part, and what its subtrees give the upper nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, g, w in _summed(batches, ["part"], kind):
            (gk, gc), (wk, wc) = g.end(), w.end()
            top = Subtrees(gk, gc).top().to_pylist()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "grams": [_pack(gk, gc)], "words": [_pack(wk, wc)],
                "tokens": [int(wc.sum())], "known": [int((wc > 0).sum())], "nodes": pa.array([top], pa.list_(_NODE)),
            })

    return run


_NODE = pa.struct([("node", pa.int64()), ("zeros", pa.int64()), ("ones", pa.int64()), ("log_p", pa.float64())])
_SUMS = "part int, grams binary, words binary, tokens long, known long, nodes array<struct<node: long, zeros: long, ones: long, log_p: double>>"


def _answers(upper):
    """A part's counts come first, then the blocks' lists: each gets log probabilities of its grams and counts of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, model = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["first"] == 0:
                    gk, gc = _unpack(row["g"], np.int64)
                    wk, wc = _unpack(row["w"], np.int64)
                    part, model = row["part"], (gk, Subtrees(gk, gc).score(upper.value), wk, wc)
                    continue
                assert row["part"] == part
                out = []
                for packed, keys, values in ((row["g"], model[0], model[1].astype(np.float32)), (row["w"], model[2], model[3])):
                    asked = _unpack(packed)[0] if packed is not None else keys[:0]
                    out.append(zlib.compress(_planes(values[np.searchsorted(keys, asked)]), 1))
                yield pa.RecordBatch.from_pydict({"block": [row["block"]], "part": pa.array([part], pa.int32()), "g": [out[0]], "w": [out[1]]})

    return run


def _values(packed: list[bytes], kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = [np.frombuffer(zlib.decompress(x), np.uint8) for x in packed]
    parts = [x.reshape(size, len(x) // size).T.copy().view(kind).ravel() for x in raw]
    return np.concatenate([np.zeros(0, kind), *parts])


def _scored(parts: int, tokens: int, known: int, ends: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = tokens + ends
        rest = total + 0.1 * (known + (ends > 0) + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                texts = batch.column("texts")[i].values
                row = batch.slice(i, 1).drop_columns("texts").to_pylist()[0]
                b = _Block(texts)
                held = np.array(row["held"], bool)
                g_place, w_place = b.places(parts)
                got = sorted(row["lists"] or [], key=lambda x: x["part"])
                g = _values([x["g"] for x in got], np.float32).astype(np.float64)[g_place]
                c = _values([x["w"] for x in got], np.int64)[w_place]
                n = len(held)
                score = np.add.reduceat(g[b.gram], b.gram_at)  # every row has its end byte, so none is empty
                row_of = np.repeat(np.arange(n), b.n_words)
                base = np.bincount(row_of, np.log10((c[b.word] + 0.1) / rest), minlength=n) + np.log10((ends + 0.1) / rest)
                seen = np.bincount(row_of, c[b.word] > 0, minlength=n).astype(np.int64) + int(ends > 0)
                ids = pa.array(row["row_ids"], pa.string()).cast(kind)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(held), pa.array(b.n_words.astype(np.int64) + 1), pa.array(seen), pa.array(np.full(n, total)), pa.array(base), pa.array(score), pa.array(b.lengths.astype(np.int64))],
                    ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
                )

    return run


def held_out(key: str, folds: int) -> Column:
    """Whether the CRC-32 of the key as text is divisible by `folds`; a null key counts as empty text, whose CRC is 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """For each row: key, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes.

    The model learns from the rows that are not held out. score: log10 probability of the coded text; n_bytes: its coded
    bytes, so that -score * log2(10) / n_bytes is bits per byte. base_score: log10 probability of the tokens (words and one
    end) by smoothed counts. Null and empty texts have the end alone; without training rows all estimates are even.
    Repeated rows are scored and learnt from each time; other columns are ignored."""
    spark = docs.sparkSession
    parts = stage.partitions(spark)
    rows = docs.select(F.col(key).cast("string").alias("row_id"), held_out(key, folds).alias("held_out"), F.col(text).alias("text"))
    schema = "block long, row_ids array<string>, held array<boolean>, texts array<string>, grams array<binary>, words array<binary>"
    blocks = stage.written_by(rows.mapInArrow(_blocks(parts, BLOCK_BYTES), schema), "block", parts)
    lists = blocks.select("block", F.posexplode(F.arrays_zip(F.col("grams").alias("g"), F.col("words").alias("w"))).alias("part", "x")).select("block", "part", "x.g", "x.w").filter("g is not null or w is not null")
    n_blocks = blocks.count()
    salts = -(-n_blocks // FAN)
    salt = F.pmod(F.xxhash64("block"), F.lit(max(salts, 1))).cast("int").alias("salt")
    given, counts = lists.select("part", "g", "w"), np.uint32
    if salts > 1:  # a part's lists are added up in several tasks first, so that no task reads those of all blocks
        given = lists.select("part", salt, "g", "w").repartition(parts, "part", "salt").sortWithinPartitions("part", "salt").mapInArrow(_added_up, "part int, g binary, w binary")
        counts = np.int64
    sums = stage.written(given.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_totals(counts), _SUMS))
    tokens, known = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    ends = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    nodes = sums.select(F.explode("nodes").alias("x")).groupBy("x.node").agg(F.sum("x.zeros"), F.sum("x.ones"), F.sum("x.log_p")).toArrow()  # fewer than 65,536 rows
    upper = spark.sparkContext.broadcast(Upper(*(nodes.column(i).to_numpy() for i in range(4))))
    each = F.explode(F.sequence(F.lit(0), F.lit(max(salts, 1) - 1))).alias("salt")  # every task that answers for a part has its model
    model = sums.select(F.lit(-1).cast("long").alias("block"), "part", each, F.col("grams").alias("g"), F.col("words").alias("w"), F.lit(0).alias("first"))
    asked = model.union(lists.select("block", "part", salt, "g", "w", F.lit(1))).repartition(parts, "part", "salt").sortWithinPartitions("part", "salt", "first")
    answers = asked.mapInArrow(_answers(upper), "block long, part int, g binary, w binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("part", "g", "w")).alias("lists"))
    both = blocks.select("block", "row_ids", "held", "texts").join(answers, "block", "left")
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    out = f"key {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return both.mapInArrow(_scored(parts, tokens, known, ends, to_arrow_type(kind)), out).withColumnRenamed("key", key)
