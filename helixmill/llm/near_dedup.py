"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

Documents with the same shingle set form a class; the join runs over classes. A tree branches a class by minwise
tokens: a node picks some positions of the MinHash signature, and the classes in it go to one child for each position,
named by the token there. Classes that share most shingles stay together; others part. A node with few classes is
compared exhaustively; a larger one branches again. Independent trees raise recall: at similarity 0.85 a pair fails to
meet in the first level of all trees with probability 0.15 ** (TREES * BRANCHES), and to meet again below a large node
with about 0.03 for each tree.

Before a large node branches, its classes are held against its smallest class (the pivot). Those linked to it take its
label, and a node whose classes have one label is finished: it can add nothing to the components. Without this a group of
millions of near copies would stay together for many levels. A node that is still large at the deepest level is
compared in blocks. Links are confirmed on the full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .components import components
from .features import unused
from .stage import partitions, written, written_by

POSITIONS = 64
TREES, BRANCHES = 3, 2
#: Classes in a node that is compared exhaustively.
SMALL = 2048
DEEPEST = 10
#: Chance that a pair at the threshold agrees in fewer positions of the signature than are asked for before full sets are
#: compared.
MISS = 1e-9
#: Shingles of a group whose full sets are compared in one task at once; larger groups are cut into pairs of blocks.
GROUP_SHINGLES = 4 << 20
#: Classes whose ids are broadcast when their texts are looked up; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Pivots whose signatures are broadcast (300 bytes each); more are joined by a shuffle.
BROADCAST_PIVOTS = 100_000
#: Classes that are confirmed against a pivot in one group.
STAR = 64

_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_agreeing(percent: int, positions: int = POSITIONS, miss: float = MISS) -> int:
    """The largest number of positions that a pair at the threshold falls short of with a chance of at most `miss`: positions
    agree independently, each with the pair's similarity."""
    p, below, least = percent / 100, 0.0, 0
    while least < positions:
        below += math.comb(positions, least) * p**least * (1 - p) ** (positions - least)
        if below > miss:
            break
        least += 1
    return least


def _class_of(s: np.ndarray) -> bytes:
    """128 bits of a set of hashes."""
    a = int(np.add.reduce(textvec.mix(s)))
    b = int(np.add.reduce(textvec.mix(s ^ np.uint64(0x5555AAAA3333CCCC))))
    return b"%016x%016x" % (a, b)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    h, doc = textvec.shingles(textvec.words(column), k)
    at = textvec.bounds(doc, len(column))
    for i in range(len(column)):
        yield np.unique(h[at[i] : at[i + 1]])


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.slices(batches, "text"):
            sets = list(_sets(batch.column("text"), k))
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            signature = np.zeros((len(full), POSITIONS), np.int32)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                for j in range(POSITIONS):
                    h = ((flat * _MULTIPLY[j]) >> np.uint64(32)).astype(np.uint32)
                    signature[:, j] = np.minimum.reduceat(h, at).view(np.int32)
            where = np.full(len(sets), -1)
            where[full] = np.arange(len(full))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("tid"), pa.array(n), pa.array([_class_of(s).decode() if len(s) else None for s in sets], pa.string()), pa.array([None if w < 0 else signature[w] for w in where], pa.list_(pa.int32()))],
                ["key", "tid", "n_shingles", "cls", "signature"],
            )

    return run


def _by_group(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by a column; the last group of a batch waits for the next batch."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(column)
        edge = len(ids) - 1
        last = ids[edge]
        values = ids.to_numpy(zero_copy_only=False)
        edge = int(np.searchsorted(values, last.as_py(), "left"))
        if edge == 0 and (not rest or rest[0].column(column)[0] == last):
            rest.append(batch)
            continue
        yield from _split(pa.Table.from_batches([*rest, batch.slice(0, edge)]), column)
        rest = [batch.slice(edge)]
    if rest:
        yield from _split(pa.Table.from_batches(rest), column)


def _split(t: pa.Table, column: str) -> Iterator[pa.Table]:
    if not t.num_rows:
        return
    ids = t.column(column).to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield t.slice(i, j - i)


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric matrix: child, parent, and the component of each row."""
    n = len(linked)
    comp, parent = np.full(n, -1), np.full(n, -1)
    for s in range(n):
        if comp[s] >= 0:
            continue
        comp[s] = s
        front = [s]
        while front:
            x = front.pop()
            new = np.flatnonzero(linked[x] & (comp < 0))
            comp[new], parent[new] = s, x
            front += new.tolist()
    child = np.flatnonzero(parent >= 0)
    return child, parent[child], comp


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    one = lists.combine_chunks()
    return one.flatten().to_numpy().reshape(len(one), -1)


def _candidates(least: int):
    """Of each small node, the groups of classes that signatures chain together and that have more than one label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, "node"):
            n = t.num_rows
            if n < 2:
                continue
            sig, label = _matrix(t.column("signature")), np.array(t.column("label").to_pylist())
            near = np.zeros((n, n), bool)
            for i in range(n - 1):
                near[i, i + 1 :] = (sig[i + 1 :] == sig[i]).sum(1) >= least
            if not near.any():
                continue
            near |= near.T
            near |= label[:, None] == label[None, :]
            *_, comp = _forest(near)
            cls = np.array(t.column("cls").to_pylist())
            for c in np.unique(comp):
                own = np.flatnonzero(comp == c)
                if len(own) > 1 and len(np.unique(label[own])) > 1:
                    members = np.unique(cls[own])
                    group = int(np.frombuffer(bytes.fromhex("".join(members)), np.int64).sum())  # the same members give the same group
                    yield pa.RecordBatch.from_pydict({"grp": pa.array([group] * len(members), pa.int64()), "cls": pa.array(members.tolist(), pa.string())})

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections within a group, from bit rows of the shingles that at least two sets hold."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[inverse] > 1
    inverse, row = inverse[keep], row[keep]
    _, col = np.unique(inverse, return_inverse=True)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    width = 1 << 14
    for lo in range(0, int(col.max()) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [lo, lo + width])
        bits = np.zeros((n, min(width, int(col[b - 1]) - lo + 1)), bool)
        bits[row[a:b], col[a:b] - lo] = True
        packed = np.packbits(bits, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
        for i in range(n - 1):
            out[i, i + 1 :] += np.bitwise_count(packed[i + 1 :] & packed[i]).sum(1, dtype=np.int64)
    return out


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, "grp"):
            if t.num_rows < 2:
                continue
            cls = t.column("cls").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            both = _shared(sets)
            linked = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1) & (both > 0)
            child, parent, _ = _forest(linked | linked.T)
            if len(child):
                yield pa.RecordBatch.from_pydict({"a": [cls[i] for i in child], "b": [cls[i] for i in parent]})

    return run


class NearDedup:
    """key, n_shingles, component_id, kept and text_hash (of the whole text) for each row.

    Sets of distinct k-word shingles (a text of fewer words is one shingle) are linked at percent / 100 Jaccard similarity
    or more; component_id is the smallest key reachable over links, kept marks the row that has it. Null and empty texts
    have no shingles and link with nothing. A null key never is a component_id unless all keys of a component are null;
    repeated rows link with each other, and rows that repeat the smallest key are all kept. Other columns are ignored."""

    def __init__(self, k: int = 5, percent: int = 80, small: int = SMALL):
        self.k, self.percent, self.small = k, percent, small

    def __call__(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tid"))
        kind = docs.schema["key"].dataType.simpleString()
        sketches = written(docs.mapInArrow(_sketch(self.k), f"key {kind}, tid long, n_shingles long, cls string, signature array<int>"))
        # signatures are asked for by class at every level: in buckets they stay where they are
        classes = sketches.filter("cls is not null").groupBy("cls").agg(F.min("key").alias("low"), F.first("tid").alias("tid"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
        classes = written_by(classes, "cls", partitions(docs.sparkSession))
        roots = components(self._links(docs, classes))
        members = classes.select("cls", "low").join(roots.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        least = members.groupBy("root").agg(F.min("low").alias("component_id"))
        named = members.join(least, "root").select("cls", "component_id")
        out = sketches.select("key", "tid", "n_shingles", "cls").join(named, "cls", "left")
        out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id")))
        return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"), F.col("tid").alias("text_hash"))

    def keep(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """One row of each component, with its columns: that of the smallest key, and of rows that repeat it one. Rows without
        shingles all stay. Only ids of rows that go are joined to the documents."""
        k, t = unused(docs, "near_key"), unused(docs, "near_hash")
        found = written(self(docs, key, text).select(F.col(key).alias(k), F.col("text_hash").alias(t), "kept", "n_shingles"))
        named = docs.withColumns({k: F.col(key), t: F.xxhash64(text)})

        def match(other: DataFrame, how: str, rows: DataFrame) -> DataFrame:
            other = other.select(F.col(k).alias(f"{k}_"), F.col(t).alias(f"{t}_"))
            return rows.join(other, F.col(k).eqNullSafe(F.col(f"{k}_")) & (F.col(t) == F.col(f"{t}_")), how)

        rows = match(found.filter("not kept").select(k, t).distinct(), "left_anti", named)
        twice = written(found.filter("kept and n_shingles > 0").groupBy(k, t).count().filter("count > 1").select(k, t))
        if not twice.isEmpty():
            rows = match(twice, "left_anti", rows).union(match(twice, "left_semi", rows).dropDuplicates([k, t]))
        return rows.drop(k, t)

    def _links(self, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """Confirmed links between classes, enough to connect whatever links connect."""
        order = np.random.Generator(np.random.PCG64(11)).permutation(POSITIONS)[: TREES * BRANCHES]
        roots = F.array(*[F.xxhash64(F.lit(int(j)), F.col("signature")[int(p)]) for j, p in enumerate(order)])
        rows = classes.select(F.explode(roots).alias("node"), "cls", F.col("cls").alias("label"))
        groups, edges = [], []
        for depth in range(DEEPEST + 1):
            small, large = self._sized(rows)
            if depth == DEEPEST:
                small = small.union(self._blocks(large))
            groups.append(self._compared(small, classes))
            if depth == DEEPEST or large.isEmpty():
                break
            stars = large.filter("label <> pivot.label").select("cls", F.col("pivot.cls").alias("hub")).distinct()
            found = written(self._confirmed(self._stars(stars, classes), docs, classes))
            edges.append(found)
            near = found.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("b").alias("hub")), F.struct(F.col("b").alias("cls"), F.col("a").alias("hub")))).alias("x")).select("x.*", F.lit(True).alias("linked")).distinct()
            large = large.withColumn("hub", F.col("pivot.cls")).join(near, ["cls", "hub"], "left")
            large = large.withColumn("label", F.when(F.col("linked") | (F.col("cls") == F.col("hub")), F.col("pivot.label")).otherwise(F.col("label")))
            rows = self._branched(large.select("node", "cls", "label"), classes)
        joined = groups[0]
        for g in groups[1:]:
            joined = joined.union(g)
        edges.append(self._confirmed(joined.distinct(), docs, classes))
        out = edges[0]
        for x in edges[1:]:
            out = out.union(x)
        return out

    def _sized(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of small nodes, and rows of large ones with n and pivot; nodes of one class or one label are left out.

        Sizes are counted with a map-side combine. Rows of a large node are not brought together: they meet its size and
        pivot in a broadcast, and only rows of small nodes are shuffled by node."""
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cls", "label")).alias("pivot"), F.max("label").alias("top"), F.min("label").alias("bottom"))
        sizes = written(sizes.filter("n > 1").select("node", "n", F.when(F.col("n") > self.small, F.col("pivot")).alias("pivot"), (F.col("top") != F.col("bottom")).alias("open")))
        big = sizes.filter(F.col("n") > self.small)
        if big.count() <= BROADCAST_ROWS:
            big = F.broadcast(big)
        large = rows.join(big.filter("open").drop("open"), "node")
        small = rows.join(big.select("node"), "node", "left_anti").join(sizes.filter((F.col("n") <= self.small) & F.col("open")).select("node"), "node", "left_semi")
        return written(small), written(large)

    def _branched(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        pick = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(POSITIONS)).cast("int") for j in range(BRANCHES)]
        children = F.array(*[F.xxhash64("node", F.lit(j), F.get("signature", p)) for j, p in enumerate(pick)])
        return rows.join(classes.select("cls", "signature"), "cls").select(F.explode(children).alias("node"), "cls", "label")

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """A node that stays large, as all pairs of blocks of it: each pair of classes meets in one of them."""
        blocks = F.ceil(F.col("n") * 2 / self.small).cast("int")
        own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
        pairs = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return pairs.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"), F.lit("block")).alias("node"), "cls", "label")

    def _least(self) -> int:
        return least_agreeing(self.percent)

    def _compared(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        full = rows.join(classes.select("cls", "signature"), "cls").repartition("node").sortWithinPartitions("node", "cls")
        return written(full.mapInArrow(_candidates(self._least()), "grp long, cls string"))

    def _stars(self, stars: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs with a pivot whose signatures agree enough, as groups of the pivot and a block of its classes.

        A pivot is the smallest class of its group, so that the forest of a group hangs whatever is linked with it under it."""
        stars = written(stars)
        hubs = stars.select("hub").distinct()
        s = classes.select("cls", "signature")
        other = s.withColumnRenamed("cls", "hub").withColumnRenamed("signature", "other").join(hubs, "hub", "left_semi")
        if hubs.count() <= BROADCAST_PIVOTS:
            other = F.broadcast(other)
        both = stars.join(s, "cls").join(other, "hub")
        same = F.aggregate(F.zip_with("signature", "other", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
        near = written(both.filter(same >= self._least()).select("cls", "hub"))
        blocks = near.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("blocks"))
        if hubs.count() <= BROADCAST_PIVOTS:
            blocks = F.broadcast(blocks)
        dealt = near.join(blocks, "hub").select("cls", "hub", F.xxhash64("hub", F.pmod(F.xxhash64("cls"), "blocks")).alias("grp"))
        return dealt.select("grp", "cls").union(dealt.select("grp", F.col("hub").alias("cls")).distinct())

    def _confirmed(self, groups: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """Links (a, b) that connect what is linked within each group, by full shingle sets taken from the texts."""
        groups = written(groups)
        sizes = groups.join(classes.select("cls", "n"), "cls").groupBy("grp").agg(F.ceil(2 * F.sum("n") / GROUP_SHINGLES).cast("int").alias("blocks"))
        large = written(sizes.filter("blocks > 2"))
        if not large.isEmpty():
            # each pair of a large group meets in a pair of its blocks
            own = F.pmod(F.xxhash64("cls"), "blocks").cast("int")
            cut = groups.join(large, "grp").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            cut = cut.select(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other"), F.lit("cut")).alias("grp"), "cls")
            groups = written(groups.join(large, "grp", "left_anti").union(cut))
        wanted = written(groups.select("cls").distinct().join(classes.select("cls", "tid"), "cls"))
        k = self.k

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in textvec.slices(batches, "text"):
                found = list(_sets(batch.column("text"), k))
                yield pa.RecordBatch.from_pydict({"cls": pa.array([_class_of(s).decode() if len(s) else None for s in found], pa.string()), "shingles": pa.array([s.tobytes() for s in found], pa.binary())})

        tids = wanted.select("tid").distinct()
        if wanted.count() <= BROADCAST_ROWS:
            tids = F.broadcast(tids)
        # of equal texts one is enough; the set is made before the shuffle
        texts = docs.filter("text is not null").join(tids, "tid", "left_semi").select("text")
        full = texts.mapInArrow(sets, "cls string, shingles binary").groupBy("cls").agg(F.first("shingles").alias("shingles"))
        rows = groups.join(full, "cls").repartition("grp").sortWithinPartitions("grp", "cls")
        return rows.select("grp", "cls", "shingles").mapInArrow(_confirm(self.percent), "a string, b string")
