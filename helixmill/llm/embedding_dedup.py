"""Near-duplicate vectors by NN-descent.

Vectors with the same components form a class; the graph is over classes.

1. A first neighbour graph: random hyperplanes cut the space into cells, several times over; large cells are dealt into
   blocks by a hash. Each class keeps its NEIGHBOURS nearest of those it meets.
2. Descent: around each class its neighbours, and those whose neighbour it is, are compared with each other (the
   neighbours-of-neighbours join); lists take what is nearer. Long lists of reverse neighbours are dealt into blocks. This
   repeats until few entries change.
3. Every comparison that reaches the threshold is kept as an edge, whether or not it fits a list. Edges give components.
   A list whose entries all reach the threshold is saturated: it may lack links. Such lists are enlarged to the whole
   component, which gives the exact number of links inside it. Members of a large component are put into rings by their
   angle to its root vector: by the triangle inequality members of two rings near the root are all linked, those of rings far apart
   are not, and only the others are compared, in blocks. So a dense group costs a count, not all its pairs.
4. Audit: the links of some classes, drawn by a hash from strata of classes with about as many found links (most from those
   with none), are counted against all vectors. Recall is a mean over classes, taken apart for classes with few and with many
   true links; the least mean counts, so that no dense group speaks for pairs. If it is too low, lists are made longer and
   more cells are cut, and the descent goes on. If it stays too low, the run fails: links are not given out then.

Cosines are taken in double precision."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .near_dedup import _by_group, _forest
from .stage import written

NEIGHBOURS = 12
#: Tables of an attempt: as many as leave a pair at the threshold unmet in cells with MISS, at least TABLES.
TABLES, MISS = 8, 1e-3
#: Classes in a cell on average, at most; in a block of a large cell, and in a block of a component.
CELL, BLOCK = 128, 256
#: Rings within the threshold's angle, and what angles may be wrong by.
RINGS, ERROR = 16, 1e-6
ROUNDS = 4  # of the descent, at most, in each attempt
SETTLED = 0.01  # share of list entries that change
#: Audited classes: of those without a found link, and of each other stratum.
AUDITED_SINGLE, AUDITED, STRATA = 4096, 256, 5
RECALL, ATTEMPTS = 0.999, 4


def _classes(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, vec = [], []
            for x in batch.column("embedding"):
                v = None
                if x.is_valid and x.values.null_count == 0:
                    v = x.values.to_numpy(zero_copy_only=False).astype(kind)
                    scale = np.abs(v).max(initial=0.0)
                    if not np.isfinite(scale) or scale == 0:
                        v = None
                vec.append(None if v is None else v.tobytes())
                cls.append(None if v is None else hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cls, pa.string()), pa.array(vec, pa.binary())], ["key", "cls", "vec"])

    return run


def _unit(vecs, kind: str) -> np.ndarray:
    """Rows of unit length; each is scaled by its largest component first, so that no square overflows or vanishes."""
    x = np.array([np.frombuffer(v, kind) for v in vecs], np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _bits(n: int) -> int:
    """Hyperplanes of a table for n classes."""
    return max(0, math.ceil(math.log2(max(n, 1) / CELL)))


def tables_for(n: int, threshold: float, least: int = TABLES) -> int:
    """Tables in which a pair at the threshold meets with 1 - MISS: more, the more hyperplanes cut it."""
    meet = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** _bits(n)
    return least if meet >= 1 else max(least, math.ceil(math.log(MISS) / math.log1p(-meet))) if meet > 0 else least


def _stratum(links: Column) -> Column:
    """0 without links, then 1-3, 4-15, 16-63, and more."""
    return F.when(links < 1, 0).otherwise(F.least(F.lit(STRATA - 1), 1 + F.floor(F.log2(links) / 2 + 1e-9))).cast("int")


def _cells(tables: range, n: int, kind: str):
    """(cell, cls, vec) for each table: the side of each hyperplane on which a vector lies."""
    bits = _bits(n)
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vecs, cls = batch.column("vec").to_pylist(), batch.column("cls").to_pylist()
            dims = np.array([len(v) // size for v in vecs])
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.stack([np.random.Generator(np.random.PCG64([d, t])).standard_normal((d, bits)) for t in tables])
                x = _unit([vecs[i] for i in own], kind)
                for t, p in zip(tables, planes[d], strict=True):
                    code = (x @ p > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(own), np.int64)
                    cell = [f"{d}:{t}:{c}" for c in code.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array([cls[i] for i in own]), pa.array([vecs[i] for i in own], pa.binary())], ["grp", "cls", "vec"])

    return run


def _met(kind: str, most: int, threshold: float):
    """Within each group of classes: for each, the nearest others that are nearer than its list's last (`least`), and
    enough pairs at the threshold to connect what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, "grp"):
            cls, first = np.unique(np.array(t.column("cls").to_pylist()), return_index=True)
            n = len(cls)
            if n < 2:
                continue
            vecs, least = t.column("vec").to_pylist(), t.column("least").to_numpy()[first]
            x = _unit([vecs[i] for i in first], kind)
            s = np.clip(x @ x.T, -1, 1)
            np.fill_diagonal(s, -2)
            linked = s >= threshold
            a, b, edge = [], [], []
            if linked.any():
                child, parent, _ = _forest(linked)
                a, b, edge = [child], [parent], [np.ones(len(child), bool)]
            top = np.argpartition(-s, min(most, n - 1) - 1, axis=1)[:, : min(most, n - 1)]
            near = np.take_along_axis(s, top, 1) > least[:, None]
            row, col = np.nonzero(near)
            a, b, edge = (np.concatenate(z) for z in ([*a, row], [*b, top[row, col]], [*edge, np.zeros(len(row), bool)]))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(cls[a].tolist(), pa.string()), pa.array(cls[b].tolist(), pa.string()), pa.array(s[a, b]), pa.array(edge)], ["a", "b", "cos", "edge"])

    return run


_MET = "a string, b string, cos double, edge boolean"


def _block_links(kind: str, threshold: float):
    """(cls, n): links of each class that lie in a block of its component, or in a pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, "grp"):
            own, other, copies = (t.column(c).to_numpy() for c in ("own", "other", "copies"))
            x = _unit(t.column("vec").to_pylist(), kind)
            linked = (np.clip(x @ x.T, -1, 1) >= threshold) & ~np.eye(len(x), dtype=bool)
            if (own != other).any():  # two blocks: only links between them, each block on its own is a group too
                linked &= own[:, None] != own[None, :]
            yield pa.RecordBatch.from_arrays([t.column("cls").combine_chunks(), pa.array((linked * copies[None, :]).sum(1))], ["cls", "n"])

    return run


class EmbeddingDedup:
    """key, n_links, component_id and kept for each row; `recall` holds the last audit, which is RECALL at least: a run that
    does not get there in ATTEMPTS raises RuntimeError.

    Vectors with cosine at the threshold or above are linked. n_links counts the other rows a row is linked with, copies
    included. component_id is the smallest key reachable over links, kept marks the row that has it. Null vectors, vectors
    of zeros or with null or non-finite components, and vectors of other dimensions link with nothing. Null keys are no
    component_id unless all keys of a component are null; repeated rows are linked with each other. Other columns are
    ignored; an empty table gives no rows."""

    def __init__(self, threshold: float = 0.9, neighbours: int = NEIGHBOURS, tables: int = TABLES):
        self.threshold, self.neighbours, self.tables = threshold, neighbours, tables
        self.recall: float | None = None

    def __call__(self, table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        rows = table.select(F.col(key).alias("key"), F.col(vector).alias("embedding"))
        self.kind = "<f4" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
        if self.kind == "<f8":
            rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
        sizes = f"key {rows.schema['key'].dataType.simpleString()}, cls string, vec binary"
        rows = written(rows.mapInArrow(_classes(self.kind), sizes))
        # equal vectors are dealt by key first, so that a group of copies is not one task's
        classes = written(rows.filter("cls is not null").groupBy("cls").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")))
        n = classes.count()
        lists, edges = None, None
        tables = tables_for(n, self.threshold, self.tables)
        for attempt in range(ATTEMPTS):
            k = self.neighbours * (attempt + 1)
            lists, more = self._descent(classes, n, lists, range(attempt * tables, (attempt + 1) * tables), k)
            edges = more if edges is None else edges.union(more)
            roots = written(components(edges))
            links = written(self._links(classes, roots))
            self.recall = self._audit(classes, links, n)
            if self.recall >= RECALL:
                break
        else:
            raise RuntimeError(f"audited recall is {self.recall:.4f} after {ATTEMPTS} attempts with {tables} tables each, {RECALL} was asked for")
        members = classes.select("cls", "low", "copies").join(roots.withColumnRenamed("vertex", "cls"), "cls", "left").join(links, "cls", "left")
        members = members.withColumn("root", F.coalesce("root", "cls")).withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
        least = members.groupBy("root").agg(F.min("low").alias("component_id"))
        named = members.join(least, "root").select("cls", "n_links", "component_id")
        out = rows.select("key", "cls").join(named, "cls", "left")
        component = F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id"))
        return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))

    def _compared(self, groups: DataFrame, k: int) -> DataFrame:
        rows = groups.select("grp", "cls", "vec", "least").repartition("grp").sortWithinPartitions("grp", "cls")
        return written(rows.mapInArrow(_met(self.kind, k, self.threshold), _MET))

    def _descent(self, classes: DataFrame, n: int, lists: DataFrame | None, tables: range, k: int) -> tuple[DataFrame, DataFrame]:
        cells = written(classes.select("cls", "vec").mapInArrow(_cells(tables, n, self.kind), "grp string, cls string, vec binary"))
        full = cells.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        block = F.pmod(F.xxhash64("cls", "grp"), F.col("blocks"))
        cells = cells.join(full, "grp").select(F.concat_ws("/", "grp", block).alias("grp"), "cls", "vec", F.lit(-2.0).alias("least"))
        met = self._compared(cells, k)
        edges = met.filter("edge").select("a", "b")
        lists = self._merged(lists, met, k)
        for _ in range(ROUNDS):
            met = self._compared(self._around(classes, lists, k), k)
            edges = edges.union(met.filter("edge").select("a", "b"))
            new = self._merged(lists, met, k)
            changed = new.join(lists, ["a", "b"], "left_anti").count()
            lists = new
            if changed <= SETTLED * n * k:
                break
        return lists, edges

    def _merged(self, lists: DataFrame | None, met: DataFrame, k: int) -> DataFrame:
        pairs = met.select("a", "b", "cos").union(met.filter("edge").select("b", "a", "cos"))
        if lists is not None:
            pairs = pairs.union(lists)
        best = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
        pairs = pairs.groupBy("a", "b").agg(F.max("cos").alias("cos"))
        return written(pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r"))

    def _around(self, classes: DataFrame, lists: DataFrame, k: int) -> DataFrame:
        """Groups of the descent: for each class its neighbours with a block of those whose neighbour it is."""
        least = lists.groupBy("a").agg(F.min("cos").alias("m"), F.count(F.lit(1)).alias("c")).select("a", F.when(F.col("c") >= k, F.col("m")).otherwise(-2.0).alias("least"))
        degree = lists.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / (2 * k)).cast("int").alias("blocks"))
        back = lists.select(F.col("b").alias("at"), F.col("a").alias("cls")).join(degree.withColumnRenamed("b", "at"), "at")
        back = back.select("at", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("block"), "cls")
        ahead = lists.select(F.col("a").alias("at"), F.col("b").alias("cls")).join(degree.withColumnRenamed("b", "at"), "at", "left")
        ahead = ahead.select("at", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), "cls")
        members = back.union(ahead).select(F.concat_ws("/", "at", "block").alias("grp"), "cls")
        return members.join(classes.select("cls", "vec"), "cls").join(least.withColumnRenamed("a", "cls"), "cls", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))

    def _links(self, classes: DataFrame, roots: DataFrame) -> DataFrame:
        """(cls, n): rows of other classes linked with a class, for all classes in components of several classes."""
        all_of = roots.select(F.col("vertex").alias("cls"), "root").union(roots.select(F.col("root").alias("cls"), "root").distinct())
        members = written(all_of.join(classes.select("cls", "vec", "copies"), "cls"))
        large = members.groupBy("root").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK).select("root")
        names = ["grp", "cls", "vec", "copies", "own", "other"]
        few = members.join(large, "root", "left_anti").select(F.col("root").alias("grp"), "cls", "vec", "copies", F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("other"))
        ringed = self._ringed(members.join(large, "root", "left_semi"), classes)
        rows = few.union(ringed.select(*names[:5], F.explode("others").alias("other")).withColumn("grp", F.concat_ws("/", "grp", F.least("own", "other"), F.greatest("own", "other"))))
        found = rows.repartition("grp").sortWithinPartitions("grp", "cls").mapInArrow(_block_links(self.kind, self.threshold), "cls string, n long")
        return found.union(ringed.select("cls", "sure")).groupBy("cls").agg(F.sum("n").alias("n"))

    def _ringed(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """members with own (ring and block), others (the blocks that they are compared with) and sure: rows of other classes
        in rings that need no comparison."""
        kind, angle = self.kind, math.acos(min(1.0, max(-1.0, self.threshold)))
        width = max(angle, 1e-3) / RINGS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (_unit(batch.column(c).to_pylist(), kind) for c in ("vec", "at"))
                ring = np.floor(np.arccos(np.clip((x * y).sum(1), -1, 1)) / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "cls", "vec", "copies")), pa.array(ring)], ["root", "cls", "vec", "copies", "ring"])

        near = members.join(classes.select(F.col("cls").alias("root"), F.col("vec").alias("at")), "root")
        rings = written(near.mapInArrow(run, "root string, cls string, vec binary, copies long, ring int"))
        sizes = rings.groupBy("root", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.sum("copies").alias("copies"))
        # at most pi / width rings for each large component
        by_root = sizes.groupBy("root").agg(F.collect_list(F.struct("ring", "blocks", F.col("copies").alias("rows"))).alias("rings"))
        rows = rings.join(by_root, "root").join(sizes.select("root", "ring", "blocks"), ["root", "ring"])
        linked = lambda r: (F.col("ring") + r + 2) * width <= angle - ERROR
        apart = lambda r: (F.abs(F.col("ring") - r) - 1) * width > angle + ERROR
        code = lambda ring, block: F.shiftleft(ring.cast("long"), 32) + block
        sure = F.aggregate(F.filter("rings", lambda b: linked(b.ring)), F.lit(0).cast("long"), lambda acc, b: acc + b.rows)
        sure = sure - F.when(linked(F.col("ring")), F.col("copies")).otherwise(0)
        asked = F.filter("rings", lambda b: ~linked(b.ring) & ~apart(b.ring))
        others = F.flatten(F.transform(asked, lambda b: F.transform(F.sequence(F.lit(0), b.blocks - 1), lambda v: code(b.ring, v))))
        own = code(F.col("ring"), F.pmod(F.xxhash64("cls"), "blocks"))
        return written(rows.select(F.col("root").alias("grp"), "cls", "vec", "copies", own.alias("own"), others.alias("others"), sure.alias("sure")))

    def _audit(self, classes: DataFrame, links: DataFrame, n: int) -> float:
        """The least, over classes with few to many true links, of the mean share of a class's true links that has been found."""
        known = classes.select("cls", "vec").join(links, "cls", "left").withColumn("stratum", _stratum(F.coalesce("n", F.lit(0))))
        sizes = {r["stratum"]: r["count"] for r in known.groupBy("stratum").count().collect()}  # STRATA rows
        chance = F.lit(0.0)
        for at, size in sizes.items():
            chance = F.when(F.col("stratum") == at, min(1.0, (AUDITED if at else AUDITED_SINGLE) / size)).otherwise(chance)
        drawn = known.filter(F.pmod(F.xxhash64("cls", F.lit("audit")), F.lit(1 << 30)) < chance * float(1 << 30))
        rows = drawn.select("cls", "vec", "stratum", F.coalesce("n", F.lit(0)).alias("n")).toArrow().to_pylist()
        if not rows:
            return 1.0
        kind, threshold = self.kind, self.threshold
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r["vec"]), []).append((r["cls"], r["vec"]))
        step = max(1, (1 << 22) // len(rows))  # so many vectors are compared with all drawn ones at once

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = {s: (np.array([c for c, _ in q]), _unit([v for _, v in q], kind)) for s, q in by_size.items()}
            total = {s: np.zeros(len(q), np.int64) for s, q in by_size.items()}
            place = {c: i for q in by_size.values() for i, (c, _) in enumerate(q)}
            for batch in batches:
                vecs, cls, copies = (batch.column(c).to_pylist() for c in ("vec", "cls", "copies"))
                for s, (_, q) in asked.items():
                    all_of = [i for i, v in enumerate(vecs) if len(v) == s]
                    for at in range(0, len(all_of), step):
                        own = all_of[at : at + step]
                        linked = np.clip(q @ _unit([vecs[i] for i in own], kind).T, -1, 1) >= threshold
                        for j, i in enumerate(own):  # not with itself
                            if cls[i] in place:
                                linked[place[cls[i]], j] = False
                        total[s] += linked @ np.array([copies[i] for i in own], np.int64)
            for s, (names, _) in asked.items():
                yield pa.RecordBatch.from_pydict({"cls": pa.array(names.tolist(), pa.string()), "true": pa.array(total[s])})

        true = classes.select("cls", "vec", "copies").mapInArrow(run, "cls string, true long").groupBy("cls").agg(F.sum("true").alias("true"))
        true = {r["cls"]: r["true"] for r in true.collect()}  # the drawn classes
        weight = {at: sizes[at] / sum(r["stratum"] == at for r in rows) for at in {r["stratum"] for r in rows}}
        found, of = [0.0] * 32, [0.0] * 32
        for r in rows:
            t = true[r["cls"]]
            if t:
                many = min(31, (t.bit_length() - 1) // 2)
                of[many] += weight[r["stratum"]]
                found[many] += weight[r["stratum"]] * min(r["n"], t) / t
        return min((f / o for f, o in zip(found, of, strict=True) if o), default=1.0)
