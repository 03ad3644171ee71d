"""A taxonomy as an edge table (id, parent_id, rank, name), its closure, lineages, common ancestors and subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.dna import col
from helixmill.staging import written

from .order import placed

#: Ranks of a lineage from the top, and their slots.
RANKS = ["domain", "phylum", "class", "order", "family", "genus", "species", "subspecies", "genome"]
RANK_IDS = {r: i for i, r in enumerate(RANKS)} | {"superkingdom": 0}
#: Levels that the first step of a closure reaches.
FIRST = 4


def rank_id(rank: Column | str) -> Column:
    """0 (domain, superkingdom) to 8 (genome); -1 for other names and for null."""
    pairs = [F.lit(x) for kv in RANK_IDS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(col(rank))), F.lit(-1))


def closure(nodes: DataFrame, id_: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, ancestor_id, distance), each node with itself at 0. The root is its own parent or has none.

    Paths are doubled: the distances known after a step reach twice as far, so a tree of depth d takes log2(d) steps, each
    written once. The first step reaches FIRST levels. A cycle is an error."""
    edge = nodes.select(F.col(id_).alias("id"), F.col(parent).alias("up")).filter("up is not null and id <> up")
    one = edge.select("id", F.col("up").alias("ancestor_id"), F.lit(1).alias("distance"))
    two = one.union(_beyond(one, one))
    known = step = written(two.union(_beyond(two.filter("distance = 2"), two)))
    reach = FIRST
    while True:
        cycles, ends = step.agg(F.count_if(F.col("id") == F.col("ancestor_id")), F.count_if(F.col("distance") == reach)).first()
        if cycles:
            raise ValueError("the taxonomy has a cycle")
        if not ends:
            break
        # a path that ends exactly `reach` levels up goes on with whatever is known from there
        step = written(_beyond(step.filter(F.col("distance") == reach), known))
        known = known.union(step)
        reach *= 2
    own = nodes.select(F.col(id_).alias("id"), F.col(id_).alias("ancestor_id"), F.lit(0).alias("distance"))
    return own.union(known)


def _beyond(far: DataFrame, known: DataFrame) -> DataFrame:
    """Paths of `far` continued by paths of `known`."""
    on = known.select(F.col("id").alias("ancestor_id"), F.col("ancestor_id").alias("next"), F.col("distance").alias("more"))
    return far.join(on, "ancestor_id").select("id", F.col("next").alias("ancestor_id"), (F.col("distance") + F.col("more")).alias("distance"))


def levels(closed: DataFrame) -> DataFrame:
    """(id, level): the number of ancestors."""
    return closed.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("level"))


def subtree_sizes(closed: DataFrame) -> DataFrame:
    """(id, n_nodes, n_leaves) at and below each node."""
    inner = closed.filter("distance = 1").select(F.col("ancestor_id").alias("id")).distinct()
    leaf = closed.join(inner.withColumn("inner", F.lit(1)), "id", "left")
    return leaf.groupBy(F.col("ancestor_id").alias("id")).agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.col("inner").isNull(), 1)).alias("n_leaves"))


def common_ancestors(pairs: DataFrame, closed: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, lca_id) for pairs of node ids: the shared ancestor that is nearest to a.

    Each node's ancestors are one list, as long as the tree is deep, so a pair stays one row: it meets the list of a, then that of b."""
    up = closed.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("distance", "ancestor_id")))["ancestor_id"].alias("up"))
    both = pairs.select(a, b).distinct().join(up.select(F.col("id").alias(a), F.col("up").alias("_up_a")), a).join(up.select(F.col("id").alias(b), F.col("up").alias("_up_b")), b)
    return both.select(a, b, F.get(F.array_intersect("_up_a", "_up_b"), F.lit(0)).alias("lca_id")).filter("lca_id is not null")


def lca_of_groups(rows: DataFrame, group: list[str], lineage: list[str], root: int = 1, more: list[Column] | None = None) -> DataFrame:
    """For each group of rows that carry their lineage in rank columns (top first), lca: the deepest rank at which all agree.

    A rank counts only if all ranks above it agree too. It is two comparisons for each rank, so it combines on the map side
    and does not depend on order. more: further aggregates."""
    agreed = [((F.min(r) == F.max(r)) & (F.count(r) == F.count(F.lit(1)))).alias(f"_same_{r}") for r in lineage]
    values = [F.min(r).alias(f"_value_{r}") for r in lineage]
    out = rows.groupBy(*group).agg(*agreed, *values, *(more or []))
    lca, so_far = F.lit(root), F.lit(True)
    for r in lineage:
        so_far = so_far & F.coalesce(F.col(f"_same_{r}"), F.lit(False))
        lca = F.when(so_far, F.col(f"_value_{r}")).otherwise(lca)
    return out.withColumn("lca", lca).drop(*[f"_same_{r}" for r in lineage], *[f"_value_{r}" for r in lineage])


def lineages(closed: DataFrame, nodes: DataFrame, ranks: list[str]) -> DataFrame:
    """id and, for each rank, the ancestor of that rank (null if there is none)."""
    ranked = closed.join(nodes.select(F.col("id").alias("ancestor_id"), "rank"), "ancestor_id")
    return ranked.groupBy("id").agg(*[F.max(F.when(F.col("rank") == r, F.col("ancestor_id"))).alias(r) for r in ranks])


def lineage_string(columns: list[str], sep: str = "|", missing: str = "") -> Column:
    return F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns]), sep)


def next_set_rank(columns: list[str], after: int) -> Column:
    """The first set rank below slot `after`."""
    return F.coalesce(*[F.col(c) for c in columns[after + 1 :]], F.lit(None))


def previous_set_rank(columns: list[str], before: int) -> Column:
    return F.coalesce(*[F.col(c) for c in reversed(columns[:before])], F.lit(None))


def subset(nodes: DataFrame, closed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes that have a wanted id (column id) at or below them, with new ids: leaves first, from 2; the root keeps 1."""
    keep = closed.join(wanted.select("id").distinct(), "id").select(F.col("ancestor_id").alias("id")).distinct()
    kept = nodes.join(keep, "id")
    inner = kept.filter("parent_id <> id").select(F.col("parent_id").alias("id")).distinct().withColumn("inner", F.lit(1))
    ordered = kept.join(inner, "id", "left").withColumn("is_root", F.col("parent_id") == F.col("id"))
    ordered = ordered.withColumns({"_below": ~F.col("is_root"), "_inner": F.col("inner").isNotNull()})
    numbered = placed(ordered, ["_below", "_inner", "id"])
    new = numbered.withColumn("new_id", F.when(F.col("is_root"), 1).otherwise(F.col("place")).cast("int")).drop("inner", "is_root", "_below", "_inner", "part", "place")
    up = new.select(F.col("id").alias("parent_id"), F.col("new_id").alias("new_parent_id"))
    return new.join(up, "parent_id")


def collapse(nodes: DataFrame, closed: DataFrame, ranks: list[str]) -> DataFrame:
    """(id, parent_id, rank) of the root, the leaves and the nodes of given ranks; the parent is the nearest that is left."""
    inner = closed.filter("distance = 1").select(F.col("ancestor_id").alias("id")).distinct().withColumn("inner", F.lit(1))
    kept = nodes.join(inner, "id", "left").filter(F.col("inner").isNull() | F.col("rank").isin(ranks) | (F.col("id") == F.col("parent_id"))).select("id", "rank")
    up = closed.filter("distance > 0").join(kept.select(F.col("id").alias("ancestor_id")), "ancestor_id").groupBy("id").agg(F.min_by("ancestor_id", "distance").alias("parent_id"))
    return kept.join(up, "id", "left").select("id", F.coalesce("parent_id", "id").alias("parent_id"), "rank")


def broken(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is missing, and ids that occur more than once: (id, problem)."""
    up = nodes.select(F.col("id").alias("parent_id")).distinct()
    lost = nodes.filter("parent_id is not null").join(up, "parent_id", "left_anti").select("id", F.lit("no parent").alias("problem"))
    twice = nodes.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated").alias("problem"))
    return lost.union(twice)
