"""Classification trees of all reads as text, folded from the leaves up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.staging import written


def read_nodes(taxa: DataFrame, closed: DataFrame, read: str) -> DataFrame:
    """(read, id, parent_id, depth, hits): the taxa of each read with all their ancestors, whose own hits are 0 where the read has
    none. taxa: (read, taxid, hits); the root's parent is null."""
    up = closed.select(F.col("id").alias("taxid"), F.col("ancestor_id").alias("id"))
    nodes = taxa.join(up, "taxid").groupBy(read, "id").agg(F.sum(F.when(F.col("taxid") == F.col("id"), F.col("hits")).otherwise(0)).alias("hits"))
    place = closed.groupBy("id").agg(F.max("distance").alias("depth"), F.max(F.when(F.col("distance") == 1, F.col("ancestor_id"))).alias("parent_id"))
    return nodes.join(place, "id").select(read, "id", "parent_id", "depth", "hits")


def _folded(nodes: DataFrame, read: str, text, joined) -> DataFrame:
    """(read, text) of the roots: text(children) makes a node's text, children being joined() from its children's by id."""
    nodes = written(nodes)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(deepest, -1, -1):
        level = nodes.filter(F.col("depth") == depth)
        level = level.withColumn("children", F.lit(None).cast("string")) if below is None else level.join(below, [read, "id"], "left")
        level = level.select(read, "id", "parent_id", text(F.col("children")).alias("text"))
        # a root's parent is null: its text ends up in the last `below`
        listed = F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"])
        below = level.groupBy(read, F.col("parent_id").alias("id")).agg(joined(listed).alias("children"))
    return below.select(read, F.col("children").alias("text"))


def newick(nodes: DataFrame, read: str, label: Column | None = None) -> DataFrame:
    """(read, tree) of read_nodes(): children in brackets before their node, in the order of their ids. One join for each level of
    the taxonomy, for all reads at once; the labels are <id>_hits=<hits> unless given."""
    label = F.concat(F.col("id").cast("string"), F.lit("_hits="), F.col("hits").cast("string")) if label is None else label
    text = lambda c: F.concat(F.coalesce(F.concat(F.lit("("), c, F.lit(")")), F.lit("")), F.col("label"))
    out = _folded(nodes.withColumn("label", label), read, text, lambda x: F.array_join(x, ","))
    return out.select(read, F.concat("text", F.lit(";")).alias("tree"))


def indented(nodes: DataFrame, read: str, label: Column | None = None) -> DataFrame:
    """(read, tree): a line for each node, two spaces for each level, children below their node by id."""
    label = F.concat(F.col("id").cast("string"), F.lit("_hits="), F.col("hits").cast("string")) if label is None else label
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), label)
    text = lambda c: F.concat(F.col("line"), F.coalesce(F.concat(F.lit("\n"), c), F.lit("")))
    return _folded(nodes.withColumn("line", line), read, text, lambda x: F.array_join(x, "\n")).withColumnRenamed("text", "tree")
