"""The engine's operators on the driver's tables, each with SQL that states the same result independently.

DNA comes from text (letters mapped to ACGT), reference genes are benchmark items under a small taxonomy of phyla, genera
and species, a geographic taxonomy is region > nation > customer, and intervals, alleles and classified reads come from lineitem."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import dna, text, version
from helixmill.functions.dna import Shape
from helixmill.operators import classify, correction, evaluate, index, intervals, kmers, order, placement, profile, sets, shapes, strains, taxonomy, trees, variants

from helixmill.staging import written

from .catalog import ORACLES, QUERIES

SHAPE = Shape("XXXX_XX__XX_XXXX")
RANKS = ["phylum", "genus", "species"]
GEO = ["region", "nation", "customer"]
GENUS, PHYLUM = 1_000_000, 2_000_000


def query(oracle: str | None = None):
    """Register a function (spark, read) as a query under its name; read(table) gives a table."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return put


# ---- DNA and k-mers ----


def sql_dna(column: str) -> str:
    return f"translate(regexp_replace(lower({column}), '[^a-z]', '', 'g'), '{dna.LETTERS}', '{('ACGT' * 7)[:26]}')"


def sql_kmers(table: str, keep: str) -> str:
    """(keep, pos, fw, rv, key) of each position, from a list of base codes."""
    k, last = SHAPE.k, len(SHAPE) - 1
    fw = " + ".join(f"c[p + {o + 1}] * {4 ** (k - 1 - i)}" for i, o in enumerate(SHAPE.take))
    rv = " + ".join(f"(3 - c[p + {last - o + 1}]) * {4 ** (k - 1 - i)}" for i, o in enumerate(SHAPE.take))
    return f"""(SELECT *, least(fw, rv) AS key FROM (SELECT {keep}, unnest(list_transform(range(0, greatest(len(c) - {last}, 0)),
        lambda p: {{'pos': p, 'fw': {fw}, 'rv': {rv}}}), recursive := true)
        FROM (SELECT *, list_transform(string_split({sql_dna('text')}, ''), lambda x: CAST(instr('ACGT', x) - 1 AS BIGINT)) AS c FROM {table})))"""


def doc_dna(read) -> DataFrame:
    return read("documents").select("doc_id", dna.letters_to_dna("text").alias("dna"))


def doc_kmers(read) -> DataFrame:
    return kmers.kmers(doc_dna(read), "dna", SHAPE, ["doc_id"])


def doc_counts(read) -> DataFrame:
    return kmers.counted(doc_dna(read), "dna", SHAPE)


DOC_KMERS = sql_kmers("documents", "doc_id")


@query(f"SELECT doc_id, count(*) AS n_kmers, count(DISTINCT key) AS n_distinct, min(key) AS min_key, max(key) AS max_key, count(*) FILTER (fw < rv) AS n_forward FROM {DOC_KMERS} GROUP BY doc_id")
def kmer_extract(spark, read):
    return kmers.by_sequence(doc_dna(read), "dna", SHAPE, "doc_id")


@query(f"SELECT key >> {2 * SHAPE.k - 8} AS prefix, count(*) AS n_kmers, count(DISTINCT key) AS n_distinct FROM {DOC_KMERS} GROUP BY 1")
def kmer_histogram(spark, read):
    return kmers.prefix_histogram(doc_counts(read), 2 * SHAPE.k, 8)


@query(f"SELECT times, count(*) AS n_keys FROM (SELECT key, count(*) AS times FROM {DOC_KMERS} GROUP BY key) GROUP BY times")
def kmer_multiplicity(spark, read):
    return kmers.multiplicities(doc_counts(read))


@query()
def kmer_prefix_estimate(spark, read):
    return kmers.prefix_estimate(doc_counts(read), 2 * SHAPE.k, 8)


@query(f"SELECT min(n_kmers) AS least, max(n_kmers) AS most, avg(n_kmers) AS mean, count(*) AS n_buckets FROM (SELECT key >> {2 * SHAPE.k - 8} AS b, count(DISTINCT key) AS n_kmers FROM {DOC_KMERS} GROUP BY 1)")
def index_health(spark, read):
    h = kmers.prefix_histogram(doc_counts(read), 2 * SHAPE.k, 8)
    return h.agg(F.min("n_distinct").alias("least"), F.max("n_distinct").alias("most"), F.avg("n_distinct").alias("mean"), F.count(F.lit(1)).alias("n_buckets"))


@query(f"SELECT doc_id, reverse(translate({sql_dna('text')}, 'ACGT', 'TGCA')) AS rc FROM documents")
def reverse_complement(spark, read):
    return read("documents").select("doc_id", dna.reverse_complement(dna.letters_to_dna("text")).alias("rc"))


_DECODED = " || ".join(f"substr('ACGT', CAST(((key >> {2 * (SHAPE.k - 1 - i)}) & 3) + 1 AS INT), 1)" for i in range(SHAPE.k))
_EXPANDED = " || ".join(f"substr(bases, {sum(c == 'X' for c in SHAPE.text[: i + 1])}, 1)" if x == "X" else "'_'" for i, x in enumerate(SHAPE.text))


@query(f"SELECT DISTINCT key, bases, {_EXPANDED} AS spaced FROM (SELECT key, {_DECODED} AS bases FROM {sql_kmers('benchmark', 'item_id')})")
def key_decode(spark, read):
    keys = gene_kmers(read).select("key").distinct()
    return keys.withColumn("bases", dna.key_to_dna("key", SHAPE.k)).withColumn("spaced", dna.expand_shape("bases", SHAPE))


# ---- index ----


def gene_table(read) -> DataFrame:
    item = F.col("item_id").cast("int")
    return read("benchmark").select(
        (item + 2).alias("species"), (item % 8 + GENUS).alias("genus"), (item % 2 + PHYLUM).alias("phylum"), (item % 3 + 1).alias("gene_id"), dna.letters_to_dna("text").alias("dna")
    )


def gene_kmers(read) -> DataFrame:
    return kmers.kmers(gene_table(read), "dna", SHAPE, [*RANKS, "gene_id"])


def gene_nodes(read) -> DataFrame:
    g = gene_table(read)
    parts = [("species", "genus"), ("genus", "phylum"), ("phylum", None)]
    out = [g.select(F.col(a).alias("id"), (F.col(b) if b else F.lit(1)).cast("int").alias("parent_id"), F.lit(a).alias("rank")).distinct() for a, b in parts]
    root = g.sparkSession.range(1).select(F.lit(1).alias("id"), F.lit(1).alias("parent_id"), F.lit("root").alias("rank"))
    return root.union(out[0]).union(out[1]).union(out[2])


def gene_lineages(read) -> DataFrame:
    nodes = gene_nodes(read)
    return taxonomy.lineages(taxonomy.closure(nodes), nodes, RANKS)


def gene_index(read) -> DataFrame:
    return index.build(gene_kmers(read), RANKS)


SQL_GENE_KMERS = f"""gk AS MATERIALIZED (SELECT CAST(item_id + 2 AS INT) AS species, CAST(item_id % 8 + {GENUS} AS INT) AS genus, CAST(item_id % 2 + {PHYLUM} AS INT) AS phylum,
    CAST(item_id % 3 + 1 AS INT) AS gene_id, pos, key FROM {sql_kmers('benchmark', 'item_id')})"""
SQL_INDEX = f"""{SQL_GENE_KMERS}, ix AS MATERIALIZED (SELECT key, CASE WHEN count(DISTINCT species) = 1 THEN min(species) WHEN count(DISTINCT genus) = 1 THEN min(genus)
    WHEN count(DISTINCT phylum) = 1 THEN min(phylum) ELSE 1 END AS taxid,
    CASE WHEN count(DISTINCT gene_id) = 1 AND count(DISTINCT pos) = 1 THEN min(gene_id) ELSE 0 END AS gene_id,
    CASE WHEN count(DISTINCT gene_id) = 1 AND count(DISTINCT pos) = 1 THEN CAST(min(pos) AS INT) ELSE 0 END AS gene_pos, count(*) AS n FROM gk GROUP BY key)"""
SQL_NODES = """nd AS (SELECT 1 AS id, 1 AS parent_id, 'root' AS rank UNION SELECT species, genus, 'species' FROM gk UNION SELECT genus, phylum, 'genus' FROM gk
    UNION SELECT phylum, 1, 'phylum' FROM gk)"""
SQL_CLOSED = """cl AS (SELECT id, id AS ancestor_id, 0 AS distance FROM nd UNION ALL SELECT cl.id, nd.parent_id, cl.distance + 1 FROM cl JOIN nd ON nd.id = cl.ancestor_id WHERE nd.parent_id <> nd.id)"""
SQL_LINEAGE = f"""{SQL_NODES}, {SQL_CLOSED}, li AS MATERIALIZED (SELECT cl.id, max(ancestor_id) FILTER (rank = 'phylum') AS phylum, max(ancestor_id) FILTER (rank = 'genus') AS genus,
    max(ancestor_id) FILTER (rank = 'species') AS species FROM cl JOIN nd ON nd.id = cl.ancestor_id GROUP BY cl.id)"""


@query(f"WITH {SQL_INDEX} SELECT * FROM ix")
def kmer_index_lca(spark, read):
    return gene_index(read)


@query(f"WITH {SQL_INDEX}, {SQL_NODES} SELECT rank, count(*) AS entries, count(*) FILTER (gene_id > 0) AS with_gene, count(*) / (SELECT count(*) FROM ix) AS share FROM ix JOIN nd ON nd.id = ix.taxid GROUP BY rank")
def index_rank_composition(spark, read):
    return index.rank_composition(gene_index(read), gene_nodes(read).select(F.col("id").alias("taxid"), "rank"))


@query(f"""WITH RECURSIVE {SQL_INDEX}, {SQL_NODES}, {SQL_CLOSED}, r AS (SELECT DISTINCT key, species, gene_id FROM gk)
SELECT count(*) AS n_checked, count(*) FILTER (NOT EXISTS (SELECT 1 FROM cl WHERE cl.id = r.species AND cl.ancestor_id = ix.taxid) OR (ix.gene_id <> 0 AND ix.gene_id <> r.gene_id)) AS n_wrong FROM r LEFT JOIN ix USING (key)""")
def index_verify(spark, read):
    rows = gene_kmers(read)
    wrong = index.unverified(rows, gene_index(read), taxonomy.closure(gene_nodes(read)), "species")
    n = rows.select("key", "species", "gene_id").distinct().agg(F.count(F.lit(1)).alias("n_checked"))
    return n.join(F.broadcast(wrong.agg(F.count(F.lit(1)).alias("n_wrong"))))


@query(f"WITH {SQL_GENE_KMERS} SELECT DISTINCT key, species AS taxid, gene_id, pos AS gene_pos FROM gk")
def index_all_values(spark, read):
    return index.build_all_values(gene_kmers(read), "species")


@query(f"WITH {SQL_GENE_KMERS} SELECT size, count(*) AS n_keys FROM (SELECT key, count(*) AS size FROM (SELECT DISTINCT key, species, gene_id, pos FROM gk) GROUP BY key) GROUP BY size")
def index_pack_sizes(spark, read):
    return index.pack_sizes(index.build_all_values(gene_kmers(read), "species"))


# ---- taxonomy ----


def geo_nodes(read) -> DataFrame:
    root = read("region").limit(1).select(F.lit(1).alias("id"), F.lit(1).alias("parent_id"), F.lit("root").alias("rank"))
    return (
        root.union(read("region").select((F.col("r_regionkey") + 10).cast("int"), F.lit(1), F.lit("region")))
        .union(read("nation").select((F.col("n_nationkey") + 100).cast("int"), (F.col("n_regionkey") + 10).cast("int"), F.lit("nation")))
        .union(read("customer").select((F.col("c_custkey") + 10000).cast("int"), (F.col("c_nationkey") + 100).cast("int"), F.lit("customer")))
    )


SQL_GEO = """nd AS (SELECT 1 AS id, 1 AS parent_id, 'root' AS rank UNION ALL SELECT CAST(r_regionkey + 10 AS INT), 1, 'region' FROM region UNION ALL
    SELECT CAST(n_nationkey + 100 AS INT), CAST(n_regionkey + 10 AS INT), 'nation' FROM nation UNION ALL
    SELECT CAST(c_custkey + 10000 AS INT), CAST(c_nationkey + 100 AS INT), 'customer' FROM customer)"""
SQL_GEO_CLOSED = f"{SQL_GEO}, {SQL_CLOSED}"


@query(f"WITH RECURSIVE {SQL_GEO_CLOSED} SELECT * FROM cl")
def taxonomy_closure(spark, read):
    return taxonomy.closure(geo_nodes(read))


@query(f"WITH RECURSIVE {SQL_GEO_CLOSED} SELECT id, max(distance) AS level FROM cl GROUP BY id")
def taxonomy_levels(spark, read):
    return taxonomy.levels(taxonomy.closure(geo_nodes(read)))


@query(f"""WITH RECURSIVE {SQL_GEO_CLOSED}, l AS (SELECT cl.id, max(ancestor_id) FILTER (rank = 'region') AS region, max(ancestor_id) FILTER (rank = 'nation') AS nation,
max(ancestor_id) FILTER (rank = 'customer') AS customer FROM cl JOIN nd ON nd.id = cl.ancestor_id GROUP BY cl.id)
SELECT id, region, nation, customer, concat(coalesce(CAST(region AS VARCHAR), ''), '|', coalesce(CAST(nation AS VARCHAR), ''), '|', coalesce(CAST(customer AS VARCHAR), '')) AS lineage, coalesce(nation, customer) AS next_set, region AS previous_set FROM l""")
def taxonomy_lineage(spark, read):
    nodes = geo_nodes(read)
    out = taxonomy.lineages(taxonomy.closure(nodes), nodes, GEO)
    return out.withColumn("lineage", taxonomy.lineage_string(GEO)).withColumn("next_set", taxonomy.next_set_rank(GEO, 0)).withColumn("previous_set", taxonomy.previous_set_rank(GEO, 1))


@query(f"""WITH RECURSIVE {SQL_GEO_CLOSED}, p AS (SELECT DISTINCT CAST(o_custkey + 10000 AS INT) AS a, CAST((o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) + 10000 AS INT) AS b FROM orders)
SELECT a, b, min_by(x.ancestor_id, x.distance) AS lca_id FROM p JOIN cl x ON x.id = a JOIN cl y ON y.id = b AND y.ancestor_id = x.ancestor_id GROUP BY a, b""")
def taxonomy_lca_pairs(spark, read):
    return order_ancestors(read, read("orders"))


def order_ancestors(read, orders: DataFrame) -> DataFrame:
    n = read("customer").agg(F.count(F.lit(1)).alias("n"))
    pairs = orders.join(F.broadcast(n)).select((F.col("o_custkey") + 10000).cast("int").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % F.col("n") + 10000).cast("int").alias("b"))
    return taxonomy.common_ancestors(pairs, taxonomy.closure(geo_nodes(read)))


@query(f"""WITH RECURSIVE {SQL_GEO_CLOSED}, k AS (SELECT DISTINCT ancestor_id AS id FROM cl JOIN customer ON cl.id = c_custkey + 10000 WHERE c_acctbal < 0),
s AS (SELECT nd.*, EXISTS (SELECT 1 FROM k JOIN nd c USING (id) WHERE c.parent_id = nd.id AND c.id <> nd.id) AS inn FROM nd JOIN k USING (id)),
o AS (SELECT *, CASE WHEN id = parent_id THEN 1 ELSE CAST(row_number() OVER (ORDER BY id <> parent_id, inn, id) AS INT) END AS new_id FROM s)
SELECT o.id, o.parent_id, o.rank, o.new_id, u.new_id AS new_parent_id FROM o JOIN o u ON u.id = o.parent_id""")
def taxonomy_subset(spark, read):
    nodes = geo_nodes(read)
    wanted = read("customer").filter("c_acctbal < 0").select((F.col("c_custkey") + 10000).cast("int").alias("id"))
    return taxonomy.subset(nodes, taxonomy.closure(nodes), wanted).select("id", "parent_id", "rank", "new_id", "new_parent_id")


@query(f"""WITH RECURSIVE {SQL_GEO_CLOSED}, k AS (SELECT id, rank FROM nd WHERE rank IN ('region', 'root') OR NOT EXISTS (SELECT 1 FROM nd c WHERE c.parent_id = nd.id AND c.id <> nd.id))
SELECT k.id, coalesce(min_by(x.ancestor_id, x.distance), k.id) AS parent_id, any_value(k.rank) AS rank FROM k LEFT JOIN (SELECT cl.* FROM cl JOIN k a ON a.id = cl.ancestor_id WHERE distance > 0) x ON x.id = k.id GROUP BY k.id""")
def taxonomy_collapse(spark, read):
    nodes = geo_nodes(read)
    return taxonomy.collapse(nodes, taxonomy.closure(nodes), ["region"])


@query(f"""WITH RECURSIVE {SQL_GEO_CLOSED} SELECT ancestor_id AS id, count(*) AS n_nodes, count(*) FILTER (NOT EXISTS (SELECT 1 FROM nd c WHERE c.parent_id = cl.id AND c.id <> cl.id)) AS n_leaves FROM cl GROUP BY 1""")
def subtree_size(spark, read):
    return taxonomy.subtree_sizes(taxonomy.closure(geo_nodes(read)))


@query(f"WITH {SQL_GEO}, c AS (SELECT * FROM nd WHERE id NOT IN (103, 12)), d AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE id = 105) SELECT id, 'no parent' AS problem FROM d WHERE parent_id NOT IN (SELECT id FROM d) UNION ALL SELECT id, 'repeated' FROM d GROUP BY id HAVING count(*) > 1")
def taxonomy_check(spark, read):
    nodes = geo_nodes(read).filter("id not in (103, 12)")
    return taxonomy.broken(nodes.union(nodes.filter("id = 105")))


# ---- classification ----

SQL_HITS = f"{SQL_INDEX}, h AS MATERIALIZED (SELECT k.doc_id, k.pos, k.key, ix.taxid, ix.gene_id, ix.gene_pos FROM {DOC_KMERS} k LEFT JOIN ix USING (key))"
SQL_TAXA = f"{SQL_HITS}, t AS MATERIALIZED (SELECT doc_id, taxid, count(*) AS hits FROM h WHERE taxid IS NOT NULL GROUP BY ALL)"
SQL_SCORES = f"{SQL_TAXA}, {SQL_LINEAGE}, sc AS MATERIALIZED (SELECT t.doc_id, t.taxid, any_value(t.hits) AS hits, sum(a.hits) AS score FROM t JOIN cl ON cl.id = t.taxid JOIN t a ON a.doc_id = t.doc_id AND a.taxid = cl.ancestor_id GROUP BY t.doc_id, t.taxid)"


def doc_hits(read, ix: DataFrame | None = None) -> DataFrame:
    """The index of these tables is small enough to be broadcast, so rows of k-mers do not move."""
    return classify.lookup(doc_kmers(read), written(gene_index(read)) if ix is None else ix)


def doc_scores(read) -> DataFrame:
    return classify.path_scores(classify.read_taxa(doc_hits(read), "doc_id"), taxonomy.closure(gene_nodes(read)), "doc_id")


@query(f"WITH {SQL_HITS} SELECT doc_id, count(*) AS n_kmers, count(taxid) AS hits, count(*) - count(taxid) AS misses, count(DISTINCT taxid) AS n_taxa FROM h GROUP BY doc_id")
def kmer_lookup(spark, read):
    h = doc_hits(read).groupBy("doc_id", "taxid").agg(F.count(F.lit(1)).alias("n"))
    hit = F.coalesce(F.sum(F.when(F.col("taxid").isNotNull(), F.col("n"))), F.lit(0))
    return h.groupBy("doc_id").agg(F.sum("n").alias("n_kmers"), hit.alias("hits"), (F.sum("n") - hit).alias("misses"), F.count("taxid").alias("n_taxa"))


@query(f"WITH {SQL_HITS} SELECT doc_id, count(taxid) AS hits FROM h GROUP BY doc_id HAVING count(taxid) >= 2")
def min_hit_filter(spark, read):
    return classify.enough_hits(doc_hits(read), "doc_id")


SQL_LEAF = f"{SQL_HITS}, lh AS (SELECT * FROM h WHERE taxid > 1 AND taxid < {GENUS} AND gene_id > 0 AND gene_pos > 0)"


def leaf_hits(read, hits: DataFrame | None = None) -> DataFrame:
    return (doc_hits(read) if hits is None else hits).filter(classify.is_leaf_hit(F.lit(GENUS - 1)))


@query(f"""WITH {SQL_LEAF}, f AS (SELECT doc_id, taxid, gene_id, min_by(gene_pos - pos, pos) AS off_fwd, min_by(gene_pos + pos, pos) AS off_rev, min(pos) AS first_pos, max(pos) - min(pos) AS span FROM lh GROUP BY ALL)
SELECT f.*, count(*) FILTER (gene_pos - pos = off_fwd) AS n_fwd, count(*) FILTER (gene_pos + pos = off_rev) AS n_rev, greatest(count(*) FILTER (gene_pos - pos = off_fwd), count(*) FILTER (gene_pos + pos = off_rev)) AS hits,
count(*) FILTER (gene_pos - pos = off_fwd) > count(*) FILTER (gene_pos + pos = off_rev) AS forward FROM f JOIN lh USING (doc_id, taxid, gene_id) GROUP BY ALL""")
def hit_fold_offsets(spark, read):
    return classify.node_hits(classify.fold_offsets(leaf_hits(read), "doc_id"))


@query(f"""WITH {SQL_LEAF}, v AS (SELECT doc_id, taxid, gene_id, forward, o AS "offset", count(*) AS votes FROM (SELECT *, true AS forward, gene_pos - pos AS o FROM lh UNION ALL SELECT *, false, gene_pos + pos FROM lh) GROUP BY ALL)
SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, taxid, gene_id ORDER BY votes DESC, forward, "offset") AS r FROM v) WHERE r = 1""")
def placement_vote(spark, read):
    return classify.best_offsets(leaf_hits(read), "doc_id")


@query(f"WITH RECURSIVE {SQL_SCORES} SELECT doc_id, min(taxid) AS taxid, any_value(score) AS score, count(*) AS n_best FROM sc WHERE score = (SELECT max(x.score) FROM sc x WHERE x.doc_id = sc.doc_id) GROUP BY doc_id")
def classify_pathsum(spark, read):
    return classify.best_taxon(doc_scores(read), "doc_id")


@query(f"""WITH RECURSIVE {SQL_SCORES}, b AS (SELECT sc.*, li.* EXCLUDE id FROM sc JOIN li ON li.id = sc.taxid WHERE score = (SELECT max(x.score) FROM sc x WHERE x.doc_id = sc.doc_id))
SELECT doc_id, CASE WHEN count(DISTINCT species) = 1 AND count(species) = count(*) THEN min(species) WHEN count(DISTINCT genus) = 1 AND count(genus) = count(*) THEN min(genus) WHEN count(DISTINCT phylum) = 1 AND count(phylum) = count(*) THEN min(phylum) ELSE 1 END AS taxid,
max(score) AS score, count(*) AS n_best FROM b GROUP BY doc_id""")
def classify_pathsum_lca_ties(spark, read):
    return classify.best_with_ties(doc_scores(read), gene_lineages(read), RANKS, "doc_id")


@query(f"""WITH RECURSIVE {SQL_SCORES}, m AS (SELECT *, score - min(score) OVER (PARTITION BY doc_id) + 1 AS l FROM sc)
SELECT doc_id, taxid, round(hits / score, 6) AS rank_confidence, round(l / sum(l) OVER (PARTITION BY doc_id), 6) AS candidate_confidence FROM m""")
def classify_confidence(spark, read):
    c = classify.confidences(doc_scores(read), "doc_id")
    return c.select("doc_id", "taxid", F.round("rank_confidence", 6).alias("rank_confidence"), F.round("candidate_confidence", 6).alias("candidate_confidence"))


def _sql_descent() -> str:
    out = [f"WITH RECURSIVE {SQL_TAXA}, {SQL_LINEAGE}, l0 AS MATERIALIZED (SELECT t.*, li.* EXCLUDE id FROM t JOIN li ON li.id = t.taxid WHERE taxid <> 1), a0 AS MATERIALIZED (SELECT doc_id, 1 AS node, coalesce(sum(hits) FILTER (taxid = 1), 0) AS path, true AS going FROM t GROUP BY doc_id)"]
    for i, r in enumerate(RANKS):
        out.append(
            f"""t{i} AS (SELECT doc_id, sum(hits) AS total, bool_or({r} IS NOT NULL) AS has FROM l{i} GROUP BY doc_id),
b{i} AS MATERIALIZED (SELECT l.doc_id, {r} AS nx FROM l{i} l JOIN a{i} a USING (doc_id) JOIN t{i} USING (doc_id) WHERE going AND {r} IS NOT NULL GROUP BY l.doc_id, {r}, total HAVING sum(hits) > 0.7 * total AND sum(hits) >= 3),
a{i + 1} AS MATERIALIZED (SELECT a.doc_id, coalesce(nx, node) AS node, path + coalesce(h.hits, 0) AS path, going AND (NOT coalesce(has, false) OR nx IS NOT NULL) AS going FROM a{i} a LEFT JOIN t{i} USING (doc_id) LEFT JOIN b{i} b USING (doc_id) LEFT JOIN t h ON h.doc_id = a.doc_id AND h.taxid = nx),
l{i + 1} AS MATERIALIZED (SELECT l.* FROM l{i} l JOIN a{i} a USING (doc_id) LEFT JOIN t{i} USING (doc_id) LEFT JOIN b{i} USING (doc_id) WHERE CASE WHEN going AND coalesce(has, false) THEN coalesce({r} = nx, false) ELSE true END AND taxid IS DISTINCT FROM nx)"""
        )
    return ",\n".join(out) + f" SELECT doc_id, node AS taxid, path AS path_hits FROM a{len(RANKS)} WHERE path > 3"


@query(_sql_descent())
def classify_descent(spark, read):
    return classify.descend(classify.read_taxa(doc_hits(read), "doc_id"), gene_lineages(read), RANKS, "doc_id")


@query("""SELECT l_orderkey, l_linenumber, o AS "offset", CASE WHEN o < 0 AND o + 30 > g THEN 'spans' WHEN o < 0 THEN 'over_start' WHEN o + 30 > g THEN 'over_end' ELSE 'inside' END || CASE WHEN l_returnflag = 'A' THEN '_forward' ELSE '_reverse' END AS orientation,
greatest(0, -o) AS first_kmer, greatest(0, least(30, g - o) - 16 - greatest(0, -o) + 1) AS n_kmers FROM (SELECT *, CAST(l_quantity AS INT) - 10 AS o, CAST(l_partkey % 60 AS INT) + 10 AS g FROM lineitem)""")
def orientation(spark, read):
    rows = read("lineitem").withColumn("offset", F.col("l_quantity").cast("int") - 10).withColumn("g", (F.col("l_partkey") % 60).cast("int") + 10)
    first, n = classify.overlapping_kmers(F.col("offset"), F.lit(30), F.col("g"), SHAPE)
    return rows.select("l_orderkey", "l_linenumber", "offset", classify.orientation(F.col("offset"), F.lit(30), F.col("g"), F.col("l_returnflag") == "A").alias("orientation"), first.alias("first_kmer"), n.alias("n_kmers"))


@query("""SELECT a.l_orderkey, a.l_quantity AS quantity_1, b.l_quantity AS quantity_2, CASE WHEN a.l_quantity >= 2 AND b.l_quantity >= 2 THEN 'both' WHEN a.l_quantity >= 2 THEN 'first' WHEN b.l_quantity >= 2 THEN 'second' ELSE 'none' END AS hit_type
FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber = 2""")
def mate_zip(spark, read):
    li = read("lineitem").withColumnRenamed("l_quantity", "quantity")
    both = classify.zip_mates(li.filter("l_linenumber = 1").select("l_orderkey", "quantity"), li.filter("l_linenumber = 2").select("l_orderkey", "quantity"), ["l_orderkey"])
    return both.withColumn("hit_type", classify.hit_type(F.col("quantity_1"), F.col("quantity_2")))


@query("""WITH r AS (SELECT o_custkey % 5 AS sample, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS file, o_orderkey AS place, o_totalprice AS price FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY sample, file ORDER BY place) - 1 AS ordinal FROM r)
SELECT a.sample, CAST(a.ordinal AS BIGINT) AS ordinal, a.place AS place_1, b.place AS place_2, a.price AS price_1, b.price AS price_2 FROM o a JOIN o b ON b.sample = a.sample AND b.ordinal = a.ordinal AND a.file = 1 AND b.file = 2""")
def mate_zip_ordinal(spark, read):
    file = F.when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = read("orders").select((F.col("o_custkey") % 5).alias("sample"), file.alias("file"), F.col("o_orderkey").alias("place"), F.col("o_totalprice").alias("price"))
    rows = order.numbered(rows, ["sample", "file"], "place", 1 << 14)
    return classify.zip_mates(rows.filter("file = 1").drop("file"), rows.filter("file = 2").drop("file"), ["sample", "ordinal"])


@query("""SELECT user_id, median(value) AS middle, quantile_cont(value, 0.9) AS high FROM events GROUP BY user_id""")
def grouped_quantiles(spark, read):
    rows = read("events").select("user_id", "value")
    return order.quantiles(rows, ["user_id"], "value", name="middle").join(order.quantiles(rows, ["user_id"], "value", 0.9, name="high"), "user_id")


# ---- hit patterns and variants ----


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
SELECT a.event_id, a.user_id, CAST(sum(b.h << (a.r - b.r)) AS BIGINT) AS pattern, count(*) AS n_seen FROM e a JOIN e b ON a.user_id = b.user_id AND b.r BETWEEN a.r - 7 AND a.r GROUP BY a.event_id, a.user_id""")
def hit_pattern_window(spark, read):
    rows = variants.sliding_pattern(read("events").select("event_id", "user_id", "value"), ["user_id"], "event_id", F.col("value") > 50, 8)
    return rows.select("event_id", "user_id", "pattern", F.col("n_seen").cast("long").alias("n_seen"))


SMALL = Shape("X_XX")


def _sql_train(shape: Shape, bits: int) -> str:
    """All sets of mutated positions, the pattern of each, and the positions that all sets of a pattern share."""
    span = bits + len(shape) - 1
    pattern = " + ".join(f"CASE WHEN m & {sum(1 << (i + o) for o in shape.take)} = 0 THEN {1 << i} ELSE 0 END" for i in range(bits))
    return f"""WITH s AS (SELECT m, {pattern} AS pattern FROM range(1, {1 << span}) x(m)), a AS (SELECT pattern, bit_and(m) AS m FROM s GROUP BY pattern HAVING pattern <> {(1 << bits) - 1})
SELECT CAST(pattern AS BIGINT) AS pattern, list_filter(range(0, {span}), lambda j: (m >> j) & 1 = 1) AS mutations FROM a"""


@query(_sql_train(SMALL, 8))
def pattern_train(spark, read):
    return variants.train(spark, SMALL, 8).select("pattern", F.col("mutations").cast("array<bigint>").alias("mutations"))


LEVELS = 7


@query(f"""WITH e AS (SELECT event_id, user_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
p AS (SELECT a.event_id, CAST(sum(b.h << (7 - (a.r - b.r))) AS BIGINT) AS pattern FROM e a JOIN e b ON a.user_id = b.user_id AND b.r BETWEEN a.r - 7 AND a.r GROUP BY a.event_id HAVING count(*) = 8),
k AS ({_sql_train(SMALL, 8)}), c AS (SELECT k.*, {8 + len(SMALL) - 1} - bit_count({' | '.join(f"(CASE WHEN (pattern >> {i}) & 1 = 1 THEN {sum(1 << (i + o) for o in SMALL.take)} ELSE 0 END)" for i in range(8))}) AS candidates FROM k)
SELECT CAST(candidates AS INT) AS candidates, count(*) AS windows, sum(len(mutations)) AS told FROM p JOIN c USING (pattern) WHERE candidates <= {LEVELS} GROUP BY ALL""")
def pattern_levels(spark, read):
    rows = variants.sliding_pattern(read("events").select("event_id", "user_id", "value"), ["user_id"], "event_id", F.col("value") > 50, 8)
    rows = rows.filter("n_seen = 8").select("event_id", F.col("turned").alias("pattern")).join(variants.trained(spark, SMALL, 8, LEVELS), "pattern")
    return rows.groupBy("candidates").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.size("mutations")).alias("told"))


BITS = 6


def _sql_closed_form(shape: Shape, bits: int) -> str:
    span = bits + len(shape) - 1
    masks = [sum(1 << (i + o) for o in shape.take) for i in range(bits)]
    listed = "[" + ", ".join(map(str, masks)) + "]"
    return f"""pt AS (SELECT pattern, unnest(list_filter(range(0, {span}), lambda j: len(list_filter(range(0, {bits}), lambda i: (pattern >> i) & 1 = 0 AND (free & {listed}[i + 1]) = (1 << j))) > 0)) AS m
FROM (SELECT pattern, {(1 << span) - 1} & ~list_reduce(list_prepend(0, list_transform(range(0, {bits}), lambda i: CASE WHEN (pattern >> i) & 1 = 1 THEN {listed}[i + 1] ELSE 0 END)), lambda x, y: x | y) AS free FROM range(0, {(1 << bits) - 1}) r(pattern))
WHERE len(list_filter(range(0, {bits}), lambda i: (pattern >> i) & 1 = 0 AND (free & {listed}[i + 1]) = 0)) = 0)"""


@query(f"""WITH {SQL_HITS}, {_sql_closed_form(SHAPE, BITS)}, g AS (SELECT doc_id FROM h GROUP BY doc_id HAVING count(taxid) >= 20),
q AS (SELECT doc_id, pos, CASE WHEN taxid IS NULL THEN 0 ELSE 1 END AS hit FROM h SEMI JOIN g USING (doc_id)),
w AS (SELECT a.doc_id, a.pos, sum(b.hit << CAST(b.pos - a.pos AS INT)) AS pattern FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + {BITS - 1} GROUP BY a.doc_id, a.pos HAVING count(*) = {BITS})
SELECT DISTINCT doc_id, CAST(pos + m AS INT) AS position FROM w JOIN pt USING (pattern)""")
def hit_pattern_call(spark, read):
    hits = written(doc_hits(read).filter("taxid is not null").select("doc_id", "pos"))
    good = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits")).filter("hits >= 20").select("doc_id")
    sizes = doc_dna(read).select("doc_id", (F.length("dna") - (len(SHAPE) - 1)).alias("n_kmers"))
    return variants.call_hits(hits.join(good, "doc_id", "left_semi"), sizes, variants.train(spark, SHAPE, BITS), "doc_id", SHAPE, BITS)


SQL_PLACED = f"""{SQL_LEAF}, {SQL_NODES}, {SQL_CLOSED}, v AS (SELECT doc_id, taxid, gene_id, forward, o, count(*) AS votes FROM (SELECT *, true AS forward, gene_pos - pos AS o FROM lh UNION ALL SELECT *, false, gene_pos + pos FROM lh) GROUP BY ALL),
pl AS (SELECT doc_id, taxid AS t, gene_id AS g, forward, o, n, m FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, forward, o, taxid, gene_id) AS r FROM v) JOIN (SELECT doc_id, length({sql_dna('text')}) AS n FROM documents) USING (doc_id)
JOIN (SELECT CAST(item_id + 2 AS INT) AS taxid, CAST(item_id % 3 + 1 AS INT) AS gene_id, length({sql_dna('text')}) AS m FROM benchmark) USING (taxid, gene_id) WHERE r = 1),
mk AS MATERIALIZED (SELECT h.doc_id, h.pos, t, g, forward, o, n, m, CASE WHEN (h.taxid = t AND h.gene_id = g AND g > 0 AND o = CASE WHEN forward THEN gene_pos - pos ELSE gene_pos + pos END)
OR (h.gene_id = 0 AND EXISTS (SELECT 1 FROM cl WHERE cl.id = t AND cl.ancestor_id = h.taxid)) THEN 1 ELSE 0 END AS hit
FROM h JOIN pl USING (doc_id) WHERE CASE WHEN forward THEN o + pos >= 0 AND o + pos + {len(SHAPE)} <= m ELSE o - pos >= 0 AND o - pos + {len(SHAPE)} <= m END)"""


def marked_documents(read) -> DataFrame:
    """Reads are placed by their leaf hits; only the part of a read that lies in its gene is then made k-mers of again, and moves."""
    genes = gene_table(read).select(F.col("species").alias("taxid"), "gene_id", F.length("dna").alias("gene_length"))
    ix = written(gene_index(read))
    best = placement.best_placement(classify.best_offsets(leaf_hits(read, doc_hits(read, ix)), "doc_id"), ["doc_id"]).join(genes, ["taxid", "gene_id"])
    placed = written(placement.in_gene(best.join(doc_dna(read).withColumn("read_length", F.length("dna")), "doc_id"), "dna", SHAPE))
    rows = kmers.kmers(placed.select("doc_id", "begin", "dna"), "dna", SHAPE, ["doc_id", "begin"]).withColumn("pos", F.col("pos") + F.col("begin")).drop("begin")
    return placement.marked(classify.lookup(rows, ix), placed.drop("begin", "dna"), taxonomy.closure(gene_nodes(read)), SHAPE, ["doc_id"])


@query(f"""WITH RECURSIVE {SQL_PLACED}, {_sql_closed_form(SHAPE, BITS)},
w AS (SELECT a.doc_id, a.t, a.g, a.forward, a.o, a.pos, sum(b.hit << CAST(b.pos - a.pos AS INT)) AS pattern FROM mk a JOIN mk b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + {BITS - 1} GROUP BY ALL HAVING count(*) = {BITS} AND sum(b.hit) > 0)
SELECT doc_id, t AS taxid, g AS gene_id, forward, CAST(CASE WHEN forward THEN o + pos + m ELSE o - pos - m + {len(SHAPE) - 1} END AS INT) AS gene_position, CAST(min(pos + m) AS INT) AS read_position FROM w JOIN pt USING (pattern) GROUP BY ALL""")
def snp_call(spark, read):
    return placement.call(marked_documents(read), variants.train(spark, SHAPE, BITS), SHAPE, BITS, ["doc_id"])


@query(f"""WITH RECURSIVE {SQL_PLACED} SELECT doc_id, t AS taxid, g AS gene_id, CAST(CASE WHEN forward THEN o ELSE o - (n - {len(SHAPE)}) END AS INT) AS gene_pos, sum(hit) AS hits_best, count(*) AS total_hits, CAST(n AS INT) AS read_length,
CAST(greatest(0, least(CASE WHEN forward THEN o ELSE o - (n - {len(SHAPE)}) END + n, m) - greatest(CASE WHEN forward THEN o ELSE o - (n - {len(SHAPE)}) END, 0)) AS INT) AS overlap, forward FROM mk GROUP BY doc_id, t, g, forward, o, n, m""")
def classification_rows(spark, read):
    return placement.result_rows(marked_documents(read), SHAPE, ["doc_id"])


@query(f"""WITH RECURSIVE {SQL_PLACED} SELECT doc_id, t AS taxid, g AS gene_id, string_agg(CAST(hit AS VARCHAR), '' ORDER BY pos) AS pattern, sum(hit) AS hits, t = doc_id % 40 + 2 AS correct FROM mk GROUP BY doc_id, t, g""")
def classification_debug(spark, read):
    return placement.debug_rows(marked_documents(read), ["doc_id"], F.col("doc_id") % 40 + 2)


SQL_SNP_READS = "rd AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS forward, CAST(l_quantity AS INT) % 20 AS read_position, CAST(l_partkey % 500 AS INT) AS gene_position, repeat('ACGTN', 4) AS sequence, '!#%)+-/13579;=?ACEGI' AS quality FROM lineitem)"


@query(f"""WITH {SQL_SNP_READS} SELECT l_orderkey, l_linenumber, forward, gene_position, read_position, CASE WHEN forward THEN b ELSE translate(b, 'ACGT', 'TGCA') END AS base, ascii(substr(quality, read_position + 1, 1)) AS quality
FROM (SELECT *, substr(sequence, read_position + 1, 1) AS b FROM rd) WHERE b <> 'N'""")
def snp_rows(spark, read):
    li = read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "A").alias("forward"), (F.col("l_partkey") % 500).cast("int").alias("gene_position"), (F.col("l_quantity").cast("int") % 20).alias("read_position"))
    reads = li.select("l_orderkey", "l_linenumber", F.repeat(F.lit("ACGTN"), 4).alias("sequence"), F.lit("!#%)+-/13579;=?ACEGI").alias("quality")).distinct()
    return placement.snp_rows(li, reads, ["l_orderkey", "l_linenumber"])


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 9 AS INT) AS gene, l_returnflag = 'A' AS forward, CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS INT) - 10 END AS o, CAST(20 + l_linenumber AS INT) AS len, CAST(l_quantity AS INT) AS hits FROM lineitem WHERE l_linenumber <= 2)
SELECT l_orderkey, min(gene) FILTER (o IS NOT NULL) AS gene_id, CAST(min(CASE WHEN forward THEN o ELSE o - (len - {len(SHAPE)}) END) AS INT) AS gene_pos, sum(len) FILTER (o IS NOT NULL) AS read_length, sum(hits) AS hits_best, count(o) AS placed FROM m GROUP BY l_orderkey""")
def paired_rows(spark, read):
    q = F.col("l_quantity").cast("int")
    mates = read("lineitem").filter("l_linenumber <= 2").select("l_orderkey", (F.col("l_partkey") % 9).cast("int").alias("gene_id"), (F.col("l_returnflag") == "A").alias("forward"), F.when(F.col("l_linestatus") == "O", q - 10).alias("offset"), (20 + F.col("l_linenumber")).cast("int").alias("read_length"), q.alias("hits"))
    return placement.paired_rows(mates, SHAPE, "l_orderkey")


# ---- pairs of reads: documents 2i and 2i + 1 are mates ----


def pair_hits(read) -> DataFrame:
    return doc_hits(read).select(F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2 + 1).cast("int").alias("mate"), "pos", "taxid", "gene_id", "gene_pos")


@query(f"""WITH {SQL_LEAF}, f AS (SELECT doc_id, taxid, gene_id, min_by(gene_pos - pos, pos) AS a, min_by(gene_pos + pos, pos) AS b FROM lh GROUP BY ALL),
n AS (SELECT doc_id, taxid, gene_id, greatest(count(*) FILTER (gene_pos - pos = a), count(*) FILTER (gene_pos + pos = b)) AS hits FROM f JOIN lh USING (doc_id, taxid, gene_id) GROUP BY ALL)
SELECT doc_id // 2 AS pair, taxid, gene_id, sum(hits) AS hits, coalesce(sum(hits) FILTER (doc_id % 2 = 0), 0) AS hits_1, coalesce(sum(hits) FILTER (doc_id % 2 = 1), 0) AS hits_2 FROM n GROUP BY ALL""")
def mate_hits(spark, read):
    return classify.mate_hits(classify.fold_offsets(pair_hits(read).filter(classify.is_leaf_hit(F.lit(GENUS - 1))), ["pair", "mate"]), "pair", "mate")


def _sql_pair_descent() -> str:
    """As _sql_descent(), for pairs: the way down by the hits of both mates, the sums of each mate along it."""
    out = [f"""WITH RECURSIVE {SQL_HITS}, t AS MATERIALIZED (SELECT doc_id // 2 AS pair, taxid, count(*) AS hits, count(*) FILTER (doc_id % 2 = 0) AS h1, count(*) FILTER (doc_id % 2 = 1) AS h2 FROM h WHERE taxid IS NOT NULL GROUP BY ALL), {SQL_LINEAGE},
l0 AS MATERIALIZED (SELECT t.*, li.* EXCLUDE id FROM t JOIN li ON li.id = t.taxid WHERE taxid <> 1), a0 AS MATERIALIZED (SELECT pair, 1 AS node, coalesce(sum(h1) FILTER (taxid = 1), 0) AS p1, coalesce(sum(h2) FILTER (taxid = 1), 0) AS p2, true AS going FROM t GROUP BY pair)"""]
    for i, r in enumerate(RANKS):
        out.append(
            f"""t{i} AS (SELECT pair, sum(hits) AS total, bool_or({r} IS NOT NULL) AS has FROM l{i} GROUP BY pair),
b{i} AS MATERIALIZED (SELECT l.pair, {r} AS nx FROM l{i} l JOIN a{i} a USING (pair) JOIN t{i} USING (pair) WHERE going AND {r} IS NOT NULL GROUP BY l.pair, {r}, total HAVING sum(hits) > 0.7 * total AND sum(hits) >= 3),
a{i + 1} AS MATERIALIZED (SELECT a.pair, coalesce(nx, node) AS node, p1 + coalesce(h.h1, 0) AS p1, p2 + coalesce(h.h2, 0) AS p2, going AND (NOT coalesce(has, false) OR nx IS NOT NULL) AS going FROM a{i} a LEFT JOIN t{i} USING (pair) LEFT JOIN b{i} b USING (pair) LEFT JOIN t h ON h.pair = a.pair AND h.taxid = nx),
l{i + 1} AS MATERIALIZED (SELECT l.* FROM l{i} l JOIN a{i} a USING (pair) LEFT JOIN t{i} USING (pair) LEFT JOIN b{i} USING (pair) WHERE CASE WHEN going AND coalesce(has, false) THEN coalesce({r} = nx, false) ELSE true END AND taxid IS DISTINCT FROM nx)"""
        )
    return ",\n".join(out) + f" SELECT pair, node AS taxid, p1 AS path_hits_1, p2 AS path_hits_2 FROM a{len(RANKS)} WHERE p1 > 3 OR p2 > 3"


def pair_taxa(read) -> DataFrame:
    each = [F.count_if(F.col("mate") == m).alias(f"hits_{m}") for m in (1, 2)]
    return pair_hits(read).filter("taxid is not null").groupBy("pair", "taxid").agg(F.count(F.lit(1)).alias("hits"), *each)


@query(_sql_pair_descent())
def classify_descent_pairs(spark, read):
    return classify.assign(pair_taxa(read), "pair", "descent", lineages=gene_lineages(read), ranks=RANKS, mates=["hits_1", "hits_2"])


@query(f"""WITH RECURSIVE {SQL_LEAF}, {SQL_NODES}, {SQL_CLOSED}, nd2 AS (SELECT doc_id, taxid, CASE WHEN taxid < {GENUS} THEN gene_id ELSE 0 END AS gene_id, count(*) AS hits FROM h WHERE taxid IS NOT NULL GROUP BY ALL),
an AS (SELECT doc_id, taxid, gene_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, taxid, gene_id) AS r FROM nd2) WHERE r = 1)
SELECT an.doc_id, an.taxid, an.gene_id, sum(hits) AS support FROM an JOIN cl ON cl.id = an.taxid JOIN nd2 n ON n.doc_id = an.doc_id AND n.taxid = cl.ancestor_id WHERE n.taxid = 1 OR n.taxid >= {GENUS} OR an.gene_id < 1 OR an.gene_id = n.gene_id GROUP BY ALL""")
def taxon_sums(spark, read):
    leaf = (F.col("taxid") > 1) & (F.col("taxid") < GENUS)
    nodes = doc_hits(read).filter("taxid is not null").groupBy("doc_id", "taxid", F.when(F.col("taxid") < GENUS, F.col("gene_id")).otherwise(0).alias("gene_id")).agg(F.count(F.lit(1)).alias("hits"))
    best = nodes.groupBy("doc_id").agg(F.max_by(F.struct("taxid", "gene_id"), F.struct("hits", -F.col("taxid"), -F.col("gene_id"))).alias("b")).select("doc_id", "b.*")
    return classify.taxon_sums(nodes, best, taxonomy.closure(gene_nodes(read)), leaf, "doc_id")


@query(f"""WITH RECURSIVE {SQL_LEAF}, {SQL_NODES}, {SQL_CLOSED}, f AS (SELECT doc_id, taxid, gene_id, min_by(gene_pos - pos, pos) AS a, min_by(gene_pos + pos, pos) AS b, min(pos) AS p FROM lh GROUP BY ALL),
s AS (SELECT i.doc_id, i.pos, i.gene_id, min_by(f.taxid, (f.p, f.taxid)) AS taxid FROM h i JOIN f ON f.doc_id = i.doc_id AND f.gene_id = i.gene_id AND (i.gene_pos - i.pos = a OR i.gene_pos + i.pos = b) JOIN cl ON cl.id = f.taxid AND cl.ancestor_id = i.taxid AND distance > 0
WHERE i.gene_id > 0 AND i.gene_pos > 0 AND (i.taxid = 1 OR i.taxid >= {GENUS}) GROUP BY ALL) SELECT doc_id, taxid, gene_id, count(*) AS inner FROM s GROUP BY ALL""".replace("AS inner FROM", 'AS "inner" FROM'))
def inner_support(spark, read):
    inner = doc_hits(read).filter((F.col("gene_id") > 0) & (F.col("gene_pos") > 0) & ((F.col("taxid") == 1) | (F.col("taxid") >= GENUS)))
    return classify.inner_support(inner, classify.fold_offsets(leaf_hits(read), "doc_id"), taxonomy.closure(gene_nodes(read)), "doc_id")


#: As benchmark, but a gene shares its first 60 letters with the one 24 before it, which is of its genus and number.
SQL_SHARED = """bench AS (SELECT i.item_id, CASE WHEN o.item_id IS NULL THEN i.d ELSE substr(o.d, 1, 60) || substr(i.d, 61) END AS text FROM (SELECT item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS d FROM benchmark) i
LEFT JOIN (SELECT item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS d FROM benchmark) o ON o.item_id = i.item_id - 24)"""


def shared_benchmark(read) -> DataFrame:
    own = read("benchmark").select("item_id", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("d"))
    other = own.select((F.col("item_id") + 24).alias("item_id"), F.col("d").alias("o"))
    text = F.when(F.col("o").isNull(), F.col("d")).otherwise(F.concat(F.substring("o", 1, 60), F.substring("d", 61, 1 << 30)))
    return own.join(other, "item_id", "left").select("item_id", text.alias("text"))


@query(ORACLES["inner_support"].replace("FROM benchmark", "FROM bench").replace("WITH RECURSIVE ", f"WITH RECURSIVE {SQL_SHARED}, ", 1))
def inner_support_shared(spark, read):
    return inner_support(spark, lambda table: shared_benchmark(read) if table == "benchmark" else read(table))


@query(f"""WITH RECURSIVE {SQL_SCORES}, m AS (SELECT *, score - min(score) OVER (PARTITION BY doc_id) + 1 AS l FROM sc), c AS (SELECT *, hits / score AS rc, l / sum(l) OVER (PARTITION BY doc_id) AS cc, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, taxid) AS r FROM m),
v AS (SELECT doc_id, string_agg(CAST(hits AS VARCHAR), ',' ORDER BY r) AS own_vector, string_agg(CAST(score AS VARCHAR), ',' ORDER BY r) AS total_vector FROM c GROUP BY doc_id)
SELECT c.doc_id, CAST(doc_id % 40 + 2 AS INT) AS truth, c.taxid, EXISTS (SELECT 1 FROM cl WHERE cl.id = doc_id % 40 + 2 AND cl.ancestor_id = c.taxid) AS correct, own_vector, total_vector, round(rc, 6) AS rank_confidence, round(cc, 6) AS candidate_confidence, score AS total_hits, hits AS own_hits
FROM c JOIN v USING (doc_id) WHERE r = 1""")
def classification_vectors(spark, read):
    rows = classify.score_vectors(doc_scores(read), taxonomy.closure(gene_nodes(read)), "doc_id", (F.col("doc_id") % 40 + 2).cast("int"))
    return rows.withColumns({c: F.round(c, 6) for c in ("rank_confidence", "candidate_confidence")})


@query(f"""WITH {SQL_LEAF}, f AS (SELECT doc_id, taxid, gene_id, min_by(gene_pos - pos, pos) AS f0, min_by(gene_pos + pos, pos) AS r0 FROM lh GROUP BY ALL),
o AS (SELECT doc_id, taxid, gene_id, gene_pos - pos AS f, bool_or(gene_pos - pos <> f0 AND gene_pos + pos <> r0) AS other FROM lh JOIN f USING (doc_id, taxid, gene_id) GROUP BY ALL)
SELECT doc_id, count(*) FILTER (other) > 0 AS ambiguous, count(*) FILTER (other) AS alternatives FROM o GROUP BY doc_id""")
def ambiguous_placements(spark, read):
    return classify.ambiguous(leaf_hits(read), "doc_id")


@query(f"""WITH RECURSIVE {SQL_TAXA}, {SQL_NODES}, {SQL_CLOSED}, n AS (SELECT doc_id, cl.ancestor_id AS id, coalesce(sum(hits) FILTER (taxid = cl.ancestor_id), 0) AS hits FROM t JOIN cl ON cl.id = t.taxid GROUP BY ALL),
l AS (SELECT n.doc_id, n.id, CASE WHEN nd.parent_id = nd.id THEN NULL ELSE nd.parent_id END AS up, nd.rank, n.id || '_hits=' || n.hits AS label FROM n JOIN nd USING (id)),
s3 AS (SELECT doc_id, up AS id, string_agg(label, ',' ORDER BY id) AS c FROM l WHERE rank = 'species' GROUP BY ALL),
s2 AS (SELECT l.doc_id, up AS id, string_agg(coalesce('(' || c || ')', '') || label, ',' ORDER BY l.id) AS c FROM l LEFT JOIN s3 USING (doc_id, id) WHERE rank = 'genus' GROUP BY ALL),
s1 AS (SELECT l.doc_id, up AS id, string_agg(coalesce('(' || c || ')', '') || label, ',' ORDER BY l.id) AS c FROM l LEFT JOIN s2 USING (doc_id, id) WHERE rank = 'phylum' GROUP BY ALL)
SELECT l.doc_id, coalesce('(' || c || ')', '') || label || ';' AS tree FROM l LEFT JOIN s1 USING (doc_id, id) WHERE rank = 'root'""")
def read_trees(spark, read):
    return trees.newick(trees.read_nodes(classify.read_taxa(doc_hits(read), "doc_id"), taxonomy.closure(gene_nodes(read)), "doc_id"), "doc_id")


@query(f"""WITH {SQL_HITS}, {SQL_NODES} SELECT doc_id, count(*) FILTER (rank = 'species') AS species, count(*) FILTER (rank = 'genus') AS genus, count(*) FILTER (rank = 'phylum') AS phylum, count(*) FILTER (rank = 'root') AS no_rank, count(*) FILTER (taxid IS NULL) AS missing FROM h LEFT JOIN nd ON nd.id = h.taxid GROUP BY doc_id""")
def index_composition(spark, read):
    return index.composition(doc_hits(read), gene_nodes(read).select(F.col("id").alias("taxid"), "rank"), "doc_id", RANKS[::-1])


@query(f"""WITH {SQL_GENE_KMERS} SELECT key, max(species) AS taxid, sum(gene_id) AS total FROM (SELECT DISTINCT key, species, gene_id FROM gk) GROUP BY key""")
def index_upsert(spark, read):
    rows = gene_kmers(read).select("key", F.col("species").alias("taxid"), F.col("gene_id").cast("long").alias("total"))
    once = rows.distinct()
    low = once.filter("taxid <= 20").groupBy("key").agg(F.max("taxid").alias("taxid"), F.sum("total").alias("total"))
    return index.upsert(low, once.filter("taxid > 20"), {"taxid": F.max("taxid"), "total": F.sum("total")})


@query(f"""WITH {SQL_GENE_KMERS} SELECT key, min(species) AS taxid, bit_xor(gene_id * 4096 + pos) AS folded FROM gk GROUP BY key""")
def index_upsert_custom(spark, read):
    @F.pandas_udf("long")
    def folded(v: pd.Series) -> int:
        return int(np.bitwise_xor.reduce(v.to_numpy()))

    rows = gene_kmers(read).select("key", F.col("species").alias("taxid"), (F.col("gene_id").cast("long") * 4096 + F.col("pos")).alias("folded"))
    return index.upsert(rows.filter("taxid <= 20"), rows.filter("taxid > 20"), {"taxid": F.min("taxid")}, {"folded": folded("folded")})


@query(f"""{_sql_descent().rsplit(' SELECT doc_id, node', 1)[0]}, n AS (SELECT doc_id, count(*) AS n_kmers, count(taxid) AS hits FROM h GROUP BY doc_id)
SELECT count(*) AS reads, sum(n_kmers) AS kmers, sum(n.hits) AS hits, sum(n_kmers - n.hits) AS misses, count(a.doc_id) AS classified, count(*) - count(a.doc_id) AS unclassified FROM n LEFT JOIN (SELECT doc_id FROM a{len(RANKS)} WHERE path > 3) a USING (doc_id)""")
def run_counters(spark, read):
    taxa = written(doc_hits(read).groupBy("doc_id", "taxid").agg(F.count(F.lit(1)).alias("hits")))
    found = F.when(F.col("taxid").isNotNull(), F.col("hits")).otherwise(0)
    per_read = taxa.groupBy("doc_id").agg(F.sum("hits").alias("n_kmers"), F.sum(found).alias("hits"))
    answers = classify.descend(taxa.filter("taxid is not null"), gene_lineages(read), RANKS, "doc_id")
    return classify.run_counters(per_read, answers, "doc_id")


@query(f"""WITH RECURSIVE {SQL_INDEX}, {SQL_NODES}, {SQL_CLOSED}, g AS (SELECT species, gk.gene_id, pos, ix.taxid FROM gk JOIN ix USING (key)), n AS (SELECT species, gene_id, count(*) AS n FROM g GROUP BY ALL),
w AS (SELECT species, gene_id, i, taxid, count(*) AS hits FROM (SELECT *, unnest(range(greatest(pos - 84, -65), pos + 1)) AS i FROM g) GROUP BY ALL),
sc AS (SELECT w.species, w.gene_id, w.i, w.taxid, sum(a.hits) AS score FROM w JOIN cl ON cl.id = w.taxid JOIN w a ON a.species = w.species AND a.gene_id = w.gene_id AND a.i = w.i AND a.taxid = cl.ancestor_id GROUP BY ALL),
b AS (SELECT species, gene_id, i, taxid FROM (SELECT *, row_number() OVER (PARTITION BY species, gene_id, i ORDER BY score DESC, taxid) AS r FROM sc) WHERE r = 1)
SELECT n.species AS taxid, n.gene_id, round(coalesce(k, 0) / (n + 130), 9) AS factor FROM n LEFT JOIN (SELECT species, gene_id, count(*) AS k FROM b WHERE taxid = species GROUP BY ALL) USING (species, gene_id)""")
def abundance_correction(spark, read):
    rows = gene_kmers(read).select("key", "species", F.col("gene_id").alias("gene"), "pos").join(gene_index(read).select("key", "taxid"), "key")
    found = correction.factors(rows, taxonomy.closure(gene_nodes(read)), "species", "gene")
    return found.withColumn("factor", F.round("factor", 9))


@query(f"""WITH s AS (SELECT m, {' + '.join(f"CASE WHEN m & {sum(1 << (i + o) for o in SMALL.take)} = 0 THEN {1 << i} ELSE 0 END" for i in range(8))} AS pattern FROM range(1, {1 << (8 + len(SMALL) - 1)}) x(m)),
a AS (SELECT pattern, bit_count(bit_and(m)) AS k FROM s GROUP BY pattern HAVING pattern <> 255) SELECT CAST(k AS INT) AS mutations, count(*) AS patterns, round(count(*) / 255, 9) AS share FROM a GROUP BY k""")
def pattern_statistics(spark, read):
    return shapes.told_by_limit(variants.train(spark, SMALL, 8), 8).withColumn("share", F.round("share", 9))


@query("""WITH RECURSIVE d AS (SELECT [CAST(x AS INT)] AS distances, x AS total FROM range(0, 9) r(x) UNION ALL SELECT list_append(distances, CAST(x AS INT)), total + x FROM d, range(0, 9) r(x) WHERE len(distances) < 3 AND total + x <= 8) SELECT distances FROM d WHERE len(distances) = 3""")
def mutation_distances(spark, read):
    return shapes.distances(spark, 12, 3)


SQL_TOLD = """td AS (SELECT l_orderkey AS r, l_partkey % 50 AS p FROM lineitem WHERE l_returnflag <> 'N'), tr AS (SELECT l_orderkey AS r, l_partkey % 50 AS p FROM lineitem WHERE l_linestatus = 'F')"""


def told_and_true(read) -> tuple[DataFrame, DataFrame]:
    rows = read("lineitem").select(F.col("l_orderkey").alias("r"), (F.col("l_partkey") % 50).alias("position"), "l_returnflag", "l_linestatus")
    return rows.filter("l_returnflag <> 'N'"), rows.filter("l_linestatus = 'F'")


@query(f"WITH {SQL_TOLD} SELECT r, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (b AND NOT a) AS fn FROM (SELECT r, p, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT *, true AS a, false AS b FROM td UNION ALL SELECT *, false, true FROM tr) GROUP BY r, p) GROUP BY r")
def read_evaluation(spark, read):
    return shapes.truth_counts(*told_and_true(read), ["r"])


@query(f"WITH {SQL_TOLD} SELECT p AS position, count(DISTINCT r) AS missed FROM tr WHERE NOT EXISTS (SELECT 1 FROM td WHERE td.r = tr.r AND td.p = tr.p) GROUP BY p")
def missed_positions(spark, read):
    return shapes.missed_by_position(*told_and_true(read), ["r"])


# ---- intervals ----

SQL_RANGES = "rg AS (SELECT l_partkey AS gene, l_suppkey AS sample, l_returnflag AS flag, CAST(l_quantity AS INT) * 7 + CAST(l_linenumber * 11 AS INT) AS start, CAST(l_quantity AS INT) * 7 + CAST(l_linenumber * 11 AS INT) + 20 + CAST(l_orderkey % 30 AS INT) AS \"end\" FROM lineitem)"
SQL_MERGE = """SELECT gene, min(start) AS start, max("end") AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY gene ORDER BY start, "end", rn) AS island FROM
(SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY gene ORDER BY start, "end", rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM (SELECT *, row_number() OVER () AS rn FROM {}))) GROUP BY gene, island"""


def ranges(read) -> DataFrame:
    start = F.col("l_quantity").cast("int") * 7 + (F.col("l_linenumber") * 11).cast("int")
    return read("lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("flag"), start.alias("start"), (start + 20 + (F.col("l_orderkey") % 30).cast("int")).alias("end"))


@query(f"WITH {SQL_RANGES} {SQL_MERGE.format('rg')}")
def interval_merge(spark, read):
    return intervals.merge(ranges(read), ["gene"])


@query(f"""WITH {SQL_RANGES}, a AS ({SQL_MERGE.format("(SELECT * FROM rg WHERE flag = 'A')")}), b AS ({SQL_MERGE.format("(SELECT * FROM rg WHERE flag = 'R')")})
SELECT gene, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM a JOIN b USING (gene) WHERE a.start < b."end" AND b.start < a."end" """)
def interval_intersect(spark, read):
    r = ranges(read)
    return intervals.intersect(intervals.merge(r.filter("flag = 'A'"), ["gene"]), intervals.merge(r.filter("flag = 'R'"), ["gene"]), ["gene"])


@query(f"""WITH {SQL_RANGES} {SQL_MERGE.format("(SELECT * FROM rg WHERE flag IN ('A', 'R'))")}""")
def interval_union(spark, read):
    r = ranges(read)
    return intervals.union(r.filter("flag = 'A'"), r.filter("flag = 'R'"), ["gene"])


SQL_SWEEP = """sw AS (SELECT gene, loc AS start, lead(loc) OVER (PARTITION BY gene ORDER BY loc) AS "end", sum(d) OVER (PARTITION BY gene ORDER BY loc) AS coverage FROM
(SELECT gene, loc, sum(d) AS d FROM (SELECT gene, start AS loc, 1 AS d FROM rg UNION ALL SELECT gene, "end", -1 FROM rg) GROUP BY gene, loc HAVING sum(d) <> 0))"""


@query(f'WITH {SQL_RANGES}, {SQL_SWEEP} SELECT gene, start, "end", CAST(coverage AS BIGINT) AS coverage FROM sw WHERE coverage > 0')
def coverage_sweep(spark, read):
    return intervals.sweep(ranges(read), ["gene"])


@query(f"""WITH {SQL_RANGES}, {SQL_SWEEP}, m AS ({SQL_MERGE.format("(SELECT * FROM sw WHERE coverage >= 2)")}) SELECT gene, start, "end" FROM m WHERE "end" - start >= 30""")
def coverage_runs(spark, read):
    return intervals.runs(ranges(read), ["gene"])


@query(f"""WITH {SQL_RANGES}, p AS (SELECT DISTINCT l_partkey AS gene, CAST(l_quantity AS INT) * 9 AS point FROM lineitem) SELECT gene, point, count(*) FILTER (start <= point AND point < "end") AS coverage FROM p LEFT JOIN rg USING (gene) GROUP BY gene, point""")
def coverage_at_locus(spark, read):
    points = read("lineitem").select(F.col("l_partkey").alias("gene"), (F.col("l_quantity").cast("int") * 9).alias("point")).distinct()
    return intervals.coverage_at(points, ranges(read), ["gene"], "point")


@query(f"""WITH {SQL_RANGES}, m AS ({SQL_MERGE.format('rg')}), p AS (SELECT DISTINCT l_partkey AS gene, CAST(l_quantity AS INT) * 9 AS point FROM lineitem) SELECT gene, point, start, "end" FROM p JOIN m USING (gene) WHERE start <= point AND point < "end" """)
def point_in_interval(spark, read):
    points = read("lineitem").select(F.col("l_partkey").alias("gene"), (F.col("l_quantity").cast("int") * 9).alias("point")).distinct()
    return intervals.containing(points, intervals.merge(ranges(read), ["gene"]), ["gene"], "point")


@query(f"""WITH {SQL_RANGES}, m AS ({SQL_MERGE.format("(SELECT * FROM rg WHERE flag = 'R')")}) SELECT gene, sample, start, "end" FROM rg WHERE EXISTS (SELECT 1 FROM m WHERE m.gene = rg.gene AND m.start <= rg.start AND rg.start < m."end")""")
def reads_inside(spark, read):
    r = ranges(read)
    return intervals.starting_inside(r, intervals.merge(r.filter("flag = 'R'"), ["gene"]), ["gene"]).select("gene", "sample", "start", "end")


# ---- profile ----

SPAN, K = 16, 12
SQL_READS = f"""rd AS (SELECT *, CASE WHEN overlap - {SPAN} + 1 > 0 THEN power(hits / (overlap - {SPAN} + 1), 1.0 / {K}) END AS ani FROM (SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 50 + 2 AS INT) AS taxid, CAST(l_partkey % 12 + 1 AS INT) AS gene_id,
CAST(l_quantity AS INT) * 13 % 400 AS pos, greatest(0, least(CAST(l_quantity AS INT) * 13 % 400 + 100, 300 + 10 * CAST(l_partkey % 12 + 1 AS INT)) - greatest(CAST(l_quantity AS INT) * 13 % 400, 0)) AS overlap, CAST(l_orderkey % 86 AS INT) AS hits FROM lineitem))"""
SQL_GENES = "gn AS (SELECT t.t AS taxid, g.g AS gene_id, CAST(300 + 10 * g.g AS INT) AS length FROM (SELECT DISTINCT CAST(l_suppkey % 50 + 2 AS INT) AS t FROM lineitem) t, (SELECT CAST(unnest(range(1, 13)) AS INT) AS g) g)"


def reads(read) -> DataFrame:
    pos, gene = F.col("l_quantity").cast("int") * 13 % 400, (F.col("l_partkey") % 12 + 1).cast("int")
    r = read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 50 + 2).cast("int").alias("taxid"), gene.alias("gene_id"), pos.alias("pos"), profile.clip(pos, F.lit(100), 300 + 10 * gene).alias("overlap"), (F.col("l_orderkey") % 86).cast("int").alias("hits"))
    return r.withColumn("ani", profile.ani(F.col("hits"), F.col("overlap"), SPAN, K))


def genes(read) -> DataFrame:
    taxa = read("lineitem").select((F.col("l_suppkey") % 50 + 2).cast("int").alias("taxid")).distinct()
    return taxa.select("taxid", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("gene_id")).withColumn("length", 300 + 10 * F.col("gene_id"))


@query(f"WITH {SQL_READS} SELECT l_orderkey, l_linenumber, taxid, overlap, hits, round(ani, 6) AS ani FROM rd")
def ani_estimate(spark, read):
    return reads(read).select("l_orderkey", "l_linenumber", "taxid", "overlap", "hits", F.round("ani", 6).alias("ani"))


@query(f"WITH {SQL_READS} SELECT taxid, count(*) AS reads, sum(hits) AS hits FROM rd WHERE overlap >= {SPAN} AND hits > (overlap - {SPAN} + 1) * (power(0.9, {K}) * 0.64) GROUP BY taxid")
def read_filter(spark, read):
    good = reads(read).filter((F.col("overlap") >= SPAN) & profile.read_passes(F.col("hits"), F.col("overlap"), SPAN, K))
    return good.groupBy("taxid").agg(F.count(F.lit(1)).alias("reads"), F.sum("hits").alias("hits"))


SQL_TAXA_TABLE = f"""{SQL_READS}, {SQL_GENES}, tt AS (SELECT taxid, count(*) AS reads, sum(overlap) AS bases, count(DISTINCT gene_id) AS present_genes, median(ani) AS median_ani FROM rd WHERE overlap >= {SPAN} GROUP BY taxid),
tx AS (SELECT tt.*, n AS n_genes, n * (1 - power((n - 1) / n, reads)) AS expected_genes FROM tt JOIN (SELECT taxid, count(*) AS n FROM gn GROUP BY taxid) USING (taxid))"""


@query(f"WITH {SQL_TAXA_TABLE} SELECT taxid, reads, bases, present_genes, n_genes, round(median_ani, 6) AS median_ani, round(expected_genes, 6) AS expected_genes, present_genes / expected_genes > 0.4 AND reads > 10 AND median_ani > 0.9 AS passes FROM tx")
def taxon_filter(spark, read):
    t = profile.taxon_table(reads(read).filter(F.col("overlap") >= SPAN), genes(read))
    return t.select("taxid", "reads", "bases", "present_genes", "n_genes", F.round("median_ani", 6).alias("median_ani"), F.round("expected_genes", 6).alias("expected_genes"), profile.taxon_passes(10, 0.9, 0.4).alias("passes"))


@query(f"WITH {SQL_READS} SELECT taxid, gene_id, CAST(pos // 100 AS BIGINT) AS bucket, count(*) AS reads, sum(overlap) AS bases FROM rd GROUP BY ALL")
def gene_buckets(spark, read):
    return profile.gene_buckets(reads(read))


@query(f"""WITH {SQL_READS}, {SQL_GENES}, b AS (SELECT *, length // CASE WHEN length // 100 = 0 OR 100 - length // (length // 100 + 1) < length // (length // 100) - 100 THEN length // 100 + 1 ELSE length // 100 END AS w FROM gn)
SELECT taxid, gene_id, CAST(greatest(pos, 0) // w AS BIGINT) AS bucket, count(*) AS reads FROM rd JOIN b USING (taxid, gene_id) GROUP BY ALL""")
def gene_buckets_sized(spark, read):
    return profile.sized_buckets(reads(read), genes(read))


SQL_DEPTH = f"""{SQL_READS}, {SQL_GENES}, bk AS (SELECT taxid, gene_id, count(*) AS reads, sum(overlap) AS bases, count(DISTINCT pos // 100) AS active FROM rd GROUP BY ALL),
dp AS (SELECT taxid, gene_id, reads, bases, active, n * (1 - power((n - 1) / n, reads)) AS expected_active, CASE WHEN reads > 0 THEN bases / (n * (1 - power((n - 1) / n, reads)) * (length / n)) ELSE 0 END AS depth
FROM (SELECT gn.*, coalesce(reads, 0) AS reads, coalesce(bases, 0) AS bases, coalesce(active, 0) AS active, greatest(1, ceil(length / 100)) AS n FROM gn LEFT JOIN bk USING (taxid, gene_id)))"""


@query(f"WITH {SQL_DEPTH} SELECT taxid, gene_id, reads, bases, active, round(expected_active, 6) AS expected_active, round(depth, 6) AS depth FROM dp")
def vertical_coverage(spark, read):
    d = profile.gene_depth(reads(read), genes(read))
    return d.select("taxid", "gene_id", "reads", "bases", "active", F.round("expected_active", 6).alias("expected_active"), F.round("depth", 6).alias("depth"))


@query(f"WITH {SQL_DEPTH}, td AS (SELECT taxid, median(depth) AS depth, median(depth / (1 + gene_id / 10)) AS corrected FROM dp GROUP BY taxid) SELECT taxid, round(depth, 6) AS depth, round(corrected, 6) AS corrected FROM td")
def taxon_depth(spark, read):
    d = profile.gene_depth(reads(read), genes(read))
    factors = genes(read).select("taxid", "gene_id", (1 + F.col("gene_id") / 10).alias("factor"))
    plain, fixed = profile.taxon_depth(d), profile.taxon_depth(d, factors).withColumnRenamed("depth", "corrected")
    return plain.join(fixed, "taxid").select("taxid", F.round("depth", 6).alias("depth"), F.round("corrected", 6).alias("corrected"))


@query(f"WITH {SQL_READS}, {SQL_GENES} SELECT taxid, round(b / l, 6) AS depth FROM (SELECT taxid, sum(overlap) AS b FROM rd GROUP BY taxid) JOIN (SELECT taxid, sum(length) AS l FROM gn GROUP BY taxid) USING (taxid)")
def naive_depth(spark, read):
    return profile.naive_depth(reads(read), genes(read)).select("taxid", F.round("depth", 6).alias("depth"))


def profile_nodes(read) -> DataFrame:
    leaf = genes(read).select("taxid").distinct()
    genus, phylum = F.col("taxid") % 8 + GENUS, F.col("taxid") % 2 + PHYLUM
    g = leaf.select(genus.alias("id"), phylum.alias("parent_id"), F.lit("genus").alias("rank")).distinct()
    p = leaf.select(phylum.alias("id"), F.lit(1).alias("parent_id"), F.lit("phylum").alias("rank")).distinct()
    root = leaf.limit(1).select(F.lit(1).alias("id"), F.lit(1).alias("parent_id"), F.lit("root").alias("rank"))
    return leaf.select(F.col("taxid").alias("id"), genus.alias("parent_id"), F.lit("species").alias("rank")).union(g).union(p).union(root)


SQL_ABUNDANCE = f"""{SQL_DEPTH}, td AS (SELECT taxid, median(depth) AS depth FROM dp GROUP BY taxid), ea AS (SELECT taxid AS id, 'species' AS rank, depth FROM td UNION ALL SELECT taxid % 8 + {GENUS}, 'genus', sum(depth) FROM td GROUP BY 1 UNION ALL SELECT taxid % 2 + {PHYLUM}, 'phylum', sum(depth) FROM td GROUP BY 1)"""


def abundance(read) -> DataFrame:
    nodes = profile_nodes(read)
    return profile.rank_abundance(profile.taxon_depth(profile.gene_depth(reads(read), genes(read))), taxonomy.closure(nodes), nodes)


@query(f"WITH {SQL_ABUNDANCE} SELECT id, rank, round(depth / sum(depth) OVER (PARTITION BY rank), 6) AS abundance FROM ea")
def rank_abundance(spark, read):
    return abundance(read).select("id", "rank", F.round("abundance", 6).alias("abundance"))


@query(f"WITH {SQL_ABUNDANCE} SELECT id AS taxid, rank, 'taxon ' || id AS name, round(100 * depth / sum(depth) OVER (PARTITION BY rank), 6) AS percentage FROM ea")
def profile_rows(spark, read):
    names = profile_nodes(read).select("id", F.concat(F.lit("taxon "), F.col("id")).alias("name"))
    return profile.biobox(abundance(read), names, RANKS)


def lineage_paths(nodes: DataFrame) -> DataFrame:
    """(id, taxpath, namepath) by RANKS; unset ranks are empty, and closing separators are cut later."""
    found = taxonomy.lineages(taxonomy.closure(nodes), nodes, RANKS)
    names = [F.concat(F.lit("taxon "), F.col(r).cast("string")) for r in RANKS]
    return found.select("id", taxonomy.lineage_string(RANKS).alias("taxpath"), F.array_join(F.array(*[F.coalesce(n, F.lit("")) for n in names]), "|").alias("namepath"))


@query(f"""WITH {SQL_ABUNDANCE}, ab AS (SELECT id, rank, round(100 * (depth / sum(depth) OVER (PARTITION BY rank)), 6) AS percentage FROM ea),
ln AS (SELECT taxid AS id, CAST(taxid % 2 + {PHYLUM} AS VARCHAR) || '|' || CAST(taxid % 8 + {GENUS} AS VARCHAR) || '|' || taxid AS p FROM td UNION SELECT taxid % 8 + {GENUS}, CAST(taxid % 2 + {PHYLUM} AS VARCHAR) || '|' || CAST(taxid % 8 + {GENUS} AS VARCHAR) FROM td UNION SELECT taxid % 2 + {PHYLUM}, CAST(taxid % 2 + {PHYLUM} AS VARCHAR) FROM td)
SELECT CAST(id AS VARCHAR) || s AS taxid, CASE WHEN s = '' THEN rank ELSE 'strain' END AS rank, p AS taxpath, regexp_replace(p, '([0-9]+)', 'taxon \\1', 'g') AS namepath, percentage, CASE WHEN s <> '' THEN 0 WHEN rank = 'species' THEN 1 WHEN rank = 'genus' THEN 2 ELSE 3 END AS place
FROM ab JOIN ln USING (id), (SELECT '' AS s UNION ALL SELECT '.1') WHERE s = '' OR rank = 'species'""")
def profile_lineages(spark, read):
    nodes = profile_nodes(read)
    named = nodes.select("id", "rank", (F.col("rank") == "species").alias("leaf"))
    return profile.profile_rows(abundance(read), named, lineage_paths(nodes), RANKS)


# ---- strains ----

SQL_SEEN = """se AS (SELECT CAST(l_suppkey % 4 AS INT) AS sample, CAST(l_partkey % 5 AS INT) AS taxid, CAST(l_partkey // 5 % 6 AS INT) AS gene_id, CAST(l_orderkey % 97 AS INT) AS position,
CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN CASE l_linestatus WHEN 'O' THEN 'C' ELSE 'T' END ELSE 'G' END AS base, CAST(l_quantity AS INT) AS quality FROM lineitem)"""
SQL_ALLELES = f"{SQL_SEEN}, al AS (SELECT sample, taxid, gene_id, position, base, count(*) AS n, sum(quality) AS quality, avg(quality) AS mean_quality FROM se GROUP BY ALL)"
SQL_COVER = "cv AS (SELECT sample, taxid, gene_id, position, count(*) + position % 3 AS coverage FROM se GROUP BY sample, taxid, gene_id, position)"
SQL_WITH_REF = f"{SQL_ALLELES}, {SQL_COVER}, wr AS (SELECT sample, taxid, gene_id, position, base, n FROM al UNION ALL SELECT sample, taxid, gene_id, position, 'R', coverage - s FROM (SELECT sample, taxid, gene_id, position, sum(n) AS s FROM al GROUP BY ALL) JOIN cv USING (sample, taxid, gene_id, position) WHERE coverage > s)"
SQL_MAJOR = f"{SQL_WITH_REF}, mj AS (SELECT sample, taxid, gene_id, position, count(*) FILTER (base <> 'R') AS alleles, sum(n) AS observations, arg_max(base, n * 1000 - ascii(base)) FILTER (base <> 'R') AS major FROM wr GROUP BY ALL)"
SQL_GREF = "gr AS (SELECT DISTINCT taxid, gene_id, repeat('ACGGT', 30) AS sequence FROM se)"


def seen(read) -> DataFrame:
    base = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "O", "C").otherwise("T")).otherwise("G")
    gene = (F.floor(F.col("l_partkey") / 5) % 6).cast("int")
    return read("lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("sample"), (F.col("l_partkey") % 5).cast("int").alias("taxid"), gene.alias("gene_id"), (F.col("l_orderkey") % 97).cast("int").alias("position"), base.alias("base"), F.col("l_quantity").cast("int").alias("quality"))


def with_reference(read) -> DataFrame:
    s = seen(read)
    coverage = s.groupBy(*strains.LOCUS).agg((F.count(F.lit(1)) + F.col("position") % 3).alias("coverage"))
    return strains.with_reference(strains.allele_counts(s), coverage)


@query(f"WITH {SQL_ALLELES} SELECT sample, taxid, gene_id, position, base, n, quality, round(mean_quality, 6) AS mean_quality FROM al")
def allele_counts(spark, read):
    return strains.allele_counts(seen(read)).withColumn("mean_quality", F.round("mean_quality", 6))


@query(f"WITH {SQL_WITH_REF} SELECT sample, taxid, gene_id, position, base, n FROM (SELECT *, sum(n) OVER (PARTITION BY sample, taxid, gene_id, position) AS t FROM wr) WHERE n / t >= 0.2 AND n >= 2 AND base <> 'R'")
def allele_filter(spark, read):
    return strains.frequent(with_reference(read))


@query(f"WITH {SQL_MAJOR} SELECT * FROM mj")
def major_allele(spark, read):
    return strains.locus_statistics(with_reference(read))


@query(f"WITH {SQL_ALLELES}, {SQL_GREF} SELECT sample, taxid, gene_id, position, base, n FROM al WHERE NOT EXISTS (SELECT 1 FROM al x JOIN gr USING (taxid, gene_id) WHERE x.sample = al.sample AND x.taxid = al.taxid AND x.gene_id = al.gene_id AND x.position = al.position AND x.base = substr(sequence, x.position + 1, 1))")
def drop_reference_loci(spark, read):
    s = seen(read)
    reference = s.select("taxid", "gene_id").distinct().withColumn("sequence", F.repeat(F.lit("ACGGT"), 30))
    return strains.differing_loci(strains.allele_counts(s).select(*strains.LOCUS, "base", "n"), reference)


SQL_STRAIN = f"""{SQL_MAJOR}, rs AS (SELECT DISTINCT sample, taxid, gene_id, p AS start, p + 30 AS "end" FROM (SELECT *, sample * 9 + gene_id * 5 AS p FROM se)),
pr AS (SELECT a.taxid, a.gene_id, a.sample AS sample_a, b.sample AS sample_b, greatest(a.start, b.start) AS s, least(a."end", b."end") AS e FROM rs a JOIN rs b USING (taxid, gene_id) WHERE a.sample <> b.sample AND a.start < b."end" AND b.start < a."end"),
mm AS (SELECT * FROM mj WHERE major IS NOT NULL),
gd AS (SELECT pr.taxid, pr.gene_id, sample_a, sample_b, any_value(e - s) AS shared_length, count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL) AS shared, count(*) FILTER (pa IS NOT NULL AND pb IS NULL) AS only_a, count(*) FILTER (pa IS NULL AND pb IS NOT NULL) AS only_b, count(*) FILTER (pa <> pb) AS differing
FROM pr LEFT JOIN (SELECT q.*, a.major AS pa, b.major AS pb FROM (SELECT taxid, gene_id, sample_a, sample_b, unnest(range(s, e)) AS position FROM pr) q LEFT JOIN mm a ON a.taxid = q.taxid AND a.gene_id = q.gene_id AND a.sample = sample_a AND a.position = q.position
LEFT JOIN mm b ON b.taxid = q.taxid AND b.gene_id = q.gene_id AND b.sample = sample_b AND b.position = q.position) z USING (taxid, gene_id, sample_a, sample_b) GROUP BY ALL),
sd AS (SELECT taxid, sample_a, sample_b, count(*) AS genes, sum(shared_length) AS shared_length, sum(only_a + only_b + differing) AS differences FROM gd GROUP BY ALL),
ds AS (SELECT *, CASE WHEN genes >= 3 AND differences / shared_length < 0.75 THEN -0.75 * ln(1 - 4 / 3 * differences / shared_length) END AS distance FROM sd)"""


def major_and_ranges(read) -> tuple[DataFrame, DataFrame]:
    at = F.col("sample") * 9 + F.col("gene_id") * 5
    r = seen(read).select("sample", "taxid", "gene_id", at.alias("start"), (at + 30).alias("end")).distinct()
    major = strains.locus_statistics(with_reference(read)).filter("major is not null").select(*strains.LOCUS, F.col("major").alias("base"))
    return major, intervals.merge(r, ["sample", "taxid", "gene_id"]).drop("n")


def gene_pairs(read) -> DataFrame:
    return strains.gene_distance(*major_and_ranges(read))


@query(f"WITH {SQL_STRAIN} SELECT * FROM gd")
def gene_distance(spark, read):
    return gene_pairs(read)


@query(f"WITH {SQL_STRAIN} SELECT taxid, sample_a, sample_b, genes, shared_length, differences, round(distance, 6) AS distance FROM ds")
def strain_distance_jc69(spark, read):
    return strains.strain_distance(gene_pairs(read)).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {SQL_STRAIN} SELECT taxid, sample_a AS samples, round(max(distance) FILTER (sample_b = 0), 6) AS "0", round(max(distance) FILTER (sample_b = 1), 6) AS "1", round(max(distance) FILTER (sample_b = 2), 6) AS "2", round(max(distance) FILTER (sample_b = 3), 6) AS "3" FROM ds GROUP BY taxid, sample_a""")
def sample_matrix(spark, read):
    m = strains.matrix(strains.strain_distance(gene_pairs(read)), [0, 1, 2, 3])
    return m.select("taxid", "samples", *[F.round(F.col(f"`{i}`"), 6).alias(str(i)) for i in range(4)])


@query(f"""WITH {SQL_STRAIN}, sg AS (SELECT *, 30 AS la, shared_length / (60 - shared_length) AS share FROM gd) SELECT taxid, sample_a, sample_b, count(*) AS genes, sum(shared_length) AS shared_length, round(sum(only_a + only_b) / sum(shared_length), 6) AS distance, round(sum(shared_length * share) / sum(shared_length), 6) AS share FROM sg GROUP BY ALL""")
def strain_distance_simple(spark, read):
    major, r = major_and_ranges(read)
    d = strains.distances(major, r, "simple")
    return d.withColumn("distance", F.round("distance", 6)).withColumn("share", F.round("share", 6))


@query(f"WITH {SQL_WITH_REF} SELECT sample, taxid, gene_id, position, base, n FROM (SELECT *, sum(n) OVER (PARTITION BY sample, taxid, gene_id, position) AS t FROM wr) WHERE n * 2 > t AND base <> 'R'")
def allele_majority(spark, read):
    return strains.frequent(with_reference(read), where=lambda n, of: 2 * n > of)


@query(f"WITH {SQL_SEEN} SELECT DISTINCT taxid FROM se WHERE quality > 10")
def set_union_strains(spark, read):
    return seen(read).filter("quality > 10").select("taxid").distinct()


@query(f"""WITH {SQL_SEEN}, a AS (SELECT DISTINCT gene_id, position FROM se WHERE sample = 0), b AS (SELECT DISTINCT gene_id, position FROM se WHERE sample = 1)
SELECT gene_id, count(*) FILTER (k = 2) AS in_both, count(*) FILTER (k = 1 AND m = 0) AS only_a, count(*) FILTER (k = 1 AND m = 1) AS only_b FROM (SELECT gene_id, position, count(*) AS k, min(s) AS m FROM (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL) GROUP BY gene_id""")
def set_operations(spark, read):
    s = seen(read)
    return sets.compared(s.filter("sample = 0"), s.filter("sample = 1"), ["gene_id", "position"], ["gene_id"])


# ---- scores, order, scalars ----


@query("""WITH c AS (SELECT source, count(*) FILTER (q AND t) AS tp, count(*) FILTER (NOT q AND t) AS fp, count(*) FILTER (q AND NOT t) AS fn, count(*) FILTER (NOT q AND NOT t) AS tn
FROM (SELECT source, quality = 1 AS q, n_chars > 1000 AS t FROM documents JOIN labels USING (doc_id)) GROUP BY source)
SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS sensitivity, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS specificity, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS "precision", (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c""")
def confusion_metrics(spark, read):
    rows = read("documents").join(read("labels"), "doc_id")
    return evaluate.confusion(rows, F.col("quality") == 1, F.col("n_chars") > 1000, ["source"])


@query("SELECT CAST(row_number() OVER (ORDER BY s, l_partkey, l_orderkey, l_linenumber) AS BIGINT) AS place, '>' || s || '_' || l_partkey AS header FROM (SELECT l_suppkey % 7 AS s, * FROM lineitem)")
def sort_records(spark, read):
    return sorted_records(read("lineitem"))


def sorted_records(lines: DataFrame) -> DataFrame:
    by = ["s", "l_partkey", "l_orderkey", "l_linenumber"]
    rows = lines.select((F.col("l_suppkey") % 7).alias("s"), *by[1:])
    return order.placed(rows, by).select("place", F.concat(F.lit(">"), "s", F.lit("_"), "l_partkey").alias("header"))


@query("""SELECT p_partkey, p_size % 4 AS major, p_size % 7 AS minor, (p_size % 4, p_size % 7, 0, 0) < (2, 3, 0, 0) AS older, split_part(p_name, ' ', 1) || '_' || p_size AS id FROM part""")
def version_order(spark, read):
    text_of = F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (F.col("p_size") % 7).cast("string"))
    rows = read("part").withColumn("v", version.version(text_of))
    return rows.select("p_partkey", "v.major", "v.minor", (F.col("v") < version.version(F.lit("2.3"))).alias("older"), text.header_id(F.concat(F.lit(">"), text.first_token("p_name", " "), F.lit("_"), "p_size", F.lit(" x"))).alias("id"))


@query("SELECT p_partkey, upper(p_name) AS up, split_part(p_name, ' ', 1) AS first_token, CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE rpad(p_brand, 12, '.') END AS padded, '/data/' || p_brand AS directory, 'x' || p_size || '.fq' AS base, 'x' || p_size AS stem, CAST(p_size // 3600 AS VARCHAR) || ':' || lpad(CAST(p_size // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_size % 60 AS VARCHAR), 2, '0') AS clock FROM part")
def string_functions(spark, read):
    path = F.concat(F.lit("/data/"), "p_brand", F.lit("/x"), "p_size", F.lit(".fq"))
    return read("part").select(
        "p_partkey", F.upper("p_name").alias("up"), text.first_token("p_name", " ").alias("first_token"), text.pad("p_brand", 12, ".").alias("padded"), text.directory(path).alias("directory"),
        text.basename(path).alias("base"), text.strip_extension(text.basename(path)).alias("stem"), text.format_seconds("p_size").alias("clock"),
    )


@query("""SELECT p_partkey, bit_count(CAST(p_partkey AS BIGINT)) AS bits, (p_partkey >> 3) & 1 = 1 AS fourth, lpad(right(format('{:b}', p_partkey), 12), 12, '0') AS low_bits,
(p_size << 20) | ((p_partkey % 32) << 12) | (p_partkey % 4096) AS packed, CAST(factorial(CAST(10 + p_size % 8 AS INT)) / (factorial(CAST(p_size % 5 AS INT)) * factorial(CAST(10 + p_size % 8 - p_size % 5 AS INT))) AS BIGINT) AS ways FROM part""")
def number_functions(spark, read):
    packed = dna.pack_value("p_size", F.col("p_partkey") % 32, F.col("p_partkey") % 4096, 8, 12)
    return read("part").select(
        "p_partkey", text.count_bits("p_partkey").alias("bits"), text.is_bit_set("p_partkey", 3).alias("fourth"), text.bit_string("p_partkey", 12).alias("low_bits"),
        packed.alias("packed"), text.choose(10 + F.col("p_size") % 8, F.col("p_size") % 5).alias("ways"),
    )


@query("""SELECT p_partkey, rtrim(p_name, 'e') AS trimmed, p_type LIKE '%STEEL' AS steel, concat_ws(':', p_brand, CAST(p_size AS VARCHAR)) AS brand_size,
printf('%.1f', CAST(p_size AS DOUBLE) / 4 + 0.01) AS quarter FROM part""")
def suffix_functions(spark, read):
    return read("part").select(
        "p_partkey", text.trim_end("p_name", "e").alias("trimmed"), text.has_suffix("p_type", "STEEL").alias("steel"), text.joined(":", "p_brand", "p_size").alias("brand_size"),
        text.format_precision(F.col("p_size") / 4 + 0.01, 1).alias("quarter"),
    )


@query("""SELECT p_partkey, k | 16384 AS with_bit, k & ~128 AS without_bit, 32 - CASE WHEN k = 0 THEN 0 ELSE length(bin(k)) END AS first_set,
(SELECT count(*) FILTER (((k >> i) & 1) <> ((k >> (i + 1)) & 1)) FROM range(0, 15) r(i)) AS changes,
CAST(((k & 255) << 24) | (((k >> 8) & 255) << 16) | (((k >> 16) & 255) << 8) AS BIGINT) AS swapped FROM (SELECT p_partkey, CAST(p_partkey AS BIGINT) AS k FROM part)""")
def bit_functions(spark, read):
    k = F.col("p_partkey").cast("long")
    return read("part").select(
        "p_partkey", text.with_bit(k, 1, True, 16).alias("with_bit"), text.with_bit(k, 8, False, 16).alias("without_bit"), text.first_set_bit(k, 32).alias("first_set"),
        text.information_content(k, 16).alias("changes"), F.shiftrightunsigned(text.swapped_bytes(k), 32).alias("swapped"),
    )


@query(f"SELECT item_id, n, CAST(translate(substr(d, 1, 12), 'ACGT', '0123') AS VARCHAR) AS digits, substr(d, 1, 12) AS bases, CAST(item_id + 2 AS BIGINT) << 32 | n % 7 AS node, CAST(item_id + 2 AS INT) AS taxid, CAST(n % 7 AS INT) AS gene_id FROM (SELECT item_id, {sql_dna('text')} AS d, length({sql_dna('text')}) AS n FROM benchmark)")
def packed_dna(spark, read):
    d = read("benchmark").select("item_id", dna.letters_to_dna("text").alias("d"))
    d = d.select("item_id", F.length("d").cast("long").alias("n"), F.substring("d", 1, 12).alias("d"))
    node = dna.pack_node(F.col("item_id") + 2, F.col("n") % 7)
    taxid, gene = dna.unpack_node(node)
    bases = dna.bytes_to_dna(dna.dna_to_bytes("d"), F.length("d"))
    return d.select("item_id", "n", dna.digits("d").alias("digits"), bases.alias("bases"), node.alias("node"), taxid.alias("taxid"), gene.alias("gene_id"))


@query(f"WITH {SQL_INDEX} SELECT key, taxid FROM ix")
def kmer_index_taxid(spark, read):
    rows = kmers.kmers(gene_table(read), "dna", SHAPE, RANKS)
    return taxonomy.lca_of_groups(rows, ["key"], RANKS).select("key", F.col("lca").alias("taxid"))


@query(f"WITH {SQL_HITS} SELECT doc_id, count(taxid) / count(*) AS hit_coverage FROM h GROUP BY doc_id")
def hit_coverage(spark, read):
    return classify.hit_coverage(doc_hits(read), "doc_id")
