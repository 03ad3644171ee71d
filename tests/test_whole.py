"""Total orders by ranges, and queries that take their whole tables."""

from helixmill.operators import order
from helixmill.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
catalog.load()


def test_one_group_is_cut_into_ranges(spark):
    rows = spark.range(5000).select(F.lit(1).alias("s"), F.pmod(F.xxhash64("id"), F.lit(700)).alias("v"), "id")
    got = order.placed(rows, ["s", "v", "id"]).select("place", "part", "v", "id").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 5001))
    assert [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)
    assert len({r.part for r in got}) >= 8
    assert order.placed(rows.limit(0), ["s", "v", "id"]).count() == 0


def test_no_query_filters_rows_to_be_cheap(spark):
    assert catalog.QUERIES["sort_records"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for name, cut in [("sort_records", "l_quantity >"), ("taxonomy_lca_pairs", "% 3 = 0"), ("gene_distance", "% 3 <> 0"), ("sample_matrix", "% 3 <> 0")]:
        assert cut not in catalog.ORACLES[name]
