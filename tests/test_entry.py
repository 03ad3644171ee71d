from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from helixmill.plans import catalog

catalog.load()
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    got = con.execute(catalog.ORACLES[name])
    order = [d[0] for d in got.description]
    plain = lambda rows: sorted((tuple(round(float(v), 9) if isinstance(v, (float, Decimal)) else v for v in r) for r in rows), key=str)
    assert sorted(order) == sorted(df.columns)
    assert plain(tuple(r) for r in df.select(*[f"`{c}`" for c in order]).collect()) == plain(got.fetchall())
