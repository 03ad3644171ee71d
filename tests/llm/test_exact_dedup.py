import hashlib

from helixmill.llm import exact_dedup


def brute(rows):
    """(key, keep, size, kept, digest) by the definition; repeated keys: one row is kept."""
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    low = lambda k: (k is not None, k)
    out, told = [], set()
    for k, t in rows:
        same = groups[t or ""]
        keep = max(same, key=low)
        kept = k == keep and (t or "") not in told
        if kept:
            told.add(t or "")
        out.append((k, keep, len(same), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [(1, None), (2, ""), (3, "a"), (4, "a"), (None, "a"), (5, "b"), (5, "b"), (6, "long " * 100_000), (7, "long " * 100_000), (None, "only"), (8, "A"), (9, "a "), (-3, "é"), (10, "é")]


def test_odd_rows_in_any_number_of_batches(spark):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in ODD], "doc_id long, text string, digest string, `keep` int").repartition(3)
    for n in (1, 3, 4):
        assert rows(exact_dedup.groups(docs, batches=n)) == brute(ODD)


def test_string_keys_and_empty_table(spark):
    docs = spark.createDataFrame([("b", "t"), ("c", "t"), ("a", None)], "k string, t string")
    assert rows(exact_dedup.groups(docs, "k", "t", batches=3)) == brute([("b", "t"), ("c", "t"), ("a", None)])
    assert exact_dedup.groups(docs.limit(0), "k", "t").collect() == []


def test_a_hot_text_is_whole(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 7000) END AS text")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows(exact_dedup.groups(docs, batches=4)) == want


def test_index_goes_on_over_batches(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, "bigint", 5)
    docs = lambda pairs: spark.createDataFrame(pairs, "doc_id long, text string")
    first, second = docs([(1, "a"), (2, "a"), (3, "b"), (3, "b")]), docs([(9, "a"), (8, "c"), (4, None), (5, "")])
    assert rows(exact_dedup.deduplicated(first, index, "monday")) == [(2, "a"), (3, "b")]
    # another session finds the index by its folder
    for t in (index.keepers, index.sightings):
        spark.sql(f"DROP TABLE {t}")
    index = exact_dedup.DigestIndex(spark, path)
    assert index.buckets == 5
    assert rows(exact_dedup.deduplicated(second, index, "tuesday")) == [(5, ""), (8, "c")]
    assert rows(exact_dedup.deduplicated(second, index, "tuesday")) == [(5, ""), (8, "c")]  # again: no change
    assert {(r["keep"], r["batch"]) for r in index.known().collect()} == {(2, "monday"), (3, "monday"), (5, "tuesday"), (8, "tuesday")}
    assert sorted(r["group_size"] for r in index.sizes().collect()) == [1, 2, 2, 3]


def test_a_batch_that_failed_half_way_is_completed(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
    batch = exact_dedup.rows_of(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string"), "doc_id", "text")
    index.add(batch.filter("key < 3"), "x")
    spark.createDataFrame([], "digest binary, n long, batch string").write.insertInto(index.sightings, overwrite=True)  # the index was written, the sightings were not
    index.add(batch, "x")
    assert {r["keep"] for r in index.known().collect()} == {2, 3} and sum(r["group_size"] for r in index.sizes().collect()) == 3


def test_index_side_has_no_exchange_and_no_python(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    rows = exact_dedup.rows_of(spark.range(100).selectExpr("id AS doc_id", "string(id) AS text"), "doc_id", "text")
    index.add(rows, "x")
    plan = rows.hint("merge").join(index.known(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    answers = index.answers(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in answers and "Arrow" not in answers


def test_query_equals_its_sql(spark):
    import duckdb

    from helixmill.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.QUERIES["op12_exact_dedup"](spark, sf)
    want = con.execute(queries.ORACLES["op12_exact_dedup"])
    assert rows(got.select(*[c[0] for c in want.description])) == sorted(want.fetchall(), key=str)
