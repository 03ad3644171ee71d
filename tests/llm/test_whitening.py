import numpy as np
import pytest

from helixmill.llm import whitening


def brute(vectors):
    """n, exact deviations, and eigenvalues and vectors of the fit list's covariance."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(fit), fit.sum(axis=0)
    dev = [int(((n * r - s) ** 2).sum()) for r in x]
    mean = np.array([int(v) // n + (int(v) % n) / n for v in s])
    centred = np.array([[int(a) - m for a, m in zip(r, mean, strict=True)] for r in fit], float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, dev, e[::-1], v[:, ::-1], np.array([[int(a) - m for a, m in zip(r, mean, strict=True)] for r in x], float)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n string, component string")


def check(got, vectors, ids, k):
    n, dev, e, v, centred = brute(vectors)
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert len(rows) == len(got) == k * len(ids)
    for j in range(k):
        want = centred @ v[:, j] / np.sqrt(e[j])
        mine = np.array([rows[i, j + 1]["whitened"] for i in ids])
        sign = np.sign(mine @ want)
        np.testing.assert_allclose(mine * sign, want, rtol=1e-7, atol=1e-8)
    for i, d in zip(ids, dev, strict=True):
        r = rows[i, 1]
        assert (r["n"], r["deviation"]) == (n, d)
        assert r["explained"] == pytest.approx(e[0] / e.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("parts", [1, 7, 70])
def test_equals_brute_force_whatever_the_partitions(spark, parts):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(400, 24)) * np.linspace(1, 4, 24)).astype(np.float32)
    v[50:120] = v[3]  # one hot vector
    df = frame(spark, [(i, r.tolist(), "a", "b") for i, r in enumerate(v)]).repartition(parts)
    check(whitening.whitened(df).collect(), v, list(range(400)), 16)
    fits = whitening.whole_numbers(df).select("x").distinct().repartition(parts)
    s = whitening.fitted(fits)
    x = np.array([r["x"] for r in fits.collect()], float)
    np.testing.assert_allclose(s.rows.T @ s.rows / s.n, np.cov(x.T, bias=True), rtol=1e-9, atol=1e-9)
    assert s.rows.shape == (24, 24) and s.n == len(x)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [r for r in df.collect() if r["embedding"] is not None]
    got = whitening.whitened(df).collect()
    check(got, [r["embedding"] for r in rows], [r["vec_id"] for r in rows], min(16, len(rows[0]["embedding"])))


def test_bad_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 1.0, -2.0], [1.5, 0.25, 3.0], [-7.0, 0.5, 0.0], [2.0, 2.0, 2.5], [2.0, 2.0, 2.5]]
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 0.0, 0.0], [0.0, -inf, 0.0], [1.0, 2.0]]
    df = frame(spark, [(i, v, "a", "b") for i, v in enumerate(good + bad)])
    check(whitening.whitened(df).collect(), good, list(range(len(good))), 3)


def test_components_without_variance_are_not_returned(spark):
    flat = [[1.0, 5.0, 2.0], [2.0, 5.0, 4.0], [3.0, 5.0, 6.0], [4.0, 5.0, 8.0]]
    assert {r["component"] for r in whitening.whitened(frame(spark, [(i, v, "", "") for i, v in enumerate(flat)])).collect()} == {1}
    for rows in ([], [(1, [1.0, 2.0], "", "")], [(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")], [(1, None, "", "")]):
        out = whitening.whitened(frame(spark, rows))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_far_from_zero(spark):
    rng = np.random.default_rng(1)
    v = (1e8 + rng.normal(size=(40, 3)) * 100).tolist()
    df = frame(spark, [(i, r, "", "") for i, r in enumerate(v)], "double")
    check(whitening.whitened(df).collect(), v, list(range(40)), 3)
    with pytest.raises(Exception, match="2 \\*\\* 46"):
        whitening.whitened(frame(spark, [(1, [1e20], "", ""), (2, [1.0], "", "")], "double")).collect()


def test_deviation_beyond_a_long_is_an_error():
    big = whitening.Model(3, np.array([0], object), np.ones((1, 1)), np.ones(1))
    assert big.deviations(np.array([[3]])).tolist() == [81]
    assert big.deviations(np.array([[10**9]])).tolist() == [9 * 10**18]
    with pytest.raises(OverflowError):
        big.deviations(np.array([[2 * 10**9]]))


def test_merging_loses_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 900, (90, 7))
    one = whitening.Summary.of(x)
    for cut in (1, 5, 60):
        two = whitening.Summary.of(x[:cut]).merged(whitening.Summary.of(x[cut:]))
        assert two.n == one.n and (two.sums == one.sums).all()
        np.testing.assert_allclose(two.rows.T @ two.rows, one.rows.T @ one.rows, rtol=1e-12, atol=1e-7)
