"""Mixed model against dense algebra, least squares and balanced designs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.models import mixed, tails
from cohortflow.models.mixed import Design, Statistics, Term

TERMS = (Term("f", ("a", "b", "c")), Term("h", (0, 1)))


def frame(n=90, groups=17, seed=3, spread=1.0):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, groups, n)
    f, h = rng.integers(0, 3, n), rng.integers(0, 2, n)
    y = 5 + f * 0.7 - h + spread * rng.normal(size=groups)[g] + rng.normal(size=n)
    return [(int(a), "abc"[b], int(c), float(v)) for a, b, c, v in zip(g, f, h, y)]


def dense(data, lam, reml):
    g = np.array([r[0] for r in data])
    x = np.array([[1.0, r[1] == "b", r[1] == "c", r[2] == 1] for r in data], dtype=float)
    y = np.array([r[3] for r in data])
    v = np.eye(len(y)) + lam * (g[:, None] == g[None, :])
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    e = y - x @ beta
    rss = e @ vi @ e
    f = len(y) - (x.shape[1] if reml else 0)
    ll = -0.5 * (f * math.log(2 * math.pi * rss / f) + f + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(a)[1] if reml else 0))
    return ll, beta, rss / f * np.linalg.inv(a), (x, y, g)


@pytest.fixture(scope="module")
def data(spark):
    rows = frame()
    return rows, spark.createDataFrame(rows, "g int, f string, h int, y double")


@pytest.mark.parametrize("reml", [True, False])
def test_fit_matches_dense(data, reml):
    rows, df = data
    f, = mixed.fit(df, "y", TERMS, "g", reml)
    ll, beta, cov, (x, y, g) = dense(rows, f.lam, reml)
    assert f.loglik == pytest.approx(ll, abs=1e-8)
    assert np.allclose(f.beta, beta, atol=1e-8) and np.allclose(f.cov, cov, atol=1e-8)
    assert f.lam > 0
    assert all(dense(rows, f.lam * k, reml)[0] < ll for k in (0.99, 1.01))
    assert (f.nobs, f.ngroups, f.names) == (90, 17, ["(Intercept)", "fb", "fc", "h1"])


def test_moments_equal_plain_products(data, spark):
    rows, df = data
    design = Design("y", "g", TERMS)
    cell = mixed.cells(df.withColumn("subgroup", F.lit("s")), design)
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        s = np.sum([[1.0, r[1] == "b", r[1] == "c", r[2] == 1, r[3]] for r in own], axis=0)
        want[len(own)] = want.get(len(own), 0) + np.outer(s, s)
    got = mixed.group_moments(cell, design).collect()
    assert {(r["n"], r["a"], r["b"]): r["v"] for r in got} == pytest.approx(
        {(n, a, b): m[a, b] for n, m in want.items() for a in range(5) for b in range(a, 5) if m[a, b]})
    one = mixed.packed_moments(cell, design).collect()
    assert sorted(r["n"] for r in one) == sorted(want) and {len(r["v"]) for r in one} == {15}


def test_added_vectors_do_not_depend_on_partitions(spark):
    df = spark.range(5000).selectExpr("CAST(id % 7 AS STRING) AS k", "array(CAST(id AS DOUBLE), 1D) AS v")
    want = {str(k): [float(sum(range(k, 5000, 7))), float(len(range(k, 5000, 7)))] for k in range(7)}
    for parts in (1, 13):
        got = mixed.added(df.repartition(parts), ["k"]).collect()
        assert {r["k"]: r["v"] for r in got} == want and len(got) == 7
    assert mixed.added(df.where("k = 'x'"), ["k"]).collect() == []


def test_unsettled_search_keeps_the_other_fits(data, spark, monkeypatch):
    monkeypatch.setattr(mixed, "ROUNDS", 1)
    f, = mixed.fit(data[1], "y", TERMS, "g")
    assert not f.converged
    assert mixed.fit_stats(spark, {"m": f}).collect()[0]["converged"] is False


def test_small_statistics_are_summed_on_spark(data, monkeypatch):
    rounds, spark_sums = [], mixed.Statistics._spark
    monkeypatch.setattr(mixed.Statistics, "_spark", lambda self, points: rounds.append(points) or spark_sums(self, points))
    f, = mixed.fit(data[1], "y", TERMS, "g")
    assert rounds and f.ngroups == 17


def test_groups_of_one_give_least_squares(spark):
    rows = [(k, *r[1:]) for k, r in enumerate(frame(spread=0.0))]
    f, = mixed.fit(spark.createDataFrame(rows, "g int, f string, h int, y double"), "y", TERMS, "g", reml=False)
    _, beta, _, _ = dense(rows, 0.0, False)
    assert np.allclose(f.beta, beta, atol=1e-8)


def test_zero_variance_ratio(spark):
    # groups whose means are equal: no variance between them
    rows = [(k // 2, "a", 0, 1.0 if k % 2 else -1.0) for k in range(40)]
    f, = mixed.fit(spark.createDataFrame(rows, "g int, f string, h int, y double"), "y", (), "g")
    assert f.lam == 0 and f.beta[0] == pytest.approx(0)


def test_balanced_intercept_degrees_of_freedom(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(3 + e + u)) for g, u in enumerate(2 * rng.normal(size=12)) for e in rng.normal(size=5)]
    f, = mixed.fit(spark.createDataFrame(rows, "g int, y double"), "y", (), "g")
    y = np.array([r[1] for r in rows]).reshape(12, 5)
    assert f.dof[0] == pytest.approx(11, rel=1e-6)
    assert f.cov[0, 0] == pytest.approx(y.mean(axis=1).var(ddof=1) / 12, rel=1e-6)


def test_one_level_term_is_dropped(data):
    _, df = data
    f, = mixed.fit(df.where(F.col("h") == 0), "y", TERMS, "g")
    assert f.dropped == ["h1"] and "h1" not in f.names


def test_rows_with_unknown_terms_are_left_out(data):
    _, df = data
    f, = mixed.fit(df.withColumn("f", F.when(F.col("f") != "c", F.col("f"))), "y", TERMS, "g")
    assert f.nobs == df.where("f <> 'c'").count() and f.dropped == ["fc"]


def test_balanced_marginal_means_are_cell_means(spark):
    rows = [(g, fa, h, float(g * 0.3 + i + 2 * h + (g * i + h) % 3)) for g in range(6) for i, fa in enumerate("abc") for h in (0, 1)]
    df = spark.createDataFrame(rows, "g int, f string, h int, y double")
    got = {r["f"]: r["emmean"] for r in mixed.marginal_means(spark, mixed.fit(df, "y", TERMS, "g"), "f").collect()}
    want = {r["f"]: r["m"] for r in df.groupBy("f").agg(F.avg("y").alias("m")).collect()}
    assert got == pytest.approx(want)


def test_residuals_agree_with_statistics(data):
    rows, df = data
    design = Design("y", "g", TERMS)
    stats = Statistics(mixed.cells(df.withColumn("subgroup", F.lit("s")), design), design)
    f, = mixed.fit_statistics(stats)
    res = np.array([r["residual"] for r in mixed.residuals(stats, f, df).collect()])
    assert math.sqrt((res ** 2).mean()) == pytest.approx(f.rmse, rel=1e-9)
    _, beta, _, (x, y, g) = dense(rows, f.lam, True)
    e = y - x @ beta
    n = np.bincount(g)
    u = f.lam / (1 + n * f.lam) * np.bincount(g, weights=e)
    assert sorted(res) == pytest.approx(sorted(e - u[g]))


def test_subgroups_equal_separate_fits(data):
    _, df = data
    both = df.withColumn("subgroup", F.explode(F.array(F.lit("all"), F.concat(F.lit("h"), F.col("h").cast("string")))))
    fits = {f.subgroup: f for f in mixed.fit(both, "y", TERMS, "g")}
    assert set(fits) == {"all", "h0", "h1"}
    alone, = mixed.fit(df.where("h = 1"), "y", TERMS, "g")
    assert np.allclose(fits["h1"].beta, alone.beta, atol=1e-8) and fits["h1"].loglik == pytest.approx(alone.loglik, abs=1e-8)


def test_nested_models_share_cells(data, spark):
    _, df = data
    big = Design("y", "g", TERMS)
    cell = mixed.cells(df.withColumn("subgroup", F.lit("s")), big)
    small = Statistics(cell, Design("y", "g", TERMS[:1]))
    fits = [("small", mixed.fit_statistics(small, False)[0]), ("big", mixed.fit_statistics(Statistics(cell, big), False)[0])]
    direct, = mixed.fit(df, "y", TERMS[:1], "g", False)
    assert fits[0][1].loglik == pytest.approx(direct.loglik, abs=1e-9)
    r = mixed.compare(spark, fits).collect()[1]
    assert r["df"] == 1 and r["chisq"] == pytest.approx(2 * (fits[1][1].loglik - fits[0][1].loglik)) and 0 <= r["p_value"] <= 1


def test_tails():
    assert tails.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert tails.chi2_upper(30.0, 10) == pytest.approx(0.000856641210775301, rel=1e-8)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert tails.t_quantile(0.975, 1) == pytest.approx(12.706204736432095, rel=1e-9)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-12)
