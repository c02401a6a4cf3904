"""Cross-polytope search: recall and exact scores against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import neighbours
from cohortflow.llm.common import table


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(20, 64))
    y = neighbours.rotated(x, 3)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(x @ x.T, y @ y.T)
    assert np.array_equal(y, neighbours.rotated(x, 3)) and not np.allclose(y, neighbours.rotated(x, 4))


def exact(ids, x, i, k=20):
    s = (x * x[i]).sum(1)
    order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
    return [(int(ids[j]), s[j]) for j in order]


@pytest.mark.parametrize("name", ["sf0.001", "sf0.1"])
def test_recall(spark, name):
    sf = f"/root/testdata/{name}"
    rows = sorted(table(spark, sf, "embeddings").collect(), key=lambda r: r["vec_id"])
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in neighbours.op4(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        mine = sorted(got[ids[i]])
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        assert np.allclose([s for _, _, s in mine], [(x[np.searchsorted(ids, v)] * x[i]).sum() for _, v, _ in mine], atol=1e-12)
        want = exact(ids, x, i)
        hits, total = hits + len({v for v, _ in want} & {v for _, v, _ in mine}), total + len(want)
    assert hits / total >= 0.9


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.normal(size=8) * (1 + k % 3)], "x") for k in range(60)]
    rows += [(100 + k, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], "x") for k in range(300)]  # one vector that many rows share
    rows += [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [1.0, None] + [0.0] * 6, "x"), (903, [float("nan")] * 8, "x"),
             (904, [float("inf")] + [0.0] * 7, "x"), (905, [1.0] * 5, "x"), (None, [1.0] * 8, "x"), (0, rows[0][1], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = neighbours.search(frame, F.col("id") % 20 == 0, probes=32, tables=12, block=50).collect()
    good = [r for r in rows[:360]]
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good])
    for i in np.flatnonzero(ids % 20 == 0):
        mine = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == ids[i]]
        want = exact(ids, x, i)
        assert [v for v, _ in mine] == [v for v, _ in want] and np.allclose([s for _, s in mine], [s for _, s in want])
    assert {r["query_id"] for r in got} == {int(v) for v in ids if v % 20 == 0}
    assert neighbours.search(frame.limit(0), F.col("id") % 20 == 0).collect() == []


def recall(spark, ids, x):
    """Share of the exact nearest that a search with the default tables and probes finds, and the least rows of a query."""
    frame = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(frame, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    asked = np.flatnonzero(ids % 20 == 0)
    for i in asked:
        want = exact(ids, x, i)
        hits, total = hits + len({v for v, _ in want} & got.get(ids[i], set())), total + len(want)
    return hits / total, min(len(got.get(ids[i], ())) for i in asked)


@pytest.fixture(scope="module")
def unit(spark):
    rows = sorted(table(spark, "/root/testdata/sf0.1", "embeddings").collect(), key=lambda r: r["vec_id"])
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)


@pytest.mark.parametrize("norm", ["outlier 2", "outlier 100", "log-normal 0.5", "log-normal 1.0", "tiny"])
def test_recall_of_unequal_norms(spark, unit, norm):
    ids, x = unit
    x, (kind, _, size) = x.copy(), norm.partition(" ")
    if kind == "outlier":
        x[7] *= float(size)
    elif kind == "tiny":
        x[7] *= 1e-200
    else:
        x *= np.exp(np.random.default_rng(0).normal(size=(len(x), 1)) * float(size))
    found, least = recall(spark, ids, x)
    assert found >= 0.97 and least == 20


@pytest.mark.parametrize("n", [15, 20, 30, 50])
def test_few_rows_are_searched_exactly(spark, unit, n):
    ids, x = unit
    assert recall(spark, np.arange(n), x[:n]) == (1, min(n - 1, 20))


def test_queries_with_too_few_candidates(spark):
    """Index vectors that all stand in one cell, queries that look elsewhere."""
    rng = np.random.default_rng(1)
    x = np.eye(1, 64) + rng.normal(size=(400, 64)) * 1e-3
    ids = np.arange(400)
    x[::20] = -x[::20]
    assert recall(spark, ids, x) == (1, 20)
