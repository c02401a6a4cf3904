"""Many boosted models at once: against a plain recursion, and split on Spark against grown in one task."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.models import boosting, trees
from cohortflow.session import checkpoint_root

NAMES = ["x0", "x1", "x2"]
SPEC = {"max_depth": (2, 5), "eta": (0.3,), "n_estimators": (2, 3), "min_child_weight": (1, 10),
        "colsample_bytree": (0.75, 1.0), "subsample": (0.75,)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 3)).round(1)
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0, x[:, 2], -1) + 0.1 * rng.normal(size=240)
    return spark.createDataFrame([(i, i, float(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))],
                                 ["stay_id", "time_seq", trees.TARGET, *NAMES])


def plain_tree(bins, g, used, who, depth, setting, columns):
    """Values of the rows in ``who``, split by trying every cut of every column."""
    own = [i for i in who if used[i]]
    total = sum(int(g[i]) for i in own)
    best = (boosting.LEAST_GAIN, None, None)
    if depth < setting.max_depth:
        for f in columns:
            for b in sorted({int(bins[f][i]) for i in own}):
                left = [int(g[i]) for i in own if bins[f][i] <= b]
                gl, nl, nr = sum(left), len(left), len(own) - len(left)
                if nl < setting.min_child_weight or nr < setting.min_child_weight:
                    continue
                gain = gl * gl / (nl + 1.0) + (total - gl) ** 2 / (nr + 1.0) - total * total / (len(own) + 1.0)
                if gain > best[0] * (1 + 1e-12):
                    best = (gain, f, b)
    if best[1] is None:
        return dict.fromkeys(who, total / (len(own) + 1.0) / boosting.SCALE)
    sides = [i for i in who if bins[best[1]][i] <= best[2]], [i for i in who if bins[best[1]][i] > best[2]]
    return {k: v for side in sides for k, v in plain_tree(bins, g, used, side, depth + 1, setting, columns).items()}


@pytest.mark.parametrize("depth, least", [(0, 1), (1, 1), (4, 3), (50, 1), (50, 10)])
def test_grown_tree_equals_plain_recursion(depth, least):
    rng = np.random.default_rng(depth + least)
    bins = rng.integers(0, 9, size=(4, 150))
    g = rng.integers(-5 * boosting.SCALE, 5 * boosting.SCALE, size=150)
    used = rng.random(150) < 0.7
    setting = boosting.Setting(depth, 0.1, least, 1.0, 0.75)
    columns = np.array([0, 2, 3])
    want = plain_tree(bins, g, used, range(150), 0, setting, columns)
    got = boosting.grow(bins, g, used, 0, setting, columns)
    assert got == pytest.approx([want[i] for i in range(150)], abs=1e-12)


def test_trees_grown_together_equal_trees_grown_alone():
    """Trees of several models take each step together, whatever their depth; their columns have few and many bins."""
    rng = np.random.default_rng(5)
    tree = rng.permutation(np.repeat(np.arange(4), 90))
    bins = np.vstack([rng.integers(0, k, 360) for k in (2, 60, 1, 5, 200)])
    g, used = rng.integers(-5 * boosting.SCALE, 5 * boosting.SCALE, size=360), (rng.random(360) < 0.8) & (tree != 3)
    deepest, columns = np.array([1, 3, 40, 7]), np.arange(5)
    together = boosting.grow_trees(boosting.Binned(bins, tree), g, used, 0, deepest, 2, columns)
    for k, depth in enumerate(deepest.tolist()):
        own = tree == k
        want = plain_tree(bins[:, own], g[own], used[own], range(90), 0, boosting.Setting(depth, 0.1, 2, 1.0, 1.0), columns)
        assert together[own] == pytest.approx([want[i] for i in range(90)], abs=1e-12)


@pytest.mark.parametrize("dense", [0, 1, math.inf])
@pytest.mark.parametrize("least", [1, 4])
def test_nodes_split_by_cells_or_by_rows_are_the_same(monkeypatch, dense, least):
    monkeypatch.setattr(boosting, "DENSE", min(dense, 1e9))
    rng = np.random.default_rng(least)
    bins = np.vstack([rng.integers(0, k, 300) for k in (2, 60, 1, 257, 6)])
    g, used = rng.integers(-5 * boosting.SCALE, 5 * boosting.SCALE, size=300), rng.random(300) < 0.8
    setting, columns = boosting.Setting(12, 0.1, least, 1.0, 1.0), np.arange(5)
    want = plain_tree(bins, g, used, range(300), 0, setting, columns)
    assert boosting.grow(bins, g, used, 0, setting, columns) == pytest.approx([want[i] for i in range(300)], abs=1e-12)


def test_only_rows_of_lesser_children_are_added_up(monkeypatch):
    """Each split takes a few rows off a node, level after level; the rows that stay are not added up again."""
    added, sums = [], boosting.Cells.sums
    monkeypatch.setattr(boosting.Cells, "sums", lambda self, n, total, node, places, g: (added.append(len(places)), sums(self, n, total, node, places, g))[1])
    monkeypatch.setattr(boosting, "DENSE", 0)
    bins = np.arange(400)[None] // 4
    g, used, setting = (1.3 ** bins[0] * 100).astype(np.int64), np.full(400, True), boosting.Setting(50, 0.1, 1, 1.0, 1.0)
    want = plain_tree(bins, g, used, range(400), 0, setting, [0])
    assert boosting.grow(bins, g, used, 0, setting, np.array([0])) == pytest.approx([want[i] for i in range(400)], rel=1e-12)
    assert len(added) > 15 and sum(added) < 400 * 3


def test_models_together_equal_models_alone_over_the_same_rows(rows):
    search = boosting.Search(3, SPEC, 2, 42, 10 ** 6)
    data = rows.toPandas()
    pdf = data.assign(r=data["stay_id"] * 7919 % boosting.PRIME, fold=data["stay_id"] % 2, y=np.rint(data[trees.TARGET] * boosting.SCALE).astype(int),
                      **{f"f{j}": np.searchsorted(np.unique(data[n]), data[n]) for j, n in enumerate(NAMES)})
    batch = search.batches(10)
    of = [[m for m, k in enumerate(batch) if k == one] for one in range(max(batch) + 1)]
    assert all(len(models) == 2 for models in of)
    parts = (pdf.assign(batch=k)[half::2] for k in range(len(of)) for half in (0, 1))  # each row once per batch
    found = {(r.model, r.n_estimators): (r.n, r.sse) for part in search._batches(parts, of) for r in part.itertuples()}
    assert len(found) == 32 and list(search._batches(iter([]), of)) == []
    for model in range(len(batch)):
        for r in search._whole(pdf, [model]).itertuples():
            assert found[model, r.n_estimators] == (r.n, pytest.approx(r.sse, rel=1e-12))


def test_models_of_a_task_share_samples_and_are_bounded():
    search = boosting.Search(8, boosting.GRID, 5, 42, 200_000)
    of = search.batches(200_000 // 4_424)
    assert len(of) == 720 and max(of) + 1 == 60 and sorted(set(of)) == list(range(60))
    assert max(search.batches(1)) + 1 == 720
    shared = {(of[m], m % 5, s.subsample, s.colsample_bytree, s.min_child_weight) for m in range(720) for s in [search.settings[m // 5]]}
    assert len(shared) == 60


def test_no_row_to_learn_from():
    got = boosting.grow(np.zeros((2, 5), int), np.ones(5, int), np.zeros(5, bool), 0, boosting.Setting(3, 0.1, 1, 1.0, 1.0), np.array([0, 1]))
    assert (got == 0).all()


def test_split_on_spark_equals_grown_in_a_task(spark, rows):
    def run(limit):
        spark.conf.set(boosting.TREE_ROWS, str(limit))
        try:
            return {tuple(r)[:-1]: r["rmse"] for r in boosting.tune(rows, NAMES, SPEC, folds=2).collect()}
        finally:
            spark.conf.unset(boosting.TREE_ROWS)

    whole, split = run(10 ** 6), run(90)
    assert len(whole) == 32 and whole.keys() == split.keys()
    assert all(split[k] == pytest.approx(v, rel=1e-12) for k, v in whole.items())


def test_error_is_that_of_a_plain_fit(rows):
    """One fold held out, three trees of depth 2 on all rows and columns, each by the plain recursion."""
    spec = {k: (v[0],) for k, v in SPEC.items()} | {"n_estimators": (3,), "subsample": (1.0,), "colsample_bytree": (1.0,)}
    found = boosting.tune(rows, NAMES, spec, folds=3, fold=F.col("stay_id") % 3)
    got = {r["fold"]: (r["n"], r["rmse"]) for r in found.collect()}
    data = rows.orderBy("stay_id").toPandas()
    bins = [np.searchsorted(sorted(set(data[n])), data[n]) for n in NAMES]  # fewer values than bins
    setting = boosting.settings(spec)[0]
    y = np.rint(data[trees.TARGET].to_numpy() * boosting.SCALE).astype(int)
    for k in range(3):
        held, pred = (data["stay_id"] % 3 == k).to_numpy(), np.full(len(y), boosting.BASE)
        for _ in range(3):
            step = plain_tree(bins, y - np.rint(pred * boosting.SCALE).astype(int), ~held, range(len(y)), 0, setting, range(3))
            pred += setting.eta * np.array([step[i] for i in range(len(y))])
        assert got[k] == (held.sum(), pytest.approx(math.sqrt(np.mean((y / boosting.SCALE - pred)[held] ** 2)), rel=1e-12))


def test_odd_rows(spark, rows):
    """Null targets and features take no part, a constant feature never splits, repeated rows count, an empty table has no error."""
    odd = rows.unionByName(rows.limit(5)).unionByName(rows.limit(3).withColumn("x1", F.lit(None).cast("double")))
    odd = odd.unionByName(rows.limit(2).withColumn(trees.TARGET, F.lit(None).cast("double")))
    spec = {k: (v[0],) for k, v in SPEC.items()}
    found = boosting.tune(odd.withColumn("c", F.lit(7.0)), [*NAMES, "c"], spec, folds=2).collect()
    assert sum(r["n"] for r in found) == 245 and all(r["rmse"] > 0 for r in found)
    none = boosting.tune(rows.limit(0), NAMES, spec, folds=2).collect()
    assert len(none) == 2 and all(r["n"] == 0 and r["rmse"] is None for r in none)


def test_split_search_keeps_one_state(spark, rows):
    """What a round stored is deleted when the next one is stored."""
    root = checkpoint_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    spark.conf.set(boosting.TREE_ROWS, "90")
    try:
        boosting.tune(rows, NAMES, {k: (v[0],) for k, v in SPEC.items()}, folds=2).collect()
    finally:
        spark.conf.unset(boosting.TREE_ROWS)
    assert len(set(os.listdir(root)) - before) == 1  # the binned rows


def test_grid_and_table(rows):
    assert len(boosting.settings(boosting.GRID)) * len(boosting.GRID["n_estimators"]) == 576 and max(boosting.GRID["max_depth"]) == 50
    table = boosting.tuning_table(boosting.tune(rows, NAMES, SPEC, folds=2)).collect()
    assert len(table) == 16 and all(r["rmse"] > 0 for r in table)
