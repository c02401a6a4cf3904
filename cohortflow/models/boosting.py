"""Boosted trees for all points of a grid and all folds at once.

Squared loss, second-order splits with an L2 term of 1, rows sampled per tree, columns sampled per tree. A model is one
point without its number of trees, in one fold: errors at every number of trees are read off one fit. Features are binned
once. Gradients are whole numbers of `SCALE` parts, so their sums are exact and the trees don't depend on how rows are dealt.

Rows meet at (model, node). A node of more than ``spark.cohortflow.treeRows`` rows is split by one grouped sum of gradients
over (model, node, feature, bin), level by level for all models together; a node with fewer rows goes to one task, which
grows the rest of its tree. A table with fewer rows goes to a task for several models, once, and these share its bins. The
limit only decides where a split is found, never which one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, uncut
from .trees import GRID as SPARK_GRID
from .trees import TARGET

TREE_ROWS = "spark.cohortflow.treeRows"
DEFAULT_TREE_ROWS = 200_000

# The depths of the grid, which Spark's own trees can't all reach, and what a fit starts from.
GRID = {**SPARK_GRID, "max_depth": (5, 10, 25, 50)}
BASE = 0.5

SCALE = 1 << 20
BINS = 256
FEW = 8  # bins of a column whose cells are counted at every node, not sorted
DENSE = 0.5  # rows of a node for each bin of its mean column, from which on the node is split by its cells
AT_ONCE = 1 << 15  # cells that are looked at together
PRIME = (1 << 31) - 1
LEAST_GAIN = 1e-6 * SCALE * SCALE
POINT = ("max_depth", "eta", "min_child_weight", "subsample", "colsample_bytree")


@dataclass(frozen=True)
class Setting:
    """A point of the grid without its number of trees."""

    max_depth: int
    eta: float
    min_child_weight: int
    subsample: float
    colsample_bytree: float


@dataclass(frozen=True)
class Chance:
    """What chance decides in one round, the same for all models: who is sampled, and the order in which columns are taken."""

    factor: int
    shift: int
    order: tuple[int, ...]

    def columns(self, share: float) -> np.ndarray:
        return np.sort(np.array(self.order[:max(1, int(share * len(self.order)))]))


def settings(spec: Mapping[str, Sequence[float]]) -> list[Setting]:
    found = itertools.product(*[spec[name] for name in POINT])
    return [Setting(int(d), float(e), max(1, int(w)), float(s), float(c)) for d, e, w, s, c in found]


def chances(seed: int, rounds: int, features: int) -> list[Chance]:
    rng = np.random.default_rng(seed)
    return [Chance(int(rng.integers(1, PRIME)), int(rng.integers(0, PRIME)), tuple(map(int, rng.permutation(features))))
            for _ in range(rounds)]


def binned(df: DataFrame, names: Sequence[str], fold: Column, keys: Sequence[str], label: str = TARGET) -> DataFrame:
    """Stored rows ``r`` (a number for sampling), ``fold``, ``y`` and one bin column per feature: the number of the feature's
    quantiles that are not above the value; a value that is no number goes to the last bin. Rows with a null label or
    feature take no part."""
    df = df.dropna(subset=[label, *names])
    values = [F.col(f"`{n}`").cast("double") + F.lit(0.0) for n in names]  # no negative zero, which Java puts below zero
    steps = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    edges = df.agg(*[F.percentile_approx(v, steps, 10_000).alias(f"q{j}") for j, v in enumerate(values)]).first()
    numbers = df.select(F.pmod(F.xxhash64(*keys), F.lit(PRIME)).alias("r"), fold.cast("int").alias("fold"),
                        F.rint(F.col(f"`{label}`") * SCALE).cast("long").alias("y"),
                        *[v.alias(f"v{j}") for j, v in enumerate(values)])
    splits = [[-np.inf, *sorted(set(e for e in (edges[f"q{j}"] or [0.0]) if np.isfinite(e))), np.inf] for j in range(len(names))]
    places = Bucketizer(splitsArray=[s if len(s) > 2 else [-np.inf, 0.0, np.inf] for s in splits], handleInvalid="keep",
                        inputCols=[f"v{j}" for j in range(len(names))], outputCols=[f"b{j}" for j in range(len(names))])
    return cut(places.transform(numbers).select("r", "fold", "y", *[F.col(f"b{j}").cast("int").alias(f"f{j}")
                                                                    for j in range(len(names))]))


class Binned:
    """Bins of the rows of some trees. ``tree`` numbers a row's tree from 0; row ``k`` of tree ``t`` has its bins in column
    ``k - shift[t]``, so trees over the same rows share them."""

    def __init__(self, bins: np.ndarray, tree: np.ndarray, shift: np.ndarray | None = None):
        self.bins, self.tree, self.trees = np.ascontiguousarray(bins, np.uint16), tree, int(tree.max(initial=0)) + 1
        self.shift = np.zeros(self.trees, np.intp) if shift is None else shift
        self.size = self.bins.max(axis=1, initial=0).astype(int) + 1
        self.rows = np.argsort(tree, kind="stable")


@dataclass
class Nodes:
    """Nodes of a forest: used rows of each with their sum, all its rows, the shift of its tree, and the levels that it may still grow."""

    n: np.ndarray
    total: np.ndarray
    size: np.ndarray
    shift: np.ndarray
    left: np.ndarray

    def __getitem__(self, which: np.ndarray) -> Nodes:
        return Nodes(self.n[which], self.total[which], self.size[which], self.shift[which], self.left[which])

    @staticmethod
    def joined(parts: Sequence[Nodes]) -> Nodes:
        return Nodes(*[np.concatenate([getattr(part, f.name) for part in parts]) for f in fields(Nodes)])


class Cells:
    """Bins of some columns side by side, the cells of a node. The first cell of a column also takes back all rows of the column
    before, so a running sum over all cells is one over each column."""

    def __init__(self, bins: np.ndarray, size: np.ndarray, columns: np.ndarray):
        self.columns, self.ends = columns, np.cumsum(size[columns])
        self.starts = self.ends - size[columns]
        self.count = int(size[columns].sum())
        self.bins = np.ascontiguousarray((bins[columns] + self.starts[:, None].astype(np.int32)).T)

    def sums(self, n: np.ndarray, total: np.ndarray, node: np.ndarray, places: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sums of gradients of every (node, cell)."""
        cell = self.bins.take(places, axis=0) + (node * self.count)[:, None]
        cell, found = cell.ravel(), []
        for weight, whole in ((None, n), (np.repeat(g, len(self.columns)), total)):
            of = np.bincount(cell, weight, len(n) * self.count).reshape(-1, self.count).astype(np.int64, copy=False)
            of[:, self.starts[1:]] -= whole.astype(np.int64)[:, None]
            found.append(of)
        return found[0], found[1]

    def best(self, counts: np.ndarray, sums: np.ndarray, n: np.ndarray, total: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
        """Gain of every node's best cut, its column, its bin, and the rows and the sum that it puts to the left; of equal gains the
        first column and then the first bin, which holds rows."""
        step = max(1, AT_ONCE // self.count)
        n, total, one = n.astype(float)[:, None], total[:, None], np.arange(len(n))
        own, gain = total * total / (n + 1.0), np.empty(len(n))
        at, nl, gl = np.empty(len(n), np.int64), np.empty(len(n), np.int64), np.empty(len(n))
        work = np.empty((4, min(step, len(n)), self.count))
        for k in range(0, len(n), step):
            some = slice(k, k + step)
            left, below = counts[some].cumsum(axis=1), sums[some].cumsum(axis=1)
            a, b, c, d = work[:, :len(left)]  # the gain of `_gain`, in place
            b[...], c[...] = left, below
            np.multiply(c, c, out=a)
            np.add(b, 1.0, out=b)
            np.divide(a, b, out=a)
            np.subtract(n[some] + 2.0, b, out=d)
            np.subtract(total[some], c, out=c)
            np.multiply(c, c, out=c)
            np.divide(c, d, out=c)
            np.add(a, c, out=a)
            np.subtract(a, own[some], out=a)
            if least > 1:  # a side without rows gains nothing
                np.multiply(a, np.minimum(b, d, out=d) > least, out=a)
            at[some] = best = a.argmax(1)
            cell = one[:len(left)], best
            gain[some], nl[some], gl[some] = a[cell], left[cell], below[cell]
        column = np.searchsorted(self.ends, at, side="right")
        return gain, self.columns[column], at - self.starts[column], nl, gl


def _gain(gl: np.ndarray, nl: np.ndarray, whole: np.ndarray, size: np.ndarray) -> np.ndarray:
    gain, right = gl * gl, whole - gl
    gain /= nl + 1.0
    right *= right
    right /= size - nl + 1.0
    gain += right
    gain -= whole * whole / (size + 1.0)
    return gain


class Level:
    """The nodes of one depth: rows and sums of each, and the best split that the columns seen so far have."""

    def __init__(self, n: np.ndarray, total: np.ndarray, least: int):
        self.n, self.total, self.least = n, total, least
        self.node = np.repeat(np.arange(len(n)), n)
        self.top = np.full(len(n), LEAST_GAIN)
        self.feature, self.edge = np.full(len(n), -1), np.zeros(len(n), np.int64)
        self.left, self.below = np.zeros(len(n), np.int64), np.zeros(len(n))

    def take(self, feature: np.ndarray, nodes: np.ndarray, gain: np.ndarray, edge: np.ndarray, left: np.ndarray, below: np.ndarray) -> None:
        """Best splits of nodes, each named once; of columns that gain the same the first one splits."""
        more = (gain > self.top[nodes]) | ((gain == self.top[nodes]) & (feature < self.feature[nodes]))
        nodes = nodes[more]
        self.top[nodes], self.feature[nodes], self.edge[nodes] = gain[more], feature[more], edge[more]
        self.left[nodes], self.below[nodes] = left[more], below[more]

    def only(self, kept: np.ndarray) -> Level:
        """The nodes that are kept, with their splits."""
        out = Level(self.n[kept], self.total[kept], self.least)
        for name in ("top", "feature", "edge", "left", "below"):
            setattr(out, name, getattr(self, name)[kept])
        return out

    def sorted(self, features: np.ndarray, bins: np.ndarray, g: np.ndarray) -> None:
        """Columns whose rows lie by node and bin, from running sums at the places where a bin ends and both sides keep enough rows."""
        nodes, rows = len(self.n), len(self.node)
        start = np.cumsum(self.n) - self.n
        nl = np.arange(1, rows + 1) - start.take(self.node)
        ends = np.zeros(bins.shape, bool)
        np.not_equal(bins[:, 1:], bins[:, :-1], out=ends[:, :-1])
        ends &= (nl >= self.least) & (self.n.take(self.node) - nl >= self.least)
        flat = np.flatnonzero(ends)
        if not len(flat):
            return
        column = np.repeat(np.arange(len(features)), np.count_nonzero(ends, axis=1))
        place = flat - column * rows
        at = self.node.take(place)
        # sums of whole numbers are exact, so they may run on over nodes and columns
        gl = np.cumsum(g).take(flat) - (int(self.total.sum()) * column + (np.cumsum(self.total) - self.total).astype(np.int64).take(at))
        gl, nl = gl.astype(float), nl.take(place)
        gain = _gain(gl, nl.astype(float), self.total.take(at), self.n.take(at).astype(float))
        cell = column * nodes + at  # ascending
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        best = np.maximum.reduceat(gain, first)
        hit = np.flatnonzero(gain == np.repeat(best, np.diff(first, append=len(gain))))
        hit = hit[np.concatenate(([True], cell[hit[1:]] != cell[hit[:-1]]))]  # of equal gains the first place
        bounds = np.searchsorted(column[hit], np.arange(len(features) + 1))
        edge = bins.ravel().take(flat.take(hit))
        for feature, begin, end in zip(features, bounds, bounds[1:]):
            some = slice(begin, end)
            self.take(np.full(end - begin, feature), at[hit[some]], gain[hit[some]], edge[some], nl[hit[some]], gl[hit[some]])


def grow_trees(table: Binned, g: np.ndarray, used: np.ndarray, depth: int, deepest: np.ndarray, least: int, columns: np.ndarray) -> np.ndarray:
    """Value of the leaf that each row reaches, from nodes at ``depth`` on; ``used`` rows make the splits, all follow them.
    All trees, each as deep as its number in ``deepest``, take a step at a time.

    A node that has many rows for its cells is split by the sums of its cells, the rest of a tree below one with fewer rows by
    its rows in order.
    """
    columns = columns[table.size[columns] > 1]  # one bin can't be cut
    g, tree = g.astype(float), table.tree
    nodes = Nodes(np.bincount(tree[used], minlength=table.trees), np.bincount(tree[used], g[used], table.trees),
                  np.bincount(tree, minlength=table.trees), table.shift, deepest - depth)
    at, nodes = _grow_large(table, columns, nodes, g, used, least) if len(columns) else (tree, nodes)
    out = (nodes.total / (nodes.n + 1.0) / SCALE).take(at)
    opens = (nodes.n >= 2 * least) & (nodes.left > 0) & (len(columns) > 0)
    rows = np.flatnonzero(opens.take(at))
    if len(rows):
        node, bits = (np.cumsum(opens) - 1).take(at.take(rows)), len(at).bit_length()
        rows = np.sort((node << bits) + rows) & (1 << bits) - 1
        out[rows] = _grow_small(table, nodes[opens], rows, g, used, least, columns)
    return out


def _grow_large(table: Binned, columns: np.ndarray, nodes: Nodes, g: np.ndarray, used: np.ndarray, least: int) -> tuple[np.ndarray, Nodes]:
    """Splits nodes by the sums of their cells as long as they have many rows. Returns the node of every row, and the nodes.

    A split makes a new node of the child with fewer used rows, whose sums are added up from its rows. The other child stays in the
    place of its parent, and its sums are what the parent has more.
    """
    cells, flat, count = Cells(table.bins, table.size, columns), table.bins.ravel(), table.bins.shape[1]
    enough = max(2 * least, int(DENSE * cells.count / len(columns)))
    at, rows, live, found, last = np.empty(len(g), np.intp), table.rows, np.arange(table.trees), [nodes], []
    known, whole = table.trees, None  # numbers that are taken; sums of the cells of the nodes that are looked at
    wanted = (nodes.n >= enough) & (nodes.left > 0)
    if not wanted.all():
        mine = np.repeat(wanted, nodes.size)
        at[rows.compress(~mine)] = np.repeat(live, nodes.size).compress(~mine)
        rows, live = rows.compress(mine), live[wanted]
    now = nodes[wanted]
    if len(live):
        own = np.flatnonzero(used.take(rows))
        node, own = np.repeat(np.arange(len(live)), now.size).take(own), rows.take(own)
        whole = cells.sums(now.n, now.total, node, own - now.shift.take(node), g.take(own))
    while len(live):
        gain, feature, edge, nl, gl = cells.best(*whole, now.n, now.total, least)
        splits, right = gain > LEAST_GAIN, 2 * nl > now.n  # the lesser child is the right one
        right |= ~splits
        edge = np.where(splits, edge, np.iinfo(np.uint16).max).astype(np.uint16)  # no row is above
        n, total = np.where(right, now.n - nl, nl) * splits, np.where(right, now.total - gl, gl) * splits
        place = np.repeat(feature * count - now.shift, now.size)
        place += rows
        lesser = flat.take(place) > np.repeat(edge, now.size)
        lesser = lesser == np.repeat(right, now.size)
        moved = np.flatnonzero(lesser)
        size = np.diff(np.searchsorted(moved, np.cumsum(now.size)), prepend=0)
        moved = rows.take(moved)
        left = now.left - 1
        wanted = splits & (now.n - n >= enough) & (left > 0)  # the other child is looked at; the lesser one is only if this one is
        both = wanted & (n >= enough)
        # rows of the other children, first of those that are done
        other = ~lesser
        if not wanted.all():
            going = np.repeat(wanted, now.size)
            ended = np.flatnonzero(other & ~going)
            at[rows.take(ended)] = np.repeat(live[~wanted], (now.size - size)[~wanted])
            other &= going
        rows = rows.take(np.flatnonzero(other))
        names = np.cumsum(splits) - 1 + known
        new = Nodes(n, total, size, now.shift, left)
        now = Nodes(now.n - n, now.total - total, now.size - size, now.shift, np.where(splits, left, 0))
        found.append(new[splits])
        last.append((live[~wanted], now[~wanted]))
        of = np.repeat(np.arange(len(live)), size)
        if wanted.any():
            some = used.take(moved)
            if not wanted.all():
                some &= wanted.take(of)
            some = np.flatnonzero(some)
            node, own = (np.cumsum(wanted) - 1).take(of.take(some)), moved.take(some)
            less = cells.sums(n[wanted], total[wanted], node, own - now.shift[wanted].take(node), g.take(own))
            if not wanted.all():
                whole = whole[0][wanted], whole[1][wanted]
            kept = both[wanted]
            for part, minus in zip(whole, less):
                part -= minus
            whole = [np.concatenate([part, minus[kept]]) for part, minus in zip(whole, less)]
        if not both.all():
            going = both.take(of)
            ended = np.flatnonzero(~going)
            at[moved.take(ended)] = names.take(of.take(ended))
            moved = moved.take(np.flatnonzero(going))
        rows = np.concatenate([rows, moved])
        live, now = np.concatenate([live[wanted], names[both]]), Nodes.joined([now[wanted], new[both]])
        known += int(splits.sum())
    found = Nodes.joined(found)
    for which, some in last:  # as nodes are after their last split
        found.n[which], found.total[which], found.size[which], found.left[which] = some.n, some.total, some.size, some.left
    return at, found


def _grow_small(table: Binned, nodes: Nodes, of: np.ndarray, g: np.ndarray, used: np.ndarray, least: int, columns: np.ndarray) -> np.ndarray:
    """Value of the leaf that each of the nodes' rows reaches. Rows of left children are put before those of right ones, so that they
    stay by node and bin without being sorted again."""
    count, left, n, total = len(of), nodes.left, nodes.n, nodes.total
    at = np.repeat(np.arange(len(n)), nodes.size)
    g, places = g.take(of), of - nodes.shift.take(at)
    bins, size = np.vstack([table.bins[j].take(places) for j in columns]), table.size[columns]
    flat, few, wide = bins.ravel(), np.flatnonzero(size <= FEW), np.flatnonzero(size > FEW)
    cells = Cells(bins, size, few) if len(few) else None  # cells of few bins are counted, so they need no order
    out, side = np.zeros(count), np.zeros(count, np.int8)
    whole, rows = g.astype(np.int64), np.arange(count)  # whole numbers: sums stay exact
    mine, bits = np.flatnonzero(used.take(of)), int(count).bit_length()
    # a row's number with its bin above it, and while rows are sorted its node above both
    order = np.empty((len(wide) + 1, len(mine)), np.int64)
    order[0] = mine
    for k, j in enumerate(wide, 1):
        order[k] = (at.take(mine) * size[j] + bins[j].take(mine) << bits) + mine
        order[k].sort()
        order[k] -= at.take(mine) * size[j] << bits
    while len(n):
        level = Level(n, total, least)
        if cells:
            gain, *split = cells.best(*cells.sums(n, total, level.node, order[0], g.take(order[0])), n, total, least)
            level.take(split[0], np.arange(len(n)), gain, *split[1:])
        if len(wide):
            level.sorted(wide, order[1:] >> bits, whole.take(order[1:] & (1 << bits) - 1))
        splits = level.feature >= 0
        level = level.only(splits)
        # nodes that are not split are put first; they and children that can't be split have their value, and their rows are done
        many, alone = int(splits.sum()), int(len(n) - splits.sum())
        n, total, left = (np.concatenate(parts) for parts in (
            (n[~splits], level.left, level.n - level.left), (total[~splits], level.below, level.total - level.below),
            (np.zeros(alone, np.int64), left[splits] - 1, left[splits] - 1)))
        goes = (n >= 2 * least) & (left > 0)
        name = np.where(splits, alone + np.cumsum(splits) - 1, np.cumsum(~splits) - 1)
        key, edge = np.zeros(len(splits), np.int64), np.full(len(splits), np.iinfo(np.uint16).max)
        key[splits], edge[splits] = level.feature * count, level.edge
        above = flat.take(key.take(at) + rows) > edge.take(at)
        at = name.take(at) + many * above
        keep = goes.take(at)
        closed = np.flatnonzero(~keep)
        ended = rows.take(closed)
        out[ended] = (total / (n + 1.0) / SCALE).take(at.take(closed))
        side[rows] = above
        side[ended] = 2
        keep = np.flatnonzero(keep)
        rows, at = rows.take(keep), (np.cumsum(goes) - 1).take(at.take(keep))
        order = order.ravel()
        sides = side.take(order & (1 << bits) - 1)
        order = np.hstack([order.take(np.flatnonzero(sides == k)).reshape(len(wide) + 1, -1) for k in (0, 1)])
        n, total, left = n[goes], total[goes], left[goes]
    return out


def grow(bins: np.ndarray, g: np.ndarray, used: np.ndarray, depth: int, setting: Setting, columns: np.ndarray) -> np.ndarray:
    """`grow_trees` for one tree."""
    table = Binned(bins, np.zeros(len(g), np.int64))
    return grow_trees(table, g, used, depth, np.array([setting.max_depth]), setting.min_child_weight, columns)


class Search:
    """Models of a grid. Tasks get a copy of it."""

    def __init__(self, features: int, spec: Mapping[str, Sequence[float]], folds: int, seed: int, limit: int):
        self.features, self.folds, self.limit = features, folds, limit
        self.settings = settings(spec)
        self.stages = sorted({int(k) for k in spec["n_estimators"]})
        self.chances = chances(seed, self.stages[-1], features)
        self.columns = [f"f{j}" for j in range(features)]

    def errors(self, rows: DataFrame) -> DataFrame:
        """Squared error and number of held-out rows per (model, number of trees), from binned rows."""
        models = len(self.settings) * self.folds
        n = rows.count()
        if n <= self.limit:
            batch = self.batches(max(1, self.limit // max(n, 1)))
            of = [[model for model, k in enumerate(batch) if k == one] for one in range(max(batch) + 1)]
            of.sort(key=self._work, reverse=True)  # tasks begin in this order, so the longest don't come last
            return rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(len(of) - 1)))).repartitionById(
                len(of), "batch").mapInPandas(
                lambda parts: self._batches(parts, of), "model int, n_estimators int, n long, sse double")
        state = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
        state, found = cut(state.withColumn("pred", F.lit(BASE))), []
        for k, chance in enumerate(self.chances, 1):
            grown = cut(self._round(state, chance, models * -(-n // self.limit)))
            uncut(state)
            state = grown
            if k in self.stages:
                gap = F.col("y") / SCALE - F.col("pred")
                found += state.where(F.col("fold") == F.col("model") % self.folds).groupBy("model").agg(
                    F.lit(k).alias("n_estimators"), F.count(F.lit(1)).alias("n"), F.sum(gap * gap).alias("sse")).collect()
        uncut(state)
        return rows.sparkSession.createDataFrame(found, "model int, n_estimators int, n long, sse double")  # one row per model and stage

    def batches(self, size: int) -> list[int]:
        """Batch of every model: at most ``size`` models that share fold, samples and least rows grow in one task."""
        models: dict[tuple, list[int]] = {}
        for model in range(len(self.settings) * self.folds):
            s = self.settings[model // self.folds]
            models.setdefault((model % self.folds, s.subsample, s.colsample_bytree, s.min_child_weight), []).append(model)
        found = itertools.chain.from_iterable(itertools.batched(group, size) for group in models.values())
        of = {model: k for k, batch in enumerate(found) for model in batch}
        return [of[model] for model in range(len(of))]

    def _work(self, models: list[int]) -> float:
        """About how long models take, side by side, in one task."""
        mine = [self.settings[model // self.folds] for model in models]
        return sum(min(s.max_depth, 25) * s.subsample * s.colsample_bytree for s in mine)

    def _batches(self, parts: Iterator[pd.DataFrame], of: list[list[int]]) -> Iterator[pd.DataFrame]:
        """The batches of a partition, which holds all rows of each."""
        found = [pdf for pdf in parts if len(pdf)]
        for batch, own in pd.concat(found, ignore_index=True).groupby("batch") if found else ():
            yield self._whole(own, of[batch])

    def _whole(self, pdf: pd.DataFrame, models: list[int]) -> pd.DataFrame:
        """All rounds of models whose rows fit into a task. They share fold and samples, and so the bins of the rows."""
        mine, rows = [self.settings[model // self.folds] for model in models], len(pdf)
        shared, deepest = mine[0], np.array([s.max_depth for s in mine])
        eta = np.repeat([s.eta for s in mine], rows)
        table = Binned(pdf[self.columns].to_numpy().T, np.repeat(np.arange(len(mine)), rows), np.arange(len(mine)) * rows)
        r, y = pdf["r"].to_numpy(), pdf["y"].to_numpy()
        held, all_y = pdf["fold"].to_numpy() == models[0] % self.folds, np.tile(y, len(mine))
        pred, found = np.full(len(all_y), BASE), []
        for k, chance in enumerate(self.chances, 1):
            used = ~held & ((r * chance.factor + chance.shift) % PRIME < shared.subsample * PRIME)
            g = all_y - np.rint(pred * SCALE).astype(np.int64)
            pred = pred + eta * grow_trees(table, g, np.tile(used, len(mine)), 0, deepest, shared.min_child_weight,
                                           chance.columns(shared.colsample_bytree))
            if k in self.stages and held.any():
                gap = (y / SCALE - pred.reshape(len(mine), rows))[:, held]
                found += [(model, k, len(own), float(own @ own)) for model, own in zip(models, gap)]
        return pd.DataFrame(found, columns=["model", "n_estimators", "n", "sse"])

    def _of_setting(self, values: Sequence[float]) -> Column:
        """A setting's value, by the row's model."""
        return F.get(F.array(*[F.lit(v) for v in values]), (F.col("model") / self.folds).cast("int"))

    def _round(self, state: DataFrame, chance: Chance, tasks: int) -> DataFrame:
        """One more tree of every model."""
        share = self._of_setting([s.subsample for s in self.settings])
        sampled = (F.col("r") * chance.factor + chance.shift) % PRIME < share * PRIME
        work = state.withColumns({
            "g": F.col("y") - F.rint(F.col("pred") * SCALE).cast("long"), "node": F.lit(1).cast("long"),
            "used": (F.col("fold") != F.col("model") % self.folds) & sampled})
        eta = self._of_setting([s.eta for s in self.settings])
        for depth in itertools.count():
            large = work.where("node > 0").groupBy("model", "node").count().where(F.col("count") > self.limit).drop("count").collect()
            if not large:  # no more nodes are large than all models' rows divided by the limit
                break
            nodes = state.sparkSession.createDataFrame(large, "model int, node long")
            steps = state.sparkSession.createDataFrame(
                nodes.join(self._best(work.join(F.broadcast(nodes), ["model", "node"]), chance, depth), ["model", "node"], "left")
                .collect(), "model int, node long, total long, n long, feature int, bin int")
            bin_of = F.get(F.array(*self.columns), F.col("feature"))
            value = F.coalesce(F.col("total") / (F.col("n") + F.lit(1.0)) / SCALE, F.lit(0.0))
            closes = F.col("large") & F.col("feature").isNull()
            work = work.join(F.broadcast(steps.withColumn("large", F.lit(True))), ["model", "node"], "left").withColumns({
                "pred": F.when(closes, F.col("pred") + eta * value).otherwise(F.col("pred")),
                "node": F.when(closes, 0).when(F.col("large"), F.col("node") * 2 + (bin_of > F.col("bin")).cast("long"))
                .otherwise(F.col("node"))}).select(work.columns)
        small = work.where("node > 0").repartition(tasks, "model", "node").groupBy("model", "node").applyInPandas(
            lambda pdf: self._rest(pdf, chance), state.schema)
        return work.where("node = 0").select(state.columns).unionByName(small)

    def _best(self, rows: DataFrame, chance: Chance, depth: int) -> DataFrame:
        """Sums of every node, and its best feature and bin (null where no split gains)."""
        place = F.get(F.array(*[F.lit(chance.order.index(j)) for j in range(self.features)]), F.col("feature"))
        allowed = self._of_setting([len(chance.columns(s.colsample_bytree)) for s in self.settings])
        least = self._of_setting([s.min_child_weight for s in self.settings])
        deeper = self._of_setting([s.max_depth for s in self.settings]) > depth
        cells = F.explode(F.array(*[F.struct(F.lit(j).alias("feature"), F.col(c).alias("bin")) for j, c in enumerate(self.columns)]))
        by_bin = (rows.where("used").select("model", "node", "g", cells.alias("c")).select("model", "node", "g", "c.*")
                  .groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n")))
        feature = Window.partitionBy("model", "node", "feature")
        upto = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = by_bin.select("model", "node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("n").over(upto).alias("nl"),
                             F.sum("g").over(feature).alias("total"), F.sum("n").over(feature).alias("size"))
        gl, total = F.col("gl").cast("double"), F.col("total").cast("double")
        gr, nr = total - gl, F.col("size") - F.col("nl")
        gain = gl * gl / (F.col("nl") + 1.0) + gr * gr / (nr + 1.0) - total * total / (F.col("size") + 1.0)
        good = deeper & (place < allowed) & (F.col("nl") >= least) & (nr >= least) & (gain > LEAST_GAIN)
        best = F.max(F.when(good, F.struct(gain.alias("gain"), -F.col("feature"), -F.col("bin"),
                                           F.col("feature").alias("feature"), F.col("bin").alias("bin"))))
        return sums.groupBy("model", "node").agg(F.max("total").alias("total"), F.max("size").alias("n"), best.alias("s")).select(
            "model", "node", "total", "n", "s.feature", "s.bin")

    def _rest(self, pdf: pd.DataFrame, chance: Chance) -> pd.DataFrame:
        """The rest of one tree below a node whose rows fit into a task."""
        setting = self.settings[int(pdf["model"].iloc[0]) // self.folds]
        value = grow(pdf[self.columns].to_numpy().T, pdf["g"].to_numpy(), pdf["used"].to_numpy(bool),
                     int(pdf["node"].iloc[0]).bit_length() - 1, setting, chance.columns(setting.colsample_bytree))
        return pdf.assign(pred=pdf["pred"] + setting.eta * value).drop(columns=["node", "g", "used"])


def tune(df: DataFrame, names: Sequence[str], spec: Mapping[str, Sequence[float]] = GRID, folds: int = 5, seed: int = 42,
         keys: Sequence[str] = ("stay_id", "time_seq"), fold: Column | None = None, label: str = TARGET) -> DataFrame:
    """Held-out root mean squared error of every point of ``spec`` in every fold; null where a fold holds no row.

    ``fold`` (0 to ``folds`` - 1) is drawn from a hash of the keys unless given. Rows with equal keys share fold and samples.
    """
    fold = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(folds)) if fold is None else fold
    rows = binned(df, names, fold, keys, label)
    limit = int(df.sparkSession.conf.get(TREE_ROWS, str(DEFAULT_TREE_ROWS)))
    search = Search(len(names), spec, folds, seed, limit)
    points = df.sparkSession.createDataFrame(
        [(i * folds + k, t, s.max_depth, s.eta, s.min_child_weight, s.subsample, s.colsample_bytree, k)
         for i, s in enumerate(search.settings) for k in range(folds) for t in search.stages],
        "model int, n_estimators int, max_depth int, eta double, min_child_weight int, subsample double, colsample_bytree double, fold int")
    return points.join(search.errors(rows), ["model", "n_estimators"], "left").select(
        "max_depth", "eta", "n_estimators", "min_child_weight", "subsample", "colsample_bytree", "fold",
        F.coalesce("n", F.lit(0)).alias("n"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def tuning_table(errors: DataFrame) -> DataFrame:
    """Mean error of every point over its folds."""
    return errors.groupBy("max_depth", "eta", "n_estimators", "min_child_weight", "subsample", "colsample_bytree").agg(
        F.avg("rmse").alias("rmse"))
