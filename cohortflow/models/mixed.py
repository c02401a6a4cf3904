"""Random-intercept linear models from statistics that Spark sums up.

With one random intercept the likelihood depends on the rows only through X'X, X'y, y'y and, for every
distinct group size n, the sums over the groups of that size of s s' where s holds the group's column and
response sums. The rows are therefore read once, whatever the number of fits and of likelihood evaluations.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.categories import observed_levels
from ..operators.skew import AUTO, HotGroups, salted_join
from ..operators.summaries import histogram
from ..session import cut
from .tails import chi2_upper, normal_quantile, normal_two_sided, t_two_sided

ALL = "all data"
ALIAS_TOLERANCE = 1e-9


@dataclass(frozen=True)
class Term:
    """A categorical term; the first level is the reference."""

    column: str
    levels: tuple

    @staticmethod
    def observed(df: DataFrame, column: str, ref: str | None = None) -> "Term":
        found = observed_levels(df, column)
        if ref is not None:
            found = [ref] + [x for x in found if x != ref]
        return Term(column, tuple(found))


@dataclass(frozen=True)
class Design:
    """Treatment-coded columns: 0 is the intercept, then the non-reference levels term by term."""

    response: str
    group: str
    terms: tuple[Term, ...] = ()

    @property
    def columns(self) -> list[tuple[str, object]]:
        return [(t.column, level) for t in self.terms for level in t.levels[1:]]

    @property
    def names(self) -> list[str]:
        return ["(Intercept)"] + [f"{c}{level}" for c, level in self.columns]

    @property
    def size(self) -> int:
        return 1 + len(self.columns)

    def active(self) -> Column:
        """Ids of the columns that are 1 in a row."""
        ids, expr = 1, [F.lit(0)]
        for t in self.terms:
            hit = None
            for level in t.levels[1:]:
                cond = F.col(t.column) == F.lit(level)
                hit = F.when(cond, ids) if hit is None else hit.when(cond, ids)
                ids += 1
            if hit is not None:
                expr.append(hit)
        return F.array_compact(F.array(*expr))

    def linear(self, beta: Mapping[str, float]) -> Column:
        """x'beta of a row."""
        out = F.lit(float(beta.get("(Intercept)", 0.0)))
        for t in self.terms:
            part = F.lit(0.0)
            for level in t.levels[1:]:
                value = float(beta.get(f"{t.column}{level}", 0.0))
                part = F.when(F.col(t.column) == F.lit(level), F.lit(value)).otherwise(part)
            out = out + part
        return out

    def complete(self, df: DataFrame) -> DataFrame:
        """Rows with every model variable known."""
        df = df.where(F.col(self.response).isNotNull() & F.col(self.group).isNotNull())
        for t in self.terms:
            df = df.where(F.col(t.column).isin(list(t.levels)))
        return df


def cells(df: DataFrame, design: Design) -> DataFrame:
    """Rows collapsed to (subgroup, group, term levels): count, response sum, sum of squares."""
    y = F.col(design.response)
    keys = ["subgroup", design.group, *[t.column for t in design.terms]]
    return design.complete(df).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("m"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))


def cross_products(cell: DataFrame, design: Design) -> DataFrame:
    """(subgroup, a, b, v) with a <= b: X'X, X'y and y'y; the response is the last column id."""
    y = design.size
    levels = cell.groupBy("subgroup", *[t.column for t in design.terms]).agg(
        F.sum("m").cast("double").alias("m"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"))
    levels = levels.withColumn("ids", design.active())

    def pair(a: Column, b: Column, v: Column) -> Column:
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), v.alias("v"))

    m, sy, syy = F.col("m"), F.col("sy"), F.col("syy")
    xx = F.flatten(F.transform("ids", lambda a: F.transform(
        F.filter("ids", lambda b: b >= a), lambda b: pair(a, b, m))))
    xy = F.transform("ids", lambda a: pair(a, F.lit(y), sy))
    every = F.concat(xx, xy, F.array(pair(F.lit(y), F.lit(y), syy)))
    return (levels.select("subgroup", F.explode(every).alias("p")).select("subgroup", "p.*")
            .groupBy("subgroup", "a", "b").agg(F.sum("v").alias("v")))


def group_sums(cell: DataFrame, design: Design) -> DataFrame:
    """(subgroup, group, n, sums): rows of a group, and the sums of its columns and response."""
    m = F.col("m").cast("double")
    aggs = [F.sum(F.when(F.col(c) == F.lit(level), m).otherwise(0.0)).alias(f"_s{k}")
            for k, (c, level) in enumerate(design.columns, start=1)]
    wide = cell.groupBy("subgroup", design.group).agg(F.sum("m").alias("n"), F.sum("sy").alias("_t"), *aggs)
    sums = F.array(F.col("n").cast("double"), *[F.col(f"_s{k}") for k in range(1, design.size)],
                   F.col("_t").cast("double"))
    return wide.select("subgroup", design.group, "n", sums.alias("sums"))


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with equal keys, batch by batch."""
    for batch in batches:
        at = 0
        for key, same in itertools.groupby(zip(*(batch.column(k).to_pylist() for k in keys))):
            size = sum(1 for _ in same)
            yield key, batch.slice(at, size)
            at += size


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def added(df: DataFrame, keys: Sequence[str], part: Callable[[tuple, pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """(keys, v) with the sums of equally long vectors, those of column ``v`` or those that ``part`` makes of a key and some of
    its rows. Keys are strings or longs.

    Each task adds the rows that it has, sorted by key, and then those that the others made of a key: one row per task and
    key is shuffled, and a task holds one sum at a time.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("v", T.ArrayType(T.DoubleType()))])

    def adding(make):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done, size, now, total = [], 0, None, None
            for key, rows in _runs(batches, keys):
                more = make(key, rows)
                if key == now:
                    total += more
                    continue
                if now is not None:
                    done.append((*now, total))
                    size += total.nbytes
                if size > 1 << 22:
                    yield _rows(done, arrow)
                    done, size = [], 0
                now, total = key, np.array(more)
            if now is not None:
                yield _rows([*done, (*now, total)], arrow)
        return run

    arrow = pa.schema([*((k, pa.string() if isinstance(df.schema[k].dataType, T.StringType) else pa.int64()) for k in keys),
                       ("v", pa.list_(pa.float64()))])
    plain = lambda key, rows: _matrix(rows.column("v")).sum(0)
    first = df.sortWithinPartitions(*keys).mapInArrow(adding(part or plain), schema)
    return first.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(adding(plain), schema)


def _rows(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def packed_moments(cell: DataFrame, design: Design) -> DataFrame:
    """(subgroup, n, v): sums of products of group sums over the groups of size n, the upper triangle row by row."""
    upper = np.triu_indices(design.size + 1)

    def products(key: tuple, rows: pa.RecordBatch) -> np.ndarray:
        x = _matrix(rows.column("sums"))
        return (x.T @ x)[upper]

    return added(group_sums(cell, design).select("subgroup", "n", "sums"), ["subgroup", "n"], products)


def group_moments(cell: DataFrame, design: Design) -> DataFrame:
    """(subgroup, n, a, b, v): `packed_moments` as one row per product that isn't zero."""
    a, b = (x.tolist() for x in np.triu_indices(design.size + 1))
    places = F.arrays_zip(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("v"))
    long = packed_moments(cell, design).select("subgroup", "n", F.explode(places).alias("p"))
    return long.select("subgroup", "n", F.col("p")["a"].alias("a"), F.col("p")["b"].alias("b"),
                       F.col("p")["v"].alias("v")).where("v <> 0")


@dataclass
class Shrunk:
    """Sums over group sizes at one variance ratio: weights w, w', w'' and 2w - n w^2 on the moments, and the
    log-determinant of the group covariances with its two derivatives."""

    w: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    wr: np.ndarray
    logdet: tuple[float, float, float]


def _weights(n, lam):
    one = 1 + n * lam
    w = lam / one
    return w, 1 / one ** 2, -2 * n / one ** 3, 2 * w - n * w * w


class Statistics:
    """The collapsed statistics of all subgroups."""

    def __init__(self, cell: DataFrame, design: Design):
        """``cell`` comes from ``cells`` with this design or one that has more terms."""
        self.design = design
        size = design.size + 1
        self.xx: dict[str, np.ndarray] = {}
        for r in cross_products(cell, design).collect():
            mat = self.xx.setdefault(r["subgroup"], np.zeros((size, size)))
            mat[r["a"], r["b"]] = mat[r["b"], r["a"]] = r["v"]
        self.subgroups = sorted(self.xx)
        self.cell = cell
        self.moments = cut(packed_moments(cell, design))
        groups = F.col("v")[0] / (F.col("n") * F.col("n"))  # the first product is that of the sizes
        rows = self.moments.groupBy("subgroup").agg(F.sum(groups).alias("g")).collect()
        self.groups = {r["subgroup"]: int(round(r["g"])) for r in rows}

    def shrink(self, points: Mapping[str, Sequence[float]]) -> dict[tuple[str, float], Shrunk]:
        """Weighted sums for the asked variance ratios of each subgroup, all in one pass. Spark adds them to one row per
        subgroup, whose length is that of its ratios."""
        asked = {s: [float(x) for x in lams] for s, lams in points.items()}
        size = self.design.size + 1
        width, out = size * (size + 1) // 2, {}
        for s, v in self._spark(asked).items():
            for lam, sums in zip(asked[s], v.reshape(len(asked[s]), -1)):
                mats = []
                for flat in sums[:4 * width].reshape(4, width):
                    mat = np.zeros((size, size))
                    mat[np.triu_indices(size)] = flat
                    mats.append(mat + np.triu(mat, 1).T)
                out[s, lam] = Shrunk(*mats, logdet=tuple(float(x) for x in sums[4 * width:]))
        return out

    def _spark(self, asked: Mapping[str, Sequence[float]]) -> dict[str, np.ndarray]:
        def weighted(key: tuple, rows: pa.RecordBatch) -> np.ndarray:
            lam = np.array(asked[key[0]])[:, None]
            n = rows.column("n").to_numpy().astype(float)[None, :]
            v = _matrix(rows.column("v"))
            one, groups = 1 + n * lam, v[:, 0] / n[0] ** 2
            logdet = [(groups * x).sum(1)[:, None] for x in (np.log(one), n / one, -(n / one) ** 2)]
            return np.hstack([w @ v for w in _weights(n, lam)] + logdet).ravel()

        rows = self.moments.where(F.col("subgroup").isin(list(asked)))
        found = added(rows, ["subgroup"], weighted).toArrow()
        return {s: np.array(v) for s, v in zip(found["subgroup"].to_pylist(), _vectors(found["v"]))}


def _vectors(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for chunk in column.chunks:
        for k in range(len(chunk)):
            yield chunk.slice(k, 1).flatten().to_numpy(zero_copy_only=False)


@dataclass
class Fit:
    """One fitted model. Dropped columns carried no information of their own."""

    subgroup: str
    design: Design
    reml: bool
    names: list[str]
    dropped: list[str]
    beta: np.ndarray
    cov: np.ndarray
    dof: np.ndarray
    sigma2: float
    lam: float
    nobs: int
    ngroups: int
    loglik: float
    rmse: float
    shares: dict[str, float] = field(repr=False, default_factory=dict)
    converged: bool = True  # false: the search for the variance ratio had not settled, the fit is that at its last point

    @property
    def npar(self) -> int:
        return len(self.names) + 2

    @property
    def aic(self) -> float:
        return 2 * self.npar - 2 * self.loglik

    @property
    def bic(self) -> float:
        return math.log(self.nobs) * self.npar - 2 * self.loglik

    @property
    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.names, map(float, self.beta)))


def independent(xx: np.ndarray) -> list[int]:
    """Columns that are not combinations of earlier ones."""
    kept: list[int] = []
    for j in range(xx.shape[0]):
        norm = xx[j, j]
        if norm <= 0:
            continue
        if kept:
            c = xx[kept, j]
            norm = norm - c @ np.linalg.solve(xx[np.ix_(kept, kept)], c)
        if norm > ALIAS_TOLERANCE * xx[j, j]:
            kept.append(j)
    return kept


class _Likelihood:
    """Profiled -2 log-likelihood of one subgroup and its derivatives in the variance ratio."""

    def __init__(self, xx: np.ndarray, reml: bool):
        self.p_all = xx.shape[0] - 1
        self.keep = independent(xx[:-1, :-1])
        self.index = self.keep + [self.p_all]
        self.xx = xx[np.ix_(self.index, self.index)]
        self.nobs = int(round(xx[0, 0]))
        self.reml = reml
        self.p = len(self.keep)
        self.free = self.nobs - self.p if reml else self.nobs

    def at(self, s: Shrunk) -> dict:
        pick = np.ix_(self.index, self.index)
        q = self.xx - s.w[pick]
        w1, w2, p = s.w1[pick], s.w2[pick], self.p
        a_inv = np.linalg.inv(q[:p, :p])
        beta = a_inv @ q[:p, p]
        c = np.append(-beta, 1.0)
        rss = float(c @ q @ c)
        g = w1[:p] @ c
        rss1 = -float(c @ w1 @ c)
        rss2 = -float(c @ w2 @ c) - 2 * float(g @ a_inv @ g)
        l0, l1, l2 = s.logdet
        if self.reml:
            aw = a_inv @ w1[:p, :p]
            l0 += float(np.linalg.slogdet(q[:p, :p])[1])
            l1 -= float(np.trace(aw))
            l2 -= float(np.trace(a_inv @ w2[:p, :p]) + np.trace(aw @ aw))
        f = self.free
        return {
            "value": f * math.log(2 * math.pi * rss / f) + f + l0 if rss > 0 else math.inf, "beta": beta, "a_inv": a_inv, "rss": rss,
            "d1": f * rss1 / rss + l1, "d2": f * (rss2 / rss - (rss1 / rss) ** 2) + l2,
            "rss1": rss1, "rss2": rss2, "l2": l2, "w1": w1[:p, :p],
            "resid": float(c @ (self.xx - s.wr[pick]) @ c),
        }


ROUNDS = 60  # of the search for a variance ratio
GRID = (0.0, *np.logspace(-6, 5, 34))


def fit(df: DataFrame, response: str, terms: Sequence[Term], group: str, reml: bool = True) -> list[Fit]:
    """Fit the model to each ``subgroup`` of ``df`` (to all rows if it has no such column)."""
    if "subgroup" not in df.columns:
        df = df.withColumn("subgroup", F.lit(ALL))
    design = Design(response, group, tuple(terms))
    return fit_statistics(Statistics(cut(cells(df, design)), design), reml)


def _lowest(values: Sequence[float], free: int) -> int:
    """Place in `GRID` of the lowest value. A larger variance ratio must beat a smaller one by more than rounding, which grows with it:
    where the likelihood is flat, the order of summation would decide."""
    best = 0
    for k, (lam, v) in enumerate(zip(GRID, values)):
        if v < values[best] - 1e-14 * free * (1 + lam):
            best = k
    return best


def fit_statistics(stats: Statistics, reml: bool = True) -> list[Fit]:
    like = {s: _Likelihood(stats.xx[s], reml) for s in stats.subgroups}
    like = {s: m for s, m in like.items() if m.free > 0 and m.nobs > m.p}
    first = stats.shrink({s: GRID for s in like})
    # a subgroup its own terms explain fully has no variance to estimate
    like = {s: m for s, m in like.items() if m.at(first[s, 0.0])["rss"] > ALIAS_TOLERANCE * m.xx[m.p, m.p]}
    value = {s: [like[s].at(first[s, lam])["value"] for lam in GRID] for s in like}
    best = {s: _lowest(v, like[s].free) for s, v in value.items()}
    lam = {s: GRID[k] for s, k in best.items()}
    top = math.log(GRID[-1])
    bracket = {s: (math.log(GRID[max(k - 1, 1)]), math.log(GRID[k + 1]) if k + 1 < len(GRID) else 2 * top)
               for s, k in best.items() if k > 0}
    # a minimum between zero and the smallest positive grid point counts as zero
    open_ = set(bracket)
    for _ in range(ROUNDS):
        if not open_:
            break
        got = stats.shrink({s: [lam[s]] for s in open_})
        for s in sorted(open_):
            m = like[s].at(got[s, lam[s]])
            u, (lo, hi) = math.log(lam[s]), bracket[s]
            d_u = lam[s] * m["d1"]
            d_uu = lam[s] ** 2 * m["d2"] + d_u
            lo, hi = (lo, u) if d_u > 0 else (u, hi)
            bracket[s] = (lo, hi)
            step = u - d_u / d_uu if d_uu > 0 else math.nan
            if not lo < step < hi:
                step = (lo + hi) / 2
            if abs(step - u) < 1e-10 or hi - lo < 1e-10:
                open_.discard(s)
            else:
                lam[s] = math.exp(step)
    last = stats.shrink({s: [lam[s]] for s in like})
    return [replace(_summary(stats, s, like[s], lam[s], like[s].at(last[s, lam[s]])), converged=s not in open_) for s in like]


def fit_at(stats: Statistics, lam: float, reml: bool = True) -> list[Fit]:
    """The model of each subgroup at a given variance ratio; 0 gives least squares."""
    like = {s: _Likelihood(stats.xx[s], reml) for s in stats.subgroups}
    got = stats.shrink({s: [lam] for s in like})
    return [_summary(stats, s, m, lam, m.at(got[s, lam])) for s, m in like.items()]


def profile(spark: SparkSession, stats: Statistics, lams: Sequence[float] = GRID, reml: bool = True) -> DataFrame:
    """(subgroup, lam, value, intercept): -2 log-likelihood over variance ratios."""
    like = {s: _Likelihood(stats.xx[s], reml) for s in stats.subgroups}
    got = stats.shrink({s: list(lams) for s in like})
    rows = []
    for s, m in like.items():
        for lam in lams:
            at = m.at(got[s, lam])
            rows.append((s, float(lam), float(at["value"]), float(at["beta"][0])))
    return spark.createDataFrame(rows, "subgroup string, lam double, value double, intercept double")


def normal_equations(spark: SparkSession, stats: Statistics, lam: float) -> DataFrame:
    """(subgroup, a, b, v) with a <= b: cross products weighted by the inverse covariance at a variance ratio."""
    got = stats.shrink({s: [lam] for s in stats.subgroups})
    rows = [(s, a, b, float(stats.xx[s][a, b] - got[s, lam].w[a, b])) for s in stats.subgroups
            for a in range(len(stats.xx[s])) for b in range(a, len(stats.xx[s]))]
    return spark.createDataFrame(rows, "subgroup string, a int, b int, v double")


def _summary(stats: Statistics, s: str, like: _Likelihood, lam: float, m: dict) -> Fit:
    names = stats.design.names
    sigma2 = m["rss"] / like.free
    shares = {n: stats.xx[s][0, j] / like.nobs for j, n in enumerate(names)}
    return Fit(subgroup=s, design=stats.design, reml=like.reml, names=[names[j] for j in like.keep],
               dropped=[n for j, n in enumerate(names) if j not in like.keep], beta=m["beta"],
               cov=sigma2 * m["a_inv"], dof=_satterthwaite(like, lam, sigma2, m), sigma2=sigma2, lam=lam,
               nobs=like.nobs, ngroups=stats.groups[s], loglik=-m["value"] / 2,
               rmse=math.sqrt(max(m["resid"], 0.0) / like.nobs), shares=shares)


def _satterthwaite(like: _Likelihood, lam: float, sigma2: float, m: dict) -> np.ndarray:
    """Approximate degrees of freedom of each coefficient; residual ones where the ratio is at its bound."""
    v = sigma2 * np.diag(m["a_inv"])
    rest = np.full(len(v), float(like.nobs - like.p))
    if lam <= 0:
        return rest
    cross = -m["rss1"] / sigma2 ** 2
    hess = np.array([[m["l2"] + m["rss2"] / sigma2, cross],
                     [cross, -like.free / sigma2 ** 2 + 2 * m["rss"] / sigma2 ** 3]])
    if np.linalg.det(hess) <= 0:
        return rest
    var = 2 * np.linalg.inv(hess)
    grad = np.stack([sigma2 * np.diag(m["a_inv"] @ m["w1"] @ m["a_inv"]), np.diag(m["a_inv"])])
    spread = np.einsum("ij,ik,kj->j", grad, var, grad)
    return np.where(spread > 0, 2 * v ** 2 / np.where(spread > 0, spread, 1.0), rest)


def coefficients(spark: SparkSession, fits: Sequence[Fit], method: str = "satterthwaite") -> DataFrame:
    """Estimate, standard error, degrees of freedom, t and p per coefficient; ``method`` "z" uses the normal."""
    rows = []
    for f in fits:
        for k, name in enumerate(f.names):
            se = math.sqrt(f.cov[k, k])
            t = float(f.beta[k]) / se
            dof = math.inf if method == "z" else float(f.dof[k])
            p = normal_two_sided(t) if method == "z" else t_two_sided(t, dof)
            rows.append((f.subgroup, name, float(f.beta[k]), se, dof, t, p))
        rows += [(f.subgroup, name, None, None, None, None, None) for name in f.dropped]
    return spark.createDataFrame(rows, "subgroup string, term string, estimate double, std_error double, "
                                       "df double, statistic double, p_value double")


def fit_stats(spark: SparkSession, fits: Mapping[str, Fit]) -> DataFrame:
    rows = [(name, f.subgroup, f.nobs, f.ngroups, f.npar, f.loglik, f.aic, f.bic, f.rmse, math.sqrt(f.sigma2),
             math.sqrt(f.lam * f.sigma2), "REML" if f.reml else "ML", f.converged) for name, f in fits.items()]
    return spark.createDataFrame(rows, "model string, subgroup string, nobs long, ngroups long, npar int, "
                                       "loglik double, aic double, bic double, rmse double, sigma double, "
                                       "group_sd double, criterion string, converged boolean")


def compare(spark: SparkSession, fits: Sequence[tuple[str, Fit]]) -> DataFrame:
    """Nested models fitted by maximum likelihood, each against the one before it."""
    rows, before = [], None
    for name, f in fits:
        if f.reml:
            raise ValueError("compare models fitted with reml=False")
        chi = dof = p = None
        if before is not None:
            chi, dof = max(0.0, 2 * (f.loglik - before.loglik)), f.npar - before.npar
            p = chi2_upper(chi, dof) if dof > 0 else None
        rows.append((name, f.npar, f.nobs, f.aic, f.bic, f.loglik, -2 * f.loglik, chi, dof, p))
        before = f
    return spark.createDataFrame(rows, "model string, npar int, nobs long, aic double, bic double, loglik double, "
                                       "deviance double, chisq double, df int, p_value double")


def marginal_means(spark: SparkSession, fits: Sequence[Fit], term: str, level: float = 0.95) -> DataFrame:
    """Mean response at each observed level of ``term``, the other terms at their observed shares, with a
    normal interval."""
    z = normal_quantile((1 + level) / 2)
    rows = []
    for f in fits:
        t = next(x for x in f.design.terms if x.column == term)
        own = {f"{term}{x}" for x in t.levels[1:]}
        rest = 1 - sum(f.shares[n] for n in own)
        base = np.array([0.0 if n in own else f.shares[n] for n in f.names])
        for x in t.levels:
            name = f"{term}{x}"
            if (f.shares[name] if name in own else rest) <= 1e-12:
                continue
            row = base + np.array([1.0 if n == name and n in own else 0.0 for n in f.names])
            mean, se = float(row @ f.beta), math.sqrt(float(row @ f.cov @ row))
            rows.append((f.subgroup, str(x), mean, se, mean - z * se, mean + z * se, f.ngroups, f.nobs))
    return spark.createDataFrame(rows, f"subgroup string, {term} string, emmean double, se double, lower double, "
                                       "upper double, npat long, nmeas long")


def residuals(stats: Statistics, f: Fit, df: DataFrame, hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Rows with ``fitted`` and ``residual``, the group intercept included in the fit."""
    design = f.design
    df = design.complete(df)
    sums = group_sums(stats.cell.where(F.col("subgroup") == f.subgroup), design)
    # r = t - s'beta of the group
    effect = F.lit([-f.coefficients.get(n, 0.0) for n in design.names] + [1.0])
    r = F.aggregate(F.zip_with("sums", effect, lambda v, e: v * e), F.lit(0.0), lambda acc, x: acc + x)
    w = F.lit(f.lam) / (1 + F.col("n") * F.lit(f.lam))
    effects = sums.select(design.group, (w * r).alias("_u"))
    out = salted_join(df, effects, [design.group], "left", hot)
    out = out.withColumn("fitted", design.linear(f.coefficients) + F.col("_u")).drop("_u")
    return out.withColumn("residual", F.col(design.response) - F.col("fitted"))


def residual_histogram(residual: DataFrame, width: float = 0.5) -> DataFrame:
    return histogram(residual, "residual", width)
