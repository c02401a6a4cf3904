"""Aggregates in which one missing input makes the result missing."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strict(agg: Column, c: Column) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(c), agg)


def sum_strict(c: Column, on: Column | None = None) -> Column:
    """Sum, missing if an input is; with ``on`` over the rows that meet it, missing if none does."""
    if on is None:
        return _strict(F.sum(c), c)
    hits = F.count_if(on)
    return F.when((hits > 0) & (hits == F.count(F.when(on, c))), F.sum(F.when(on, c)))


def min_strict(c: Column) -> Column:
    return _strict(F.min(c), c)


def max_strict(c: Column) -> Column:
    return _strict(F.max(c), c)


def mean_strict(c: Column) -> Column:
    return _strict(F.avg(c), c)


def paste(c: Column, order: Column, sep: str = "_", on: Column | None = None) -> Column:
    """Texts joined in ``order``, a null written as NA; with ``on`` of the rows that meet it."""
    text = F.coalesce(c.cast("string"), F.lit("NA"))
    pair = F.struct(order.alias("o"), text.alias("v"))
    pairs = F.array_sort(F.collect_list(pair if on is None else F.when(on, pair)))
    joined = F.array_join(F.transform(pairs, lambda p: p["v"]), sep)
    return joined if on is None else F.when(F.count_if(on) > 0, joined)


def all_true(cond: Column) -> Column:
    """True when the condition holds for every row; a null condition counts as false."""
    return F.bool_and(F.coalesce(cond, F.lit(False)))


def any_true(cond: Column) -> Column:
    return F.bool_or(F.coalesce(cond, F.lit(False)))


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


T_SERIES = 200  # degrees of freedom up to which the finite series is summed; beyond it the expansion is exact to 1e-11


def t_quantile(df: Column, level: float) -> Column:
    """The t with P(|T| <= t) = ``level`` for whole degrees of freedom; null below one.

    With t = sqrt(df) tan(a) that probability is a finite series in cos(a), which is halved sixty times; for many degrees of
    freedom an expansion around the normal quantile.
    """
    df = df.cast("double")
    z = NormalDist().inv_cdf((1 + level) / 2)
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
             (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    many = sum((F.lit(c) / F.pow(df, F.lit(float(k))) for k, c in enumerate(terms)), F.lit(0.0))
    odd = df % 2 == 1
    more = F.floor((df - 1) / 2) - F.when(odd, 1).otherwise(0)  # terms after the first
    steps = F.when(more >= 1, F.sequence(F.lit(1).cast("bigint"), more.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))

    def inside(a: Column) -> Column:
        square = F.pow(F.cos(a), F.lit(2.0))
        ratio = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        first = F.when(odd, F.cos(a)).otherwise(F.lit(1.0))
        series = F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), lambda s, k: F.struct(
            (s["term"] * square * ratio(k)).alias("term"), (s["total"] + s["term"] * square * ratio(k)).alias("total")),
            lambda s: s["total"])
        total = F.sin(a) * F.when(df == 1, 0.0).otherwise(series)
        return F.when(odd, (a + total) * (2 / math.pi)).otherwise(total)

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(math.pi / 2).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        low = inside(middle) < level
        return F.struct(F.when(low, middle).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(middle).alias("hi"))

    angle = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(df > T_SERIES, many).when(df >= 1, F.sqrt(df) * F.tan(angle))
