"""Binning, factor levels and value maps."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mark(x: float) -> str:
    if math.isinf(x):
        return "Inf" if x > 0 else "-Inf"
    return f"{x:g}"


def cut_labels(breaks: Sequence[float], include_lowest: bool = True) -> list[str]:
    """Labels of right-closed bins; an upper infinite end is written with a space before it."""
    labels = []
    for k, (lo, hi) in enumerate(zip(breaks, breaks[1:])):
        left = "[" if k == 0 and include_lowest else "("
        gap = " " if math.isinf(hi) and not math.isinf(lo) else ""
        labels.append(f"{left}{_mark(lo)},{gap}{_mark(hi)}]")
    return labels


def cut(c: Column, breaks: Sequence[float], include_lowest: bool = True) -> Column:
    """Label of the right-closed bin that holds ``c``; null outside all bins."""
    expr = None
    labels = cut_labels(breaks, include_lowest)
    for k, label in enumerate(labels):
        lo, hi = breaks[k], breaks[k + 1]
        low = (c >= lo) if k == 0 and include_lowest else (c > lo)
        cond = c.isNotNull()
        if not math.isinf(lo):
            cond = cond & low
        if not math.isinf(hi):
            cond = cond & (c <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def map_values(c: Column, groups: Mapping[str, Sequence[str]], default: Column | None = None) -> Column:
    """Group name of each listed value; other values take ``default`` (null if none is given)."""
    expr = None
    for name, members in groups.items():
        cond = c.isin(list(members))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr if default is None else expr.otherwise(default)


def first_part(c: Column, sep: str = " -") -> Column:
    """Text before the first separator."""
    return F.split(c, sep, 2).getItem(0)


def factor(c: Column, levels: Sequence[str], labels: Sequence[str] | None = None) -> Column:
    """Struct (ord, label) of an ordered level; null for a value outside ``levels``."""
    names = list(labels or levels)
    expr = None
    for k, level in enumerate(levels):
        hit = F.struct(F.lit(k).alias("ord"), F.lit(names[k]).alias("label"))
        expr = F.when(c == level, hit) if expr is None else expr.when(c == level, hit)
    return expr


def relevel(levels: Sequence[str], ref: str) -> list[str]:
    """Levels with the reference first and the others in their order."""
    return [ref] + [x for x in levels if x != ref]


def observed_levels(df: DataFrame, c: str) -> list[str]:
    """Sorted levels of a category that the caller knows to be small."""
    return sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())


def glucose_mmol(c: Column) -> Column:
    """mg/dL to mmol/L."""
    return c / F.lit(18.0182)
