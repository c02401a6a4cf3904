"""Boolean columns that never turn null into a match."""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_in(c: Column, values: Sequence) -> Column:
    """Set membership that is false, not null, for a null."""
    return F.coalesce(c.isin(list(values)), F.lit(False))


def _any_of(patterns: Sequence[str]) -> str:
    return "|".join(re.escape(p.lower()) for p in patterns)


def contains_any(c: Column, patterns: Sequence[str]) -> Column:
    """Case-insensitive substring test; false for a null."""
    return F.coalesce(F.lower(c).rlike(_any_of(patterns)), F.lit(False))


def exclude_any(c: Column, patterns: Sequence[str]) -> Column:
    """True when none of the substrings occurs (a null has none)."""
    return ~contains_any(c, patterns)


def has_prefix(c: Column, prefixes: Sequence[str]) -> Column:
    """True when the code starts with one of ``prefixes``: one lookup among those of each length."""
    by_length: dict[int, list[str]] = {}
    for p in prefixes:
        by_length.setdefault(len(p), []).append(p)
    found = [F.substring(c, 1, n).isin(ps) for n, ps in sorted(by_length.items())]
    return F.coalesce(reduce(operator.or_, found, F.lit(False)), F.lit(False))


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Interval meets the reference interval, or covers it entirely."""
    return ~((end <= lo) | (start >= hi)) | ((start <= lo) & (end >= hi))


def within(t: Column, lo: Column, hi: Column) -> Column:
    """Both ends closed."""
    return t.between(lo, hi)


def semi_filter(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``; the size of the key table picks the join."""
    names = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*names), names, "left_semi")


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)
