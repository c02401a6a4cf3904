"""Group values on rows, texts of a group in order, first rows of a key, rows at a group extreme."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import paste
from ..session import cut
from .skew import AUTO, HotGroups, resolve, salted_join, split_hot


def group_attach(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column],
                 hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Add group aggregates to every row.

    Ordinary groups use a window (one shuffle). With hot groups the aggregate is computed first, with
    partial sums on the map side, and joined back with the hot keys salted.
    """
    by = list(by)
    df, hot = resolve(df, by, hot)
    if hot is None:
        w = Window.partitionBy(*by)
        return df.withColumns({n: c.over(w) for n, c in aggs.items()})
    totals = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return salted_join(df, totals, by, "left", hot, null_safe=True)


def center(df: DataFrame, by: Sequence[str], c: str, name: str, hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Deviation from the group mean."""
    return (group_attach(df, by, {"_mean": F.avg(c)}, hot)
            .withColumn(name, F.col(c) - F.col("_mean")).drop("_mean"))


def keep_groups_all(df: DataFrame, by: Sequence[str], cond: Column,
                    hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Rows of groups in which the condition holds for every row; a null condition counts as false."""
    out = group_attach(df.withColumn("_ok", F.coalesce(cond, F.lit(False))), by,
                       {"_all": F.bool_and("_ok")}, hot)
    return out.where("_all").drop("_ok", "_all")


def paste_groups(df: DataFrame, by: Sequence[str], c: str, order: Sequence[str], name: str, sep: str = "_",
                 hot: HotGroups | None | str = AUTO) -> DataFrame:
    """One row per group: its texts joined in ``order``, a null written as NA; rows of equal order go by their text.

    A hot group is dealt by range into segments, each of which is joined by itself; its last task gets one text per segment
    instead of all rows. Equal places never lie in two segments.
    """
    by, order = list(by), list(order)
    df, hot = resolve(df.select(*dict.fromkeys([*by, c, *order])), by, hot)
    if hot is None:
        return df.groupBy(*by).agg(paste(F.col(c), F.struct(*order), sep).alias(name))
    cold, heavy = split_hot(df, hot)
    parts = max(2, math.ceil(hot.total / hot.limit))
    heavy = cut(heavy.repartitionByRange(parts, *by, *order).withColumn("_seg", F.spark_partition_id()))
    segments = heavy.groupBy(*by, "_seg").agg(paste(F.col(c), F.struct(*order), sep).alias("_text"))
    whole = segments.groupBy(*by).agg(paste(F.col("_text"), F.col("_seg"), sep).alias(name))
    return paste_groups(cold, by, c, order, name, sep, None).unionByName(whole)


def keep_group_min(df: DataFrame, by: Sequence[str], c: str) -> DataFrame:
    """Rows at the smallest value of their group, ties kept.

    Filtering a rank lets Spark drop the losers of a group before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last())
    return df.withColumn("_rank", F.rank().over(w)).where((F.col("_rank") == 1) & F.col(c).isNotNull()).drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first whole row of each key in ``order``; losers are dropped before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).where(F.col("_row") == 1).drop("_row")


def dedupe_preferred(df: DataFrame, keys: Sequence[str], preference: Column, tie: Sequence[str]) -> DataFrame:
    """The row with the lowest preference code of each key, then the first in ``tie`` order."""
    return first_per_key(df.withColumn("_pref", preference), keys,
                         [F.col("_pref").asc_nulls_last(), *tie]).drop("_pref")


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), the same ones for the same seed: the first by md5 of key and seed as text."""
    draw = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    return df.withColumn("_draw", draw).orderBy("_draw", *key).limit(n).drop("_draw")
