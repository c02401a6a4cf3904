"""Values carried along the order of a group: previous, next, running maximum, running sum.

Ordinary groups use a window. Hot groups are range-partitioned on (group, order) into segments, each
segment is windowed on its own, and one summary row per segment carries the value across segments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut
from .skew import AUTO, HotGroups, resolve, split_hot


@dataclass(frozen=True)
class Lag:
    """Value of the previous row."""

    column: str

    def local(self, w: WindowSpec) -> Column:
        return F.lag(self.column).over(w)

    def summary(self, order: Column) -> Column:
        return F.max_by(self.column, order)

    def carry(self, c: str, ws: WindowSpec) -> Column:
        return F.lag(c).over(ws)

    def join(self, w: WindowSpec, carry: Column) -> Column:
        return F.when(F.row_number().over(w) == 1, carry).otherwise(self.local(w))


@dataclass(frozen=True)
class Lead:
    """Value of the next row."""

    column: str

    def local(self, w: WindowSpec) -> Column:
        return F.lead(self.column).over(w)

    def summary(self, order: Column) -> Column:
        return F.min_by(self.column, order)

    def carry(self, c: str, ws: WindowSpec) -> Column:
        return F.lead(c).over(ws)

    def join(self, w: WindowSpec, carry: Column) -> Column:
        return F.when(F.lead(F.lit(1)).over(w).isNull(), carry).otherwise(self.local(w))


@dataclass(frozen=True)
class MaxBefore:
    """Largest value among the earlier rows."""

    column: str

    def local(self, w: WindowSpec) -> Column:
        return F.max(self.column).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def summary(self, order: Column) -> Column:
        return F.max(self.column)

    def carry(self, c: str, ws: WindowSpec) -> Column:
        return F.max(c).over(ws.rowsBetween(Window.unboundedPreceding, -1))

    def join(self, w: WindowSpec, carry: Column) -> Column:
        return F.greatest(self.local(w), carry)


@dataclass(frozen=True)
class SumTo:
    """Sum up to and including the row."""

    column: str

    def local(self, w: WindowSpec) -> Column:
        return F.sum(self.column).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def summary(self, order: Column) -> Column:
        return F.sum(self.column)

    def carry(self, c: str, ws: WindowSpec) -> Column:
        return F.sum(c).over(ws.rowsBetween(Window.unboundedPreceding, -1))

    def join(self, w: WindowSpec, carry: Column) -> Column:
        local = self.local(w)
        return F.when(local.isNull() & carry.isNull(), local).otherwise(
            F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))


Step = Lag | Lead | MaxBefore | SumTo
Stage = Mapping[str, Step] | Callable[[DataFrame], DataFrame]


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], *stages: Stage,
         hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Apply ``stages`` along ``order`` in each group of ``by``.

    A stage is a mapping of new column to step, or a function that adds row-wise columns. ``order`` has
    to be unique in a group for a repeatable result.
    """
    by, order = list(by), list(order)
    df, hot = resolve(df, by, hot)
    if hot is None:
        return _windowed(df, by, order, stages)
    cold, heavy = split_hot(df, hot)
    return _windowed(cold, by, order, stages).unionByName(_segmented(heavy, by, order, stages, hot))


def _windowed(df: DataFrame, by: list[str], order: list[str], stages: Sequence[Stage]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    for stage in stages:
        df = stage(df) if callable(stage) else df.withColumns({n: s.local(w) for n, s in stage.items()})
    return df


def _segmented(df: DataFrame, by: list[str], order: list[str], stages: Sequence[Stage],
               hot: HotGroups) -> DataFrame:
    parts = max(2, math.ceil(hot.total / hot.limit))
    df = cut(df.repartitionByRange(parts, *by, *order).withColumn("_seg", F.spark_partition_id()))
    inner = Window.partitionBy(*by, "_seg").orderBy(*order)
    outer = Window.partitionBy(*by).orderBy("_seg")
    position = F.struct(*order)
    for stage in stages:
        if callable(stage):
            df = stage(df)
            continue
        # one row per group and segment: at most segments + hot groups rows in all
        ends = df.groupBy(*by, "_seg").agg(*[s.summary(position).alias(f"_end_{n}") for n, s in stage.items()])
        ends = ends.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_seg").alias("_of_seg"),
                           *[s.carry(f"_end_{n}", outer).alias(f"_in_{n}") for n, s in stage.items()])
        cond = df["_seg"] == ends["_of_seg"]
        for c in by:
            cond = cond & df[c].eqNullSafe(ends[f"_of_{c}"])
        df = (df.join(F.broadcast(ends), cond, "left")
              .withColumns({n: s.join(inner, F.col(f"_in_{n}")) for n, s in stage.items()})
              .drop("_of_seg", *[f"_of_{c}" for c in by], *[f"_in_{n}" for n in stage]))
    return df.drop("_seg")
