"""Hot groups: find them once, then split the work on them.

A group is hot when it holds more rows than one task should take, by a count of its rows at any input size. There can
be no more hot groups than all rows divided by that limit, which bounds the list. Whether a group is on the list changes how the
work is split, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

HOT_ROWS = "spark.cohortflow.hotRows"
DEFAULT_HOT_ROWS = 5_000_000

AUTO = "auto"


def hot_rows(spark: SparkSession) -> int:
    """Rows of one group that one task may take."""
    return int(spark.conf.get(HOT_ROWS, str(DEFAULT_HOT_ROWS)))


@dataclass(frozen=True)
class HotGroups:
    """Keys of the hot groups with their row counts (column ``_n``)."""

    by: tuple[str, ...]
    rows: tuple[Row, ...]
    schema: T.StructType
    limit: int

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def total(self) -> int:
        return sum(r["_n"] for r in self.rows)


def hot_groups(df: DataFrame, by: Sequence[str], key: Sequence[Column] | None = None) -> HotGroups | None:
    """Groups of ``df`` too large for one task, or None: one count, partial before the shuffle."""
    limit = hot_rows(df.sparkSession)
    counts = df.groupBy(*(key or by)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    rows = counts.collect()
    return HotGroups(tuple(by), tuple(rows), counts.schema, limit) if rows else None


def resolve(df: DataFrame, by: Sequence[str], hot: HotGroups | None | str) -> tuple[DataFrame, HotGroups | None]:
    """``df`` and the given list. When ``hot`` is ``"auto"``, the rows are stored first and counted there, so that
    what makes them runs once; the count reads only the keys."""
    if not isinstance(hot, str):
        return df, hot
    df = cut(df)
    return df, hot_groups(df, by)


def merge(a: HotGroups | None, b: HotGroups | None) -> HotGroups | None:
    """Hot in either input, with the larger count."""
    if a is None or b is None:
        return a or b
    best: dict[tuple, Row] = {}
    for r in (*a.rows, *b.rows):
        k = tuple(r[c] for c in a.by)
        if k not in best or r["_n"] > best[k]["_n"]:
            best[k] = r
    return HotGroups(a.by, tuple(best.values()), a.schema, a.limit)


def mark_hot(df: DataFrame, hot: HotGroups, name: str = "_n") -> DataFrame:
    """Add the row count of the group where it is hot, null elsewhere. The list is short: see above."""
    keys = hot.frame(df.sparkSession)
    keys = keys.select(*[F.col(c).alias(f"_hot_{c}") for c in hot.by], F.col("_n").alias(name))
    cond = reduce(lambda x, y: x & y, [df[c].eqNullSafe(keys[f"_hot_{c}"]) for c in hot.by])
    return df.join(F.broadcast(keys), cond, "left").drop(*[f"_hot_{c}" for c in hot.by])


def split_hot(df: DataFrame, hot: HotGroups) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary groups, rows of hot groups)."""
    marked = mark_hot(df, hot, "_hot_n")
    return (marked.where(F.col("_hot_n").isNull()).drop("_hot_n"),
            marked.where(F.col("_hot_n").isNotNull()).drop("_hot_n"))


def spread(df: DataFrame) -> Column:
    """A number that differs between rows, and between equal rows of different partitions; a task that runs again gives
    the same one."""
    return F.xxhash64(*df.columns, F.spark_partition_id())


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                hot: HotGroups | None | str = AUTO, null_safe: bool = False) -> DataFrame:
    """Equi-join in which rows of a hot left key are spread and the right rows of that key copied.

    ``hot`` may be keyed by a subset of ``on``. For joins whose right side has few rows per key. With
    ``null_safe`` a null key matches a null key.
    """
    on = list(on)
    left, hot = resolve(left, on, hot)
    if hot is None:
        return _join(left, right, on, how, null_safe)
    parts = F.ceil(F.coalesce(F.col("_n"), F.lit(1)) / F.lit(float(hot.limit))).cast("long")
    lhs = mark_hot(left, hot).withColumn("_salt", F.pmod(spread(left), parts)).drop("_n")
    rhs = (mark_hot(right, hot)
           .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_n"))
    return _join(lhs, rhs, [*on, "_salt"], how, null_safe).drop("_salt")


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str, null_safe: bool) -> DataFrame:
    if not null_safe:
        return left.join(right, on, how)
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(right, cond, how).drop(*[f"_r_{c}" for c in on])
