"""Interval joins, islands, periods and hour grids.

Intervals are matched half-open, ``(start, end]``. Times are doubles in hours.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .scan import Lag, Lead, MaxBefore, SumTo, scan
from .skew import AUTO, HotGroups

# Widths in hours of the time blocks: an interval goes to the narrowest width that is not below its length, so it meets
# at most two blocks unless it is longer than the widest one.
BLOCK_HOURS = (6.0, 96.0, 1536.0)
CELL_PAIRS = "spark.cohortflow.cellPairs"
DEFAULT_CELL_PAIRS = 20_000_000  # pairs of one block that one task compares
HOURS = 250_000  # hours that one task lists


def _inside(t: str, start: str, end: str) -> Column:
    return (F.col(t) > F.col(start)) & (F.col(t) <= F.col(end))


def interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], t: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and an interval of the same group with ``start < t <= end``.

    Always joins on (group, time block), so the work follows the length of the intervals, not the size of the group.
    Of a block with many points times intervals the points are spread over salts.
    """
    cells = [*by, "_tier", "_block"]
    # both sides are counted and joined: they are stored, so that what makes them runs once
    points = points.where(F.col(t).isNotNull())
    stored = cut(points.withColumn("_spread", F.xxhash64(*points.columns, F.monotonically_increasing_id())))
    intervals = cut(intervals.where(F.col(start) < F.col(end)).withColumn("_tier", _tier(start, end)))
    p, i = _blocked(stored, intervals, t, start, end)
    limit = float(points.sparkSession.conf.get(CELL_PAIRS, str(DEFAULT_CELL_PAIRS)))
    pairs = p.groupBy(*cells).agg(F.count(F.lit(1)).alias("_p")).join(
        i.groupBy(*cells).agg(F.count(F.lit(1)).alias("_i")), cells)
    parts = F.ceil(F.col("_p") * F.col("_i") / F.lit(limit))
    # no more rows than all pairs that are compared divided by the limit
    crowded = F.broadcast(pairs.where(F.col("_p") * F.col("_i") > limit).select(*cells, parts.alias("_parts")))
    n = F.coalesce("_parts", F.lit(1).cast("long"))
    p = p.join(crowded, cells, "left").withColumn("_salt", F.pmod(F.col("_spread"), n)).drop("_parts", "_spread")
    i = i.join(crowded, cells, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("_parts")
    return p.join(i, [*cells, "_salt"]).where(_inside(t, start, end)).drop("_tier", "_block", "_salt")


def _blocked(points: DataFrame, intervals: DataFrame, t: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Points in their block of every width that an interval has, intervals in the blocks of their own width."""
    used = sorted(r[0] for r in intervals.select("_tier").distinct().collect()) or [0]  # three rows at most
    at = F.array(*[F.struct(F.lit(k).alias("tier"), F.floor(F.col(t) / BLOCK_HOURS[k]).alias("block")) for k in used])
    p = points.withColumn("_cell", F.explode(at))
    width = F.element_at(F.array(*[F.lit(w) for w in BLOCK_HOURS]), F.col("_tier") + 1)
    i = intervals.withColumn("_block", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.select(*points.columns, F.col("_cell.tier").alias("_tier"), F.col("_cell.block").alias("_block")), i


def _tier(start: str, end: str) -> Column:
    """Number of the narrowest width that isn't below the interval's length, else of the widest."""
    out = F.lit(len(BLOCK_HOURS) - 1)
    for k in reversed(range(len(BLOCK_HOURS) - 1)):
        out = F.when(F.col(end) - F.col(start) <= BLOCK_HOURS[k], k).otherwise(out)
    return out


def exposure_at(points: DataFrame, intervals: DataFrame, by: Sequence[str], t: str, start: str, end: str,
                aggs: Mapping[str, Column]) -> DataFrame:
    """One row per (group, point time) with at least one active interval: ``aggs`` over those intervals."""
    keys = [*by, t]
    pairs = interval_join(points.select(*keys).distinct(), intervals, by, t, start, end)
    return pairs.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def expose(points: DataFrame, intervals: DataFrame, by: Sequence[str], t: str, start: str, end: str,
           aggs: Mapping[str, Column], how: str = "inner") -> DataFrame:
    """Points with aggregates over the intervals active at their time; ``how="left"`` keeps all points.

    (group, ``t``) has to be unique in ``points``. A point without an interval has null aggregates.
    """
    keys = [*by, t]
    named = [c.alias(n) for n, c in aggs.items()]
    found = interval_join(points.select(*keys), intervals, by, t, start, end).groupBy(*keys).agg(*named)
    return points.join(found, keys, how)


def attach(points: DataFrame, matched: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add the matched columns; points without a match stay with nulls."""
    return points.join(matched, list(on), "left")


def attach_intervals(points: DataFrame, intervals: DataFrame, by: Sequence[str], t: str, start: str, end: str) -> DataFrame:
    """Left join of points and the intervals active at their time; overlapping intervals repeat the point."""
    keys = [*by, t]
    return points.join(interval_join(points.select(*keys).distinct(), intervals, by, t, start, end), keys, "left")


def hull_match(points: DataFrame, intervals: DataFrame, by: Sequence[str], t: str, start: str, end: str,
               aggs: Mapping[str, Column]) -> DataFrame:
    """Hull (min start, max end) of the active intervals of each point, with ``aggs`` over the intervals
    that equal the hull. A hull no interval equals keeps null aggregates."""
    hulls = exposure_at(points, intervals, by, t, start, end, {f"_{start}": F.min(start), f"_{end}": F.max(end)})
    hulls = hulls.withColumnsRenamed({f"_{start}": start, f"_{end}": end})
    return (hulls.join(intervals, [*by, start, end], "left")
            .groupBy(*by, t, start, end).agg(*[c.alias(n) for n, c in aggs.items()]))


def islands(df: DataFrame, by: Sequence[str], start: str, end: str, tie: Sequence[str] = (),
            name: str = "island", hot: HotGroups | None | str = AUTO) -> DataFrame:
    """0-based number of the gap-free stretch an interval belongs to; touching intervals share one."""
    def fresh(d: DataFrame) -> DataFrame:
        return d.withColumn("_fresh", F.coalesce((F.col(start) > F.col("_reach")).cast("long"), F.lit(0)))

    order = list(dict.fromkeys([start, end, *tie]))
    return scan(df, by, order, {"_reach": MaxBefore(end)}, fresh, {name: SumTo("_fresh")},
                hot=hot).drop("_reach", "_fresh")


def merge_intervals(df: DataFrame, by: Sequence[str], start: str, end: str, tie: Sequence[str] = (),
                    hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Union of the intervals of each group: one row per merged interval, numbered from 1."""
    return (islands(df, by, start, end, tie, "interval_no", hot)
            .groupBy(*by, "interval_no").agg(F.min(start).alias(start), F.max(end).alias(end))
            .withColumn("interval_no", F.col("interval_no") + 1))


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "run",
         hot: HotGroups | None | str = AUTO) -> DataFrame:
    """1-based number of the run of equal neighbouring values."""
    def changed(d: DataFrame) -> DataFrame:
        # the first row has no previous value and starts run 1
        differs = ~F.col(value).eqNullSafe(F.col("_prev")) | F.col("_first").isNull()
        return d.withColumn("_new", differs.cast("long"))

    marked = df.withColumn("_one", F.lit(1))
    return scan(marked, by, order, {"_prev": Lag(value), "_first": Lag("_one")}, changed,
                {name: SumTo("_new")}, hot=hot).drop("_prev", "_first", "_one", "_new")


def points_to_periods(df: DataFrame, by: Sequence[str], t: str, last_end: str, tie: Sequence[str] = (),
                      start: str = "period_start", end: str = "period_end",
                      hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Each point lasts until the next one; the last until ``last_end``."""
    out = scan(df, by, [t, *tie], {end: Lead(t)}, hot=hot)
    return out.withColumns({start: F.col(t), end: F.coalesce(F.col(end), F.col(last_end))})


def neighbour_gaps(df: DataFrame, by: Sequence[str], t: str, tie: Sequence[str] = (),
                   before: str = "time_last_measurement", after: str = "time_next_measurement",
                   hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Time since the previous and to the next row of the group."""
    out = scan(df, by, [t, *tie], {before: Lag(t), after: Lead(t)}, hot=hot)
    return out.withColumns({before: F.col(t) - F.col(before), after: F.col(after) - F.col(t)})


def hour_grid(df: DataFrame, lo: str, hi: str, name: str = "time_seq") -> DataFrame:
    """One row per whole hour from floor(lo) to ceil(hi), both included."""
    first, last = F.floor(F.col(lo)), F.ceil(F.col(hi))
    return _dealt(df, F.abs(last - first) + 1).withColumn(name, F.explode(F.sequence(first, last)))


def interval_hours(df: DataFrame, start: str, end: str, lower: str = "ceil", lo: str | None = None,
                   hi: str | None = None, name: str = "time_seq") -> DataFrame:
    """Hours ``h`` with lower(start) <= h < ceil(end), cut to the grid floor(lo)..ceil(hi).

    This is the join of an hour grid with the intervals, done by listing each interval's own hours.
    """
    first = {"ceil": F.ceil, "floor": F.floor}[lower](F.col(start))
    last = F.ceil(F.col(end)) - 1
    if lo is not None:
        first = F.greatest(first, F.floor(F.col(lo)))
    if hi is not None:
        last = F.least(last, F.ceil(F.col(hi)))
    df = df.withColumns({"_first": first, "_last": last}).where(F.col("_first") <= F.col("_last"))
    return (_dealt(df, F.col("_last") - F.col("_first") + 1)
            .withColumn(name, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last"))


def _dealt(df: DataFrame, hours: Column) -> DataFrame:
    """The rows, stored and dealt over tasks by the hours that they become: the few bytes they are themselves would put them
    into one task."""
    df = cut(df)
    return df.repartition(hour_tasks(df, hours))


def hour_tasks(df: DataFrame, hours: Column) -> int:
    """Over how many tasks rows are dealt that become so many hours each."""
    total = df.agg(F.sum(hours)).first()[0] or 0
    return max(1, -(-int(total) // HOURS))


def order_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """(smaller, larger); null if either is missing."""
    return F.when(a > b, b).otherwise(a), F.when(a > b, a).otherwise(b)


def semi_interval(points: DataFrame, intervals: DataFrame, by: Sequence[str], t: str, start: str, end: str) -> DataFrame:
    """Points inside at least one interval."""
    keys = [*by, t]
    inside = interval_join(points.select(*keys).distinct(), intervals.select(*by, start, end), by, t, start, end)
    return points.join(inside.select(*keys).distinct(), keys, "left_semi")
