"""Split work on hot groups gives the rows of the plain plan."""

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import groups, intervals, summaries
from cohortflow.operators.skew import HotGroups, hot_groups, salted_join
from cohortflow.plans import descriptives
from cohortflow.session import cut
from conftest import rows

N = 900


@pytest.fixture(scope="module")
def points(spark):
    """A third of the rows are in group 0; its busiest hour alone holds many."""
    i = F.col("id")
    g = F.when(i % 3 == 0, 0).when(i % 3 == 1, i % 40 + 1).otherwise(i % 7 + 41)
    t = F.when(i % 6 == 0, (i % 90) / 90.0 + 100).otherwise((i * 37 % 4001) / 10.0)
    return spark.range(N).select(g.alias("g"), t.cast("double").alias("t"), i.alias("event"),
                                 F.when(i % 13 != 0, (i % 4).cast("double")).alias("v"))


@pytest.fixture(scope="module")
def spans(spark):
    """Short, long and very long intervals, a third of them in group 0."""
    i = F.col("id")
    g = F.when(i % 3 == 0, 0).otherwise(i % 47)
    s = (i * 53 % 3989) / 10.0
    length = F.when(i % 50 == 0, 20000.0).when(i % 9 == 0, 300.0).otherwise((i % 40) / 2.0)
    return spark.range(400).select(g.alias("g"), s.alias("s"), (s + length).alias("e"), i.alias("span"))


def both(hot, make, limit=25):
    cold = rows(make())
    with hot(limit):
        warm = rows(make())
    assert cold
    assert warm == cold


def test_detection_is_exact_and_bounded(points, hot):
    assert hot_groups(points, ["g"]) is None
    with hot(25):
        found = hot_groups(points, ["g"])
    assert isinstance(found, HotGroups)
    counts = {r["g"]: r["count"] for r in points.groupBy("g").count().collect()}
    assert {r["g"]: r["_n"] for r in found.rows} == {g: n for g, n in counts.items() if n > 25}
    assert max(found.rows, key=lambda r: r["_n"])["_n"] == N // 3


def test_interval_join(points, spans, hot):
    both(hot, lambda: intervals.interval_join(points, spans, ["g"], "t", "s", "e").select("event", "span"))


def test_interval_join_matches_brute_force(points, spans, hot):
    p, s = points.collect(), spans.collect()
    want = sorted((a["event"], b["span"]) for a in p for b in s if a["g"] == b["g"] and b["s"] < a["t"] <= b["e"])
    with hot(10):
        got = intervals.interval_join(points, spans, ["g"], "t", "s", "e").select("event", "span").collect()
    assert sorted(map(tuple, got)) == want


def test_semi_interval(points, spans, hot):
    both(hot, lambda: intervals.semi_interval(points, spans, ["g"], "t", "s", "e"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_expose(points, spans, hot, how):
    one = groups.first_per_key(points, ["g", "t"], ["event"])
    aggs = {"n": F.count("span"), "lo": F.min("s"), "hi": F.max("e")}

    def make():
        out = intervals.expose(one, spans, ["g"], "t", "s", "e", aggs, how)
        return out.withColumn("n", F.coalesce("n", F.lit(0)))
    both(hot, make)


def test_attach_intervals(points, spans, hot):
    both(hot, lambda: intervals.attach_intervals(points, spans, ["g"], "t", "s", "e").select("event", "span"))


def test_islands(spans, hot):
    both(hot, lambda: intervals.islands(spans, ["g"], "s", "e", ["span"]))


def test_merge(spans, hot):
    both(hot, lambda: intervals.merge_intervals(spans, ["g"], "s", "e", ["span"]))


def test_runs(points, hot):
    both(hot, lambda: intervals.runs(points, ["g"], ["t", "event"], "v"))


def test_periods(points, hot):
    both(hot, lambda: intervals.points_to_periods(points.withColumn("last", F.lit(999.0)), ["g"], "t", "last", ["event"]))


def test_gaps(points, hot):
    both(hot, lambda: intervals.neighbour_gaps(points, ["g"], "t", ["event"]))


def test_scan_with_null_group(points, hot):
    some = points.withColumn("g", F.when(F.col("g") != 0, F.col("g")))
    both(hot, lambda: intervals.neighbour_gaps(some, ["g"], "t", ["event"]))


def test_group_attach(points, hot):
    both(hot, lambda: groups.group_attach(points, ["g"], {"n": F.count("v"), "top": F.max("t")}))


def test_group_attach_null_group(points, hot):
    some = points.withColumn("g", F.when(F.col("g") != 0, F.col("g")))
    both(hot, lambda: groups.group_attach(some, ["g"], {"n": F.count("v"), "top": F.max("t")}))


def test_paste_groups(points, hot):
    """Order with many ties and nulls, a null group, and texts that hold the separator."""
    some = points.select(F.when(F.col("g") != 0, F.col("g")).alias("g"), F.when(F.col("t") > 20, F.col("t")).alias("t"),
                         F.concat(F.col("v").cast("string"), F.lit("_")).alias("x"))
    both(hot, lambda: groups.paste_groups(some, ["g"], "x", ["t"], "all"))
    both(hot, lambda: groups.paste_groups(points, ["g"], "v", ["t", "event"], "all", sep=""))


def test_keep_groups_all(points, hot):
    both(hot, lambda: groups.keep_groups_all(points, ["g"], F.col("t") < 400.05))


def test_quantiles(points, hot):
    def make():
        return summaries.quantiles(points, "t", (0, 0.25, 0.33, 0.5, 0.75, 1)).select(
            *[F.round(F.col(c), 9).alias(c) for c in ("q000", "q025", "q033", "q050", "q075", "q100")])
    both(hot, make)


def test_grouped_quantiles(points, hot):
    def make():
        return summaries.quantiles(points, "v", (0.25, 0.5), ["g"])
    both(hot, make)


def test_salted_join(points, spark, hot):
    dim = spark.range(60).select(F.col("id").alias("g"), (F.col("id") * 2).alias("x"))
    both(hot, lambda: salted_join(points, dim, ["g"], "left"))
    both(hot, lambda: salted_join(points, dim, ["g"], "inner"))


def test_one_stay_with_many_points_and_intervals(spark):
    """Work follows the length of the intervals: 20,000 by 20,000 in one stay meet in blocks, not all with all."""
    n = 20_000
    p = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") / 4.0 + 0.1).alias("t"), F.col("id").alias("event"))
    i = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") / 4.0).alias("s"), (F.col("id") / 4.0 + 1).alias("e"))
    out = intervals.interval_join(p, i, ["g"], "t", "s", "e")
    assert out.count() == 4 * n - 6
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()


def test_hours_are_listed_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "HOURS", 100, raising=False)
    stays = spark.createDataFrame([(k, float(k), k + 23.5) for k in range(40)] + [(None, 1.0, 2.0), (99, None, 3.0), (98, 3.0, 1.0)],
                                  "stay_id long, lo double, hi double").coalesce(1)
    for listed in (intervals.hour_grid(stays, "lo", "hi"), intervals.interval_hours(stays, "lo", "hi", "floor", "lo", "hi")):
        found = listed.select("stay_id", "time_seq", F.spark_partition_id().alias("task")).collect()
        assert len({r["task"] for r in found}) > 5
        for k in range(40):
            hours = sorted(r["time_seq"] for r in found if r["stay_id"] == k)
            assert hours in (list(range(k, k + 25)), list(range(k, k + 24)))
        assert not any(r["stay_id"] == 99 for r in found)


def test_day_hour_grid_broadcasts_no_hours(spark, monkeypatch):
    monkeypatch.setattr(intervals, "HOURS", 50, raising=False)
    bouts = spark.createDataFrame([(s, b, 24.0 * b + 3, 24.0 * b + 5.5 + s % 2, 1.0, 70.0) for s in range(12) for b in range(3)] + [(50, 0, 5.0, 5.0, 1.0, 9.0)],
                                  "stay_id long, nut_intervalnr long, starttime_nut_seq double, endtime_nut_seq double, intime_seq double, outtime_seq double")
    grid = descriptives.day_hour_grid(cut(bouts))
    want = set()
    for s in range(12):
        for day in range(3):
            hours = range(max(1, 24 * day), min(70, 24 * day + 23) + 1)
            fed = [h for h in hours if 24 * day + 3 <= h < 24 * day + 6 + s % 2]
            for yn, own in (("y", fed), ("n", [h for h in hours if h not in fed])):
                want.add((s, yn, day, float(own[0] % 24), float(own[-1] % 24 + 1)))
    assert {tuple(r) for r in grid.select("stay_id", "feeding_yn", "day", "time_dec_start", "time_dec_end").collect()} == want
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert not any("BroadcastHashJoin" in line and "time_seq" in line for line in plan.splitlines())
