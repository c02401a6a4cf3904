"""Null rules, clock arithmetic, bins, predicates on the edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortflow.functions import clock, predicates
from cohortflow.functions.aggregates import all_true, any_true, max_strict, mean_strict, min_strict, paste, rmse, sum_strict
from cohortflow.functions.categories import cut, cut_labels, factor, first_part, map_values, observed_levels, relevel
from cohortflow.operators import groups, intervals, summaries
from cohortflow.sources import lookups as L
from conftest import rows


def one(df):
    return tuple(df.collect()[0])


def test_strict_aggregates(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 1.0), (2, 3.0)], "g int, x double").groupBy("g")
    x = F.col("x")
    got = {r[0]: tuple(r[1:]) for r in df.agg(sum_strict(x), mean_strict(x), min_strict(x), max_strict(x)).collect()}
    assert got == {1: (None,) * 4, 2: (4.0, 2.0, 1.0, 3.0)}


def test_masked_strict_sum(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("b", 1.0)], "k string, x double")
    got = one(df.agg(*[sum_strict(F.col("x"), F.col("k") == k) for k in "abc"]))
    assert got == (3.0, None, None)


def test_paste(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (0, "z")], "o int, v string")
    assert one(df.agg(paste(F.col("v"), F.col("o")))) == ("z_a_NA",)
    assert one(df.agg(paste(F.col("v"), F.col("o"), on=F.col("o") > 0), paste(F.col("v"), F.col("o"), on=F.col("o") > 9))) == ("a_NA", None)


def test_all_and_any_with_null(spark):
    df = spark.createDataFrame([("Enteral",), (None,)], "c string")
    cond = F.col("c") == "Enteral"
    assert one(df.agg(all_true(cond), any_true(cond))) == (False, True)


def test_membership_and_text(spark):
    df = spark.createDataFrame([("MethylPREDNISolone",), ("Prednisone *STUDY*",), (None,)], "m string")
    m = F.col("m")
    got = df.select(predicates.is_in(m, ["x"]), predicates.contains_any(m, L.GLUCOCORTICOIDS),
                    predicates.exclude_any(m, L.STUDY_WORDS)).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (False, True, False), (False, False, True)]


def test_code_prefixes(spark):
    assert len(L.DIABETES_PREFIXES) == 60
    df = spark.createDataFrame([("E101",), ("25000",), ("E15",), ("XE101",), (None,)], "c string")
    assert [r[0] for r in df.select(predicates.has_prefix(F.col("c"), L.DIABETES_PREFIXES)).collect()] == [
        True, True, False, False, False]


def test_overlap_cases(spark):
    cases = {(0, 5, 5, 9): False, (5, 6, 5, 9): True, (9, 12, 5, 9): False, (0, 20, 5, 9): True, (6, 7, 5, 9): True}
    df = spark.createDataFrame([k for k in cases], "a int, b int, lo int, hi int")
    got = df.select("*", predicates.overlaps(*[F.col(c) for c in ("a", "b", "lo", "hi")]).alias("o")).collect()
    assert {tuple(r)[:4]: r["o"] for r in got} == cases


def test_clock(spark):
    a, b = dt.datetime(2024, 1, 2, 3, 30), dt.datetime(2024, 1, 1, 22, 30)
    df = spark.createDataFrame([(a, b)], "intime timestamp_ntz, t timestamp_ntz")
    df = clock.measurement_clock(df, "t", "intime")
    r = df.select("time_seq", "time_dec", "time_hbin", "time_icudays", clock.clock_hour(F.col("time_seq")).alias("h")).collect()[0]
    assert tuple(r) == (-1.5, 22.5, 22, -1, 22.5)


def test_age(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 5, 1), 2010, 50)], "t timestamp_ntz, y int, a int")
    assert one(df.select(clock.age_at(F.col("t"), F.col("y"), F.col("a")))) == (64,)


def test_cut(spark):
    df = spark.createDataFrame([(x,) for x in (55.0, 55.1, 75.0, 75.1, None)], "x double")
    assert [r[0] for r in df.select(cut(F.col("x"), L.AGE_BREAKS)).collect()] == [
        "[-Inf,55]", "(55,65]", "(65,75]", "(75, Inf]", None]
    assert cut_labels(L.CARBOHYDRATE_BREAKS, False) == ["(-Inf,4.5]", "(4.5,6.5]", "(6.5,8.5]", "(8.5, Inf]"]


def test_cut_finite_lowest(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.5,)], "x double")
    assert [r[0] for r in df.select(cut(F.col("x"), (0, 1, 2))).collect()] == ["[0,1]", "[0,1]", None]
    assert [r[0] for r in df.select(cut(F.col("x"), (0, 1, 2), False)).collect()] == [None, "(0,1]", None]


def test_value_maps(spark):
    df = spark.createDataFrame([("WHITE - RUSSIAN",), ("ASIAN",), ("MARTIAN - X",), (None,)], "r string")
    part = first_part(F.col("r"))
    assert [r[0] for r in df.select(map_values(part, L.RACE_GROUPS, part)).collect()] == ["White", "Asian", "MARTIAN", None]
    level = factor(part, ["ASIAN", "WHITE"], ["A", "W"])
    assert [r[0] and tuple(r[0]) for r in df.select(level).collect()] == [(1, "W"), (0, "A"), None, None]
    assert observed_levels(df, "r") == ["ASIAN", "MARTIAN - X", "WHITE - RUSSIAN"]
    assert relevel(["a", "b", "c"], "b") == ["b", "a", "c"]


def test_quantiles(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0, None)], "x double")
    assert one(summaries.quantiles(df, "x", (0, 0.25, 0.5, 0.75, 1))) == (1.0, 1.75, 2.5, 4.75, 10.0)


def test_rmse(spark):
    assert one(spark.createDataFrame([(3.0,), (4.0,)], "e double").agg(rmse(F.col("e")))) == (12.5 ** 0.5,)


def test_group_min_keeps_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 7, "c"), (2, None, "d")], "g int, t int, x string")
    assert [r["x"] for r in groups.keep_group_min(df, ["g"], "t").orderBy("x").collect()] == ["a", "b"]


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(200)
    a, b = (rows(groups.sample_n(df.repartition(k), 50, ["id"], 7)) for k in (2, 5))
    assert len(a) == 50 and a == b
    assert rows(groups.sample_n(df, 50, ["id"], 8)) != a


def test_shares_sum_to_one(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("h"), (F.col("id") % 4).alias("c"))
    total = summaries.share_within(df, "h", "c").groupBy("h").agg(F.sum("prop").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in total)


def test_histogram_bins_are_centred(spark):
    df = spark.createDataFrame([(-0.25,), (0.24,), (0.25,), (None,)], "x double")
    assert rows(summaries.histogram(df, "x", 0.5)) == [(0.0, 2), (0.5, 1)]


def test_top_columns(spark):
    df = spark.createDataFrame([(1, 5, 1, None), (1, 0, 1, 9)], "a int, b int, c int, d int")
    assert [r["name"] for r in summaries.top_columns_by_sum(df, ["a", "b", "c", "d"], 3).collect()] == ["b", "a", "c"]


def test_mean_ci(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 4.0)], "h int, x double")
    r = summaries.mean_ci(df, "h", "x").collect()[0]
    assert r["upper"] - r["mean"] == pytest.approx(3.182446305 * r["se"], rel=1e-8)


def test_extreme_flag(spark):
    df = spark.createDataFrame([("f", "a", 1.0), ("f", "b", 2.0), ("f", "c", 3.0)], "fam string, s string, m double")
    got = {r["s"]: r["position"] for r in summaries.extreme_flag(df, ["s"], "m", ["fam"]).collect()}
    assert got == {"a": "min", "b": "mid", "c": "max"}


def test_islands_touching(spark):
    df = spark.createDataFrame([(0.0, 5.0), (1.0, 2.0), (5.0, 6.0), (7.0, 8.0), (7.5, 9.0)], "s double, e double")
    got = intervals.islands(df.withColumn("g", F.lit(1)), ["g"], "s", "e").orderBy("s").collect()
    assert [r["island"] for r in got] == [0, 0, 0, 1, 1]


def test_interval_ends(spark):
    p = spark.createDataFrame([(1, t) for t in (2.0, 2.1, 4.0, 4.1)], "g int, t double")
    i = spark.createDataFrame([(1, 2.0, 4.0), (1, 3.0, 3.0)], "g int, s double, e double")
    assert sorted(r["t"] for r in intervals.interval_join(p, i, ["g"], "t", "s", "e").collect()) == [2.1, 4.0]


def test_runs_and_periods(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate((-1.0, -1.0, 0.0, 0.0, -1.0))], "g int, t int, v double")
    assert [r["run"] for r in intervals.runs(df, ["g"], ["t"], "v").orderBy("t").collect()] == [1, 1, 2, 2, 3]
    out = intervals.points_to_periods(df.withColumn("out", F.lit(9)), ["g"], "t", "out").orderBy("t").collect()
    assert [r["period_end"] for r in out] == [1, 2, 3, 4, 9]


def test_runs_with_null_values(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate((None, None, 1.0, None))], "g int, t int, v double")
    assert [r["run"] for r in intervals.runs(df, ["g"], ["t"], "v").orderBy("t").collect()] == [1, 1, 2, 3]


def test_hour_lists(spark):
    df = spark.createDataFrame([(2.5, 4.2)], "s double, e double")
    hours = {m: [r["time_seq"] for r in intervals.interval_hours(df, "s", "e", m).collect()] for m in ("ceil", "floor")}
    assert hours == {"ceil": [3, 4], "floor": [2, 3, 4]}
    assert [r["time_seq"] for r in intervals.hour_grid(df, "s", "e").collect()] == [2, 3, 4, 5]


def test_merge_is_idempotent(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("g"), (F.col("id") * 17 % 71).cast("double").alias("s"))
    df = df.withColumn("e", F.col("s") + 3)
    once = intervals.merge_intervals(df, ["g"], "s", "e")
    assert rows(intervals.merge_intervals(once.drop("interval_no"), ["g"], "s", "e")) == rows(once)
    covered = intervals.interval_hours(df, "s", "e", "floor").select("g", "time_seq").distinct().count()
    assert once.agg(F.sum(F.col("e") - F.col("s"))).collect()[0][0] == covered


def test_t_quantile_column_equals_its_tail(spark):
    """Few degrees of freedom from the series, many from the expansion, none below one."""
    from cohortflow.functions.aggregates import T_SERIES, t_quantile
    from cohortflow.models import tails

    known = [1, 2, 3, 4, 7, 30, 31, T_SERIES - 1, T_SERIES, T_SERIES + 1, 1000, 10**9]
    df = spark.createDataFrame([(k,) for k in [0, *known]] + [(None,)], "k long")
    for level in (0.5, 0.95, 0.999):
        got = {r["k"]: r["t"] for r in df.select("k", t_quantile(F.col("k"), level).alias("t")).collect()}
        assert got[0] is None and got[None] is None
        for k in known:
            assert got[k] == pytest.approx(tails.t_quantile((1 + level) / 2, k), rel=1e-8)


def test_prefixes_of_several_lengths(spark):
    codes = ["250", "2501", "25", "E10", "E101", "xE10", "", None, "E1"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    from cohortflow.functions.predicates import has_prefix

    for prefixes in (["2501", "E10"], ["25", "250", "E101"], [], [""]):
        got = [r[0] for r in df.select(has_prefix(F.col("c"), prefixes)).collect()]
        assert got == [c is not None and any(c.startswith(p) for p in prefixes) for c in codes]
