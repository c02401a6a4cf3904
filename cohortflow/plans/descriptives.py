"""Patient table, sampling density, time-of-day distributions, timelines, actogram data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import all_true, any_true
from ..functions.categories import cut, cut_labels, factor
from ..functions.clock import add_clock, clock_hour, icu_day
from ..functions.predicates import is_in
from ..operators.groups import center
from ..operators.intervals import hour_grid, hour_tasks, interval_hours
from ..operators.skew import AUTO, HotGroups
from ..operators.summaries import (describe_categorical, describe_table, flag_shares, freq, mean_ci, mean_sd,
                                   per_group_count_summary, share_within)
from ..session import cut as store
from ..sources import lookups as L
from .exposures import ventilation_class
from .nutrition import carbohydrate_rate

PATIENT_NUMERIC = ("los", "age", "oasis", "sofa")
PATIENT_CATEGORICAL = ("sex", "diabetes_status", "died_hospstay_yn", "admtype_cat", "race_cat")
SAMPLE_CATEGORICAL = ("ventilation_status_cat", "insu_yn", "dext_yn", "glucocorticoid_yn", "sample_type")


def patient_table(table: DataFrame) -> DataFrame:
    """Description of the stays behind the measurements."""
    one = table.select("stay_id", *PATIENT_NUMERIC, *PATIENT_CATEGORICAL).distinct()
    return describe_table(one, PATIENT_NUMERIC, PATIENT_CATEGORICAL)


def sample_table(table: DataFrame) -> DataFrame:
    return describe_categorical(table, SAMPLE_CATEGORICAL)


def icu_day_total(table: DataFrame) -> DataFrame:
    """Number of distinct (stay, day) pairs."""
    per_stay = table.groupBy("stay_id").agg(F.count_distinct("time_icudays").alias("days"))
    return per_stay.agg(F.sum("days").alias("total_icu_days"), F.count(F.lit(1)).alias("n_stays"))


def status_precedence(cat: Column) -> Column:
    """Strongest class a group ever had; no record at all is its own class. Other mixtures are null."""
    return (F.when(any_true(cat == "invasive"), "invasive")
            .when(any_true(cat == "noninvasive"), "non-invasive only")
            .when(all_true(cat == "none"), "none")
            .when(all_true(cat == L.NO_RECORD), L.NO_RECORD))


def stay_status(stays: DataFrame, ventilation: DataFrame) -> DataFrame:
    """Ventilation of each stay, stays without a record kept."""
    df = stays.select("stay_id").distinct().join(ventilation.select("stay_id", "ventilation_status"), "stay_id", "left")
    return (df.withColumn("_cat", ventilation_class()).groupBy("stay_id")
            .agg(status_precedence(F.col("_cat")).alias("ventilation_status_stay")))


def sampling_density(table: DataFrame, hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Quartiles of the number of measurements per stay and day."""
    return per_group_count_summary(table, ["stay_id", "time_icudays"], hot)


def hourly_counts(table: DataFrame) -> DataFrame:
    return freq(table, "time_hbin")


def hourly_share(table: DataFrame, flags: Sequence[str] = ("insu_yn", "dext_yn", "glucocorticoid_yn")) -> DataFrame:
    """Share of the measurements of each hour taken under each exposure."""
    return flag_shares(table, "time_hbin", flags)


def hourly_rate_mix(enteral: DataFrame, stays: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Mix of feeding-rate classes over the fed hours of each clock hour."""
    rates = carbohydrate_rate(enteral.join(stays.select("stay_id"), "stay_id", "left_semi"), factors)
    hours = interval_hours(rates.where(F.col("rate_nut_cho").isNotNull()), "starttime_nut_seq", "endtime_nut_seq",
                           "ceil", "intime_seq", "outtime_seq")
    labelled = hours.select(clock_hour(F.col("time_seq")).alias("time_dec"),
                            cut(F.col("rate_nut_cho"), L.CARBOHYDRATE_BREAKS, False).alias("rate_nut_cho_cat"))
    mix = share_within(labelled, "time_dec", "rate_nut_cho_cat")
    level = factor(F.col("rate_nut_cho_cat"), cut_labels(L.CARBOHYDRATE_BREAKS, False), L.CARBOHYDRATE_LABELS)
    return mix.withColumn("_l", level).select("time_dec", "rate_nut_cho_cat", F.col("_l.ord").alias("level_ord"),
                                              F.col("_l.label").alias("level_label"), "n", "prop")


TRACKS = {
    "feeding": ("starttime_nut_seq", "endtime_nut_seq"),
    "insulin": ("starttime_insu_seq_corr", "endtime_insu_seq_corr"),
    "dextrose": ("starttime_dext_seq", "endtime_dext_seq"),
    "glucocorticoids": ("cort_interval_starttime_seq", "cort_interval_endtime_seq"),
}


def timeline(table: DataFrame, lo: float, hi: float, stay_ids: Sequence[int] | None = None,
             measured: DataFrame | None = None) -> DataFrame:
    """Measurement times and exposure periods seen strictly between two hours: (stay, track, start, end).

    ``measured`` adds a track with all measurements, the unused ones too.
    """
    def window(df: DataFrame) -> DataFrame:
        df = df.where((F.col("time_seq") > lo) & (F.col("time_seq") < hi))
        return df if stay_ids is None else df.where(is_in(F.col("stay_id"), stay_ids))

    seen = window(table)
    tracks = {"glucose": ("time_seq", "time_seq"), **TRACKS}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("track"), F.col(a).cast("double").alias("track_start"),
                                        F.col(b).cast("double").alias("track_end")) for n, (a, b) in tracks.items()]))
    out = seen.select("stay_id", rows.alias("r")).select("stay_id", "r.*")
    if measured is not None:
        every = window(add_clock(measured, {"time_seq": "charttime"}, "intime"))
        out = out.unionByName(every.select("stay_id", F.lit("all glucose").alias("track"),
                                           F.col("time_seq").alias("track_start"), F.col("time_seq").alias("track_end")))
    return out.na.drop().distinct()


def day_hour_grid(enteral: DataFrame, stay_ids: Sequence[int] | None = None) -> DataFrame:
    """Per stay, day and fed/unfed: first and last clock hour. Several bouts in a day become one block."""
    df = enteral if stay_ids is None else enteral.where(is_in(F.col("stay_id"), stay_ids))
    bouts = df.groupBy("stay_id", "nut_intervalnr").agg(
        F.min("starttime_nut_seq").alias("start"), F.max("endtime_nut_seq").alias("end"),
        F.min("intime_seq").alias("intime_seq"), F.max("outtime_seq").alias("outtime_seq"))
    hours = interval_hours(bouts, "start", "end", "floor", "intime_seq", "outtime_seq")
    # only stays with a fed hour get a grid
    spans = df.groupBy("stay_id").agg(F.max("intime_seq").alias("lo"), F.max("outtime_seq").alias("hi"))
    spans = store(spans.join(hours.select("stay_id").distinct(), "stay_id", "left_semi"))
    # hours are few bytes and many rows: they are neither broadcast nor put into few tasks
    keys = ["stay_id", "time_seq"]
    tasks = hour_tasks(spans, F.abs(F.ceil("hi") - F.floor("lo")) + 1)
    fed = hours.repartition(tasks, *keys).groupBy(*keys).agg(F.lit("y").alias("feeding_yn"))
    grid = hour_grid(spans, "lo", "hi").repartition(tasks, *keys).join(fed.hint("merge"), keys, "left")
    grid = grid.select("stay_id", F.coalesce("feeding_yn", F.lit("n")).alias("feeding_yn"),
                       icu_day(F.col("time_seq")).alias("day"), clock_hour(F.col("time_seq")).alias("time_dec"))
    return grid.groupBy("stay_id", "day", "feeding_yn").agg(
        F.min("time_dec").alias("time_dec_start"), F.max(F.col("time_dec") + 1).alias("time_dec_end"))


def normalized_profile(table: DataFrame, value: str = "glucose_value_mmolL", ci: bool = False,
                       hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Mean deviation from the stay's own mean by hour."""
    centred = center(table, ["stay_id"], value, "value_bslcorr", hot)
    return (mean_ci if ci else mean_sd)(centred, "time_hbin", "value_bslcorr")
