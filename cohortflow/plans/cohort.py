"""Which stays are in, and how many were left at each step."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.groups import keep_group_min


def select_cohort(stays: DataFrame, min_los: float = 4.0) -> DataFrame:
    """The earliest long-enough stay of each subject; stays tied on admission time are all kept."""
    return keep_group_min(stays.where(F.col("los") >= min_los), ["subject_id"], "intime")


def counter_table(df: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
    """Several counts of one frame in one pass, as rows (metric, value)."""
    one = df.agg(*[c.cast("long").alias(n) for n, c in counters.items()])
    return one.unpivot([], list(counters), "metric", "value")


def subject_flow(stays: DataFrame, cohort: DataFrame, measured: DataFrame, fed: DataFrame,
                 min_los: float = 4.0) -> DataFrame:
    """(metric, value) for stays and subjects at each selection step.

    Each step becomes a flag on the stay, so every count comes from one aggregate over the stays.
    """
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("stay_id").distinct().withColumn(name, F.lit(True))

    marked = (stays.select("stay_id", "subject_id", (F.col("los") >= min_los).alias("long"))
              .join(flag(cohort, "first"), "stay_id", "left")
              .join(flag(measured, "measured"), "stay_id", "left")
              .join(flag(fed, "fed"), "stay_id", "left"))
    n = F.count(F.lit(1))

    def stays_where(*flags: str) -> Column:
        return F.count_if(_all(flags))

    def subjects_where(*flags: str) -> Column:
        return F.count_distinct(F.when(_all(flags), F.col("subject_id")))

    all_subjects = F.count_distinct("subject_id")
    return counter_table(marked, {
        "total_icustays_all": n,
        "total_patients_all": all_subjects,
        "total_incl_icustays_los": stays_where("long"),
        "total_incl_patients_los": subjects_where("long"),
        "total_excl_icustays_los": n - stays_where("long"),
        "total_excl_patients_los": all_subjects - subjects_where("long"),
        "total_incl_icustays_readm": stays_where("first"),
        "total_incl_patients_readm": subjects_where("first"),
        "total_excl_icustays_readm": stays_where("long") - stays_where("first"),
        "total_excl_patients_readm": subjects_where("long") - subjects_where("first"),
        "total_incl_icustays_entfeed": stays_where("first", "fed"),
        "total_excl_icustays_noentfeed": stays_where("first") - stays_where("first", "fed"),
        "total_incl_icustays_glucm": stays_where("first", "measured"),
        "total_excl_icustays_noglucm": stays_where("first") - stays_where("first", "measured"),
        "total_final_included_icustays": stays_where("first", "measured", "fed"),
    })


def _all(flags: tuple[str, ...]) -> Column:
    cond = F.lit(True)
    for f in flags:
        cond = cond & F.coalesce(F.col(f), F.lit(False))
    return cond


def measurement_flow(raw: DataFrame, valid: DataFrame, exposed: DataFrame, fed_stays: DataFrame, invalid: Column,
                     key: tuple[str, ...] = ("subject_id", "stay_id", "charttime")) -> DataFrame:
    """(metric, value) for measurements: raw, duplicate, invalid, valid, outside and during feeding, missing or zero
    rate, final, and the stays that are lost with those outside.

    Invalid rows are counted before duplicates go, so the counts need not add up. Rows are counted per key or stay first,
    so that distinct counts see one row for each.
    """
    rate = F.col("rate_nut_cho")
    used = F.coalesce(rate != 0, F.lit(False))
    n = F.count(F.lit(1))
    keys = raw.groupBy(*key).agg(n.alias("n"), F.count_if(F.coalesce(invalid, F.lit(False))).alias("bad"))
    per_stay = exposed.groupBy("stay_id").agg(
        n.alias("n"), F.count_if(rate.isNull()).alias("missing"),
        F.count_if(F.coalesce(rate == 0, F.lit(False))).alias("zero"), F.count_if(used).alias("used"))
    outside, lost = "total_outside_feeding_glucose_m", "total_outside_feeding_glucose_m_patients"
    parts = [
        counter_table(keys, {
            "total_glucose_m": F.sum("n"),
            "total_glucose_m_patients": F.count_distinct("stay_id"),
            "total_duplicates_glucose_m": F.sum("n") - n,
            "total_invalid_glucose_m": F.sum("bad"),
        }),
        counter_table(valid.groupBy("stay_id").agg(n.alias("n")), {
            "total_valid_glucose_m": F.sum("n"), "total_valid_glucose_m_icustays": n, outside: F.sum("n")}),
        counter_table(per_stay, {
            "total_during_feeding_glucose_m": F.sum("n"),
            "total_missing_cho_glucose_m": F.sum("missing"),
            "total_zero_cho_glucose_m": F.sum("zero"),
            "total_final_glucose_m": F.sum("used"),
            "total_final_glucose_m_patients": F.count_if(F.col("used") > 0),
            outside: -F.sum("n"), lost: -F.count_if(F.col("used") > 0),
        }),
        counter_table(fed_stays, {lost: n}),
    ]
    rows = functools.reduce(DataFrame.unionByName, parts)
    return rows.groupBy("metric").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
