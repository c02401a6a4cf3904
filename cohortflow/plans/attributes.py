"""Facts about a stay: demographics, scores, diagnoses. One row per stay, joined to measurements once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.categories import cut, first_part, map_values
from ..functions.clock import age_at, days_between
from ..functions.predicates import has_prefix, is_in
from ..operators.summaries import top_columns_by_sum
from ..sources import lookups as L

CHARLSON_KEYS = ("subject_id", "hadm_id", "age_score", "charlson_comorbidity_index")


def race_category(c: Column) -> Column:
    """Group of the first part of the recorded ethnicity; other texts pass through."""
    part = first_part(c)
    return map_values(part, L.RACE_GROUPS, part)


def admission_category(c: Column) -> Column:
    return map_values(c, L.ADMISSION_GROUPS)


def died_in_hospital(dod: Column, discharge: Column, location: Column) -> Column:
    """Death on or before the discharge day, or discharge to a hospice or as dead."""
    died = (days_between(F.to_date(discharge), F.to_date(dod)) <= 0) | is_in(location, L.DEATH_DISCHARGES)
    return F.when(died, "y").otherwise("n")


def has_code(df: DataFrame, codes: DataFrame, on: str, code: str, prefixes: Sequence[str], name: str) -> DataFrame:
    """Flag (y/n) for a key with at least one code under the prefixes."""
    hits = codes.where(has_prefix(F.col(code), prefixes)).select(on).distinct().withColumn("_hit", F.lit(True))
    return df.join(hits, on, "left").withColumn(name, F.when(F.col("_hit"), "y").otherwise("n")).drop("_hit")


def merged_flags(scores: DataFrame) -> DataFrame:
    """The two diabetes flags as one."""
    both = F.when((F.col("diabetes_without_cc") == 1) | (F.col("diabetes_with_cc") == 1), 1)
    known = F.col("diabetes_without_cc").isNotNull() & F.col("diabetes_with_cc").isNotNull()
    return (scores.withColumn("diabetes_charlson", both.when(known, 0))
            .drop("diabetes_without_cc", "diabetes_with_cc"))


def top_flags(scores: DataFrame, included: DataFrame, k: int = 5) -> DataFrame:
    """(name, total) of the most frequent comorbidity flags among the included admissions."""
    flags = merged_flags(scores.join(included.select("hadm_id").distinct(), "hadm_id", "left_semi"))
    return top_columns_by_sum(flags, [c for c in flags.columns if c not in CHARLSON_KEYS], k)


def attach_top_flags(df: DataFrame, scores: DataFrame, included: DataFrame, k: int = 5) -> DataFrame:
    """Join the ``k`` commonest flags and the index. The names, ``k`` strings, are the only rows collected."""
    names = [r["name"] for r in top_flags(scores, included, k).collect()]
    return df.join(merged_flags(scores).select("hadm_id", *names, "charlson_comorbidity_index"), "hadm_id", "left")


def stay_attributes(stays: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """All stay-level facts but the comorbidity flags."""
    adm = tables["admissions"].select(
        "hadm_id", "dischtime", "discharge_location", race_category(F.col("race")).alias("race_cat"),
        admission_category(F.col("admission_type")).alias("admtype_cat"))
    people = tables["patients"].select("subject_id", F.col("gender").alias("sex"), "anchor_age", "anchor_year", "dod")
    df = (stays.select("subject_id", "hadm_id", "stay_id", "intime").join(people, "subject_id", "left")
          .join(adm, "hadm_id", "left")
          .withColumns({
              "age": age_at(F.col("intime"), F.col("anchor_year"), F.col("anchor_age")),
              "died_hospstay_yn": died_in_hospital(F.col("dod"), F.col("dischtime"), F.col("discharge_location")),
          })
          .drop("anchor_age", "anchor_year", "dischtime", "discharge_location", "intime"))
    df = has_code(df, tables["diagnoses_icd"], "hadm_id", "icd_code", L.DIABETES_PREFIXES, "diabetes_status")
    return (df.join(tables["first_day_sofa"].select("stay_id", "sofa"), "stay_id", "left")
            .join(tables["oasis"].select("stay_id", "oasis"), "stay_id", "left"))


def categorise(df: DataFrame) -> DataFrame:
    """Category columns of age and the three rates."""
    return df.withColumns({
        "age_cat": cut(F.col("age"), L.AGE_BREAKS),
        "rate_dext_cat": cut(F.col("rate_dext"), L.DEXTROSE_BREAKS),
        "rate_insu_cat": cut(F.col("rate_insu"), L.INSULIN_BREAKS),
        "rate_nut_cho_cat": cut(F.col("rate_nut_cho"), L.CARBOHYDRATE_BREAKS),
    })
