"""The study's models: nested mixed models, subgroup refits, boosted trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.categories import cut_labels
from ..functions.predicates import is_in
from ..models import mixed
from ..models.mixed import Design, Fit, Statistics, Term
from ..operators.groups import group_attach
from ..operators.skew import AUTO, HotGroups
from ..operators.summaries import extreme_flag
from ..session import cut
from ..sources import lookups as L

RESPONSE = "glucose_value_mmolL"
GROUP = "stay_id"
HOUR = Term("time_hbin", tuple(range(24)))
PATIENT = (
    Term("diabetes_status", ("n", "y")),
    Term("age_cat", tuple(cut_labels(L.AGE_BREAKS))),
    Term("sex", ("F", "M")),
)
SAMPLE = (
    Term("rate_insu_cat", tuple(cut_labels(L.INSULIN_BREAKS))),
    Term("rate_dext_cat", tuple(cut_labels(L.DEXTROSE_BREAKS))),
    Term("glucocorticoid_yn", ("n", "y")),
    Term("rate_nut_cho_cat", tuple(cut_labels(L.CARBOHYDRATE_BREAKS))),
)
# Nested models: intercept only; patient terms; with sample terms; with hour of day.
MODELS: dict[str, tuple[Term, ...]] = {
    "model_1": (),
    "model_2": PATIENT,
    "model_3": (*PATIENT, *SAMPLE),
    "model_4": (HOUR, *PATIENT, *SAMPLE),
}
FINAL = MODELS["model_4"]


def analysis_rows(table: DataFrame) -> DataFrame:
    """The columns the models use."""
    return table.select(RESPONSE, GROUP, *[t.column for t in FINAL], "died_hospstay_yn", "ventilation_status_cat",
                        "time_icudays", "time_next_measurement", "sample_type", "ras_score", "unitsperday_insu")


def complete(rows: DataFrame) -> DataFrame:
    """Rows with all variables of the final model known; the nested models are fitted to these."""
    return Design(RESPONSE, GROUP, FINAL).complete(rows)


def nested_statistics(table: DataFrame) -> dict[str, Statistics]:
    """Statistics of the nested models over the same rows, those complete for the largest model, from one
    pass: the cells of the largest model hold those of the others."""
    cell = final_cells(table)
    return {name: Statistics(cell, Design(RESPONSE, GROUP, terms)) for name, terms in MODELS.items()}


def final_cells(table: DataFrame) -> DataFrame:
    rows = analysis_rows(table).withColumn("subgroup", F.lit(mixed.ALL))
    return cut(mixed.cells(rows, Design(RESPONSE, GROUP, FINAL)))


def requirement_class(df: DataFrame, hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Insulin need of a stay from its daily units."""
    df = group_attach(df, [GROUP], {"_max": F.max("unitsperday_insu"), "_mean": F.avg("unitsperday_insu")}, hot)
    mean = F.col("_mean")
    need = (F.when(F.col("_max") == 0, "no").when((mean > 0) & (mean <= 35), "0-35 units/day")
            .when((mean > 35) & (mean <= 70), "35-70 units/day").when(mean > 70, ">70 units/day"))
    return df.withColumn("insu_requirement", need).drop("_max", "_mean")


def subgroup_conditions() -> list[tuple[str, str, Column]]:
    """(family, subgroup, condition) of the eighteen refits."""
    vent, day, gap = F.col("ventilation_status_cat"), F.col("time_icudays"), F.col("time_next_measurement")
    died, ras, kind, need = F.col("died_hospstay_yn"), F.col("ras_score"), F.col("sample_type"), F.col("insu_requirement")
    return [
        ("ventilation", "Invasive", vent == "invasive"),
        ("ventilation", "Non-Invasive", vent == "noninvasive"),
        ("survival", "Non-survivors", died == "y"),
        ("survival", "Survivors", died == "n"),
        ("sedation", "RASS ≥ -1", ras > -2),
        ("sedation", "RASS ≤ -2", ras <= -2),
        ("sample type", "Point-of-care test", kind == "Fingerstick"),
        ("sample type", "Lab test", is_in(kind, ["Lab (serum)", "Lab (whole blood)"])),
        ("time in ICU", "Day 0-2", day <= 2),
        ("time in ICU", "Day 3-7", (day > 2) & (day <= 7)),
        ("time in ICU", "Day ≥ 8", day > 7),
        ("time to next", "< 4 hours", gap < 4),
        ("time to next", "4-8 hours", (gap >= 4) & (gap <= 8)),
        ("time to next", "> 8 hours", gap > 8),
        ("insulin need", "No insulin administration during ICU stay", need == "no"),
        ("insulin need", "Mean insulin administration of 0<x≤35 units/day over ICU stay", need == "0-35 units/day"),
        ("insulin need", "Mean insulin administration of 35<x≤70 units/day over ICU stay", need == "35-70 units/day"),
        ("insulin need", "Mean insulin administration of >70 units/day over ICU stay", need == ">70 units/day"),
    ]


SEPARATOR = " | "


def with_subgroups(table: DataFrame, hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Each row once per subgroup it is in (at most one per family), named ``family | subgroup``."""
    df = requirement_class(analysis_rows(table), hot)
    member = F.array_compact(F.array(*[F.when(c, f"{family}{SEPARATOR}{name}")
                                       for family, name, c in subgroup_conditions()]))
    return df.withColumn("subgroup", F.explode(member))


def subgroup_fits(table: DataFrame, terms: Sequence[Term] = FINAL, hot: HotGroups | None | str = AUTO) -> list[Fit]:
    """All refits from one grouped pass. A subgroup with too few rows for its terms gives no fit."""
    design = Design(RESPONSE, GROUP, tuple(terms))
    return mixed.fit_statistics(Statistics(cut(mixed.cells(with_subgroups(table, hot), design)), design))


def subgroup_sizes(table: DataFrame, hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Stays and rows per subgroup, and the rows a model with all terms can use."""
    usable = F.lit(True)
    for t in FINAL:
        usable = usable & is_in(F.col(t.column), list(t.levels))
    usable = usable & F.col(RESPONSE).isNotNull()
    return with_subgroups(table, hot).groupBy("subgroup").agg(
        F.count_distinct(GROUP).alias("npat"), F.count(F.lit(1)).alias("nmeas"), F.count_if(usable).alias("nmodel"))


def label_positions(means: DataFrame) -> DataFrame:
    """Mean marginal mean per subgroup and whether it is its family's highest or lowest."""
    split = F.split("subgroup", r" \| ", 2)
    df = means.withColumns({"family": split[0], "name": split[1]})
    return extreme_flag(df, ["name"], "emmean", ["family"])
