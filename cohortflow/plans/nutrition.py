"""Feeding events, feeding class of a stay, enteral stretches, carbohydrate rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import paste, sum_strict
from ..functions.clock import add_clock
from ..functions.predicates import contains_any, is_in
from ..operators.groups import group_attach, keep_groups_all
from ..operators.intervals import expose, islands
from ..operators.skew import AUTO, HotGroups, salted_join
from ..sources import lookups as L
from ..sources.tables import lookup

STAY_COLUMNS = ("stay_id", "intime", "outtime", "los")


def input_events(inputs: DataFrame, items: DataFrame, cohort: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Input events of the listed items during the given stays, on the stay clock."""
    events = inputs.where(F.col("amount") > 0).join(items.select("itemid", "label", "category"), "itemid")
    events = salted_join(events, cohort.select(*STAY_COLUMNS), ["stay_id"], "inner", hot)
    return add_clock(events, {"starttime_seq": "starttime", "endtime_seq": "endtime",
                              "intime_seq": "intime", "outtime_seq": "outtime"}, "intime")


def is_feeding() -> Column:
    return contains_any(F.col("category"), ["nutrition"]) | F.coalesce(F.col("label") == L.ORAL_LABEL, F.lit(False))


def feeding_events(events: DataFrame, tie: Sequence[str] = ("itemid", "amount"),
                   hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Feeding events with the number of their gap-free stretch over **all** feeding of the stay."""
    return islands(events.where(is_feeding()), ["stay_id"], "starttime_seq", "endtime_seq", tie, "nut_intervalnr", hot)


def classify_stay(df: DataFrame, by: Sequence[str], category: str, classes: Sequence[tuple[str, str]] = L.FEEDING_CLASSES,
                  ignored: Sequence[str] = (L.SUPPLEMENTS,), mixed: str = L.COMBINED, name: str = "nutritiongroup",
                  hot: HotGroups | None | str = AUTO, mixed_when: Column | None = None) -> DataFrame:
    """Class of a group whose rows all carry one category; ``ignored`` fits every class, and the first
    class that fits wins. Other groups are ``mixed``. ``mixed_when`` is an extra condition a row must meet
    somewhere in the group for it to be mixed; without it such groups get null."""
    flags = {f"_all_{k}": is_in(F.col(category), [cat, *ignored]) for k, (_, cat) in enumerate(classes)}
    df = df.withColumns({f"{n}_row": c for n, c in flags.items()})
    aggs = {n: F.bool_and(f"{n}_row") for n in flags}
    if mixed_when is not None:
        df = df.withColumn("_mixed_row", F.coalesce(mixed_when, F.lit(False)))
        aggs["_mixed"] = F.bool_or("_mixed_row")
    df = group_attach(df, by, aggs, hot)
    expr = F.when(F.col("_all_0"), classes[0][0])
    for k, (label, _) in enumerate(classes[1:], start=1):
        expr = expr.when(F.col(f"_all_{k}"), label)
    expr = expr.otherwise(F.lit(mixed)) if mixed_when is None else expr.when(F.col("_mixed"), mixed)
    return df.withColumn(name, expr).drop(*[f"{n}_row" for n in flags], *flags, "_mixed_row", "_mixed")


def feeding_class(df: DataFrame, reference_compat: bool = False, hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Feeding class per stay. With ``reference_compat`` a stay is combined only if some order category is
    neither intake nor supplement, else its class is null."""
    extra = ~is_in(F.col("ordercategoryname"), [L.ORAL, L.SUPPLEMENTS]) if reference_compat else None
    return classify_stay(df, ["stay_id"], "category", hot=hot, mixed_when=extra)


def enteral_periods(df: DataFrame, hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Events of stays with enteral feeding that lie in a stretch without any other kind of feeding."""
    kept = df.where(F.col("nutritiongroup").isin(L.COMBINED, "Enteral feeding only"))
    kept = keep_groups_all(kept, ["stay_id", "nut_intervalnr"], is_in(F.col("category"), [L.ENTERAL, L.SUPPLEMENTS]), hot)
    return kept.withColumnsRenamed({
        "starttime": "starttime_nut", "endtime": "endtime_nut", "starttime_seq": "starttime_nut_seq",
        "endtime_seq": "endtime_nut_seq", "amount": "amount_nut", "label": "label_nut", "itemid": "itemid_nut",
    })


def factor_lookup(df: DataFrame) -> DataFrame:
    rows = [(item, factor) for _, ids, factor in L.NUTRITION_FACTORS for item in ids]
    return lookup(df.sparkSession, rows, "itemid_nut long, factor double")


def carbohydrate_rate(enteral: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Add rate_nut (mL/h) and rate_nut_cho (g/h); an unlisted product has an unknown rate."""
    factors = factor_lookup(enteral) if factors is None else factors
    rate = F.col("amount_nut") / (F.col("endtime_nut_seq") - F.col("starttime_nut_seq"))
    events = enteral.where(F.col("endtime_nut_seq") > F.col("starttime_nut_seq"))
    return (events.join(factors, "itemid_nut", "left").withColumn("rate_nut", rate)
            .withColumn("rate_nut_cho", F.col("rate_nut") * F.col("factor")).drop("factor"))


def feeding_exposure(points: DataFrame, enteral: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Measurements taken during enteral feeding, with the summed rate of all running feeds.

    A feed of unknown content makes the carbohydrate rate unknown; rows with an unknown or zero rate are
    still in the result (``feeding_known`` drops them).
    """
    feeds = carbohydrate_rate(enteral, factors)
    order = F.struct("starttime_nut_seq", "endtime_nut_seq", "itemid_nut")
    spans = feeds.select("stay_id", "starttime_nut_seq", "endtime_nut_seq", "rate_nut", "rate_nut_cho", "label_nut",
                         "itemid_nut")
    return expose(points, spans, ["stay_id"], "time_seq", "starttime_nut_seq", "endtime_nut_seq", {
        "rate_nut_cho": sum_strict(F.col("rate_nut_cho")),
        "rate_nut": sum_strict(F.col("rate_nut")),
        "label_nut": paste(F.col("label_nut"), order),
        "itemid_nut": paste(F.col("itemid_nut"), order),
        "starttime_nut_seq": F.min("starttime_nut_seq"),
        "endtime_nut_seq": F.max("endtime_nut_seq"),
    })


def feeding_known(df: DataFrame) -> DataFrame:
    """Rows with a known, non-zero carbohydrate rate."""
    return df.where(F.col("rate_nut_cho").isNotNull() & (F.col("rate_nut_cho") != 0))
