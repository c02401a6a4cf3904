"""Dextrose, insulin, sedation, ventilation and glucocorticoids at the time of a measurement."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import paste, sum_strict
from ..functions.categories import map_values
from ..functions.clock import add_clock, hours_between, icu_day, midnight
from ..functions.predicates import contains_any, exclude_any, is_in, overlaps, within
from ..operators.groups import first_per_key
from ..operators.intervals import attach, attach_intervals, expose, hull_match, merge_intervals, order_pair
from ..operators.intervals import points_to_periods, runs
from ..operators.skew import AUTO, HotGroups
from ..sources import lookups as L
from ..sources.tables import lookup

KEY = ["stay_id", "time_seq"]


@dataclass(frozen=True)
class Kind:
    """Intervals of one exposure and what a measurement takes from those active at its time.

    The hull (earliest start, latest end) is always taken. ``aggs`` gets the mask of the exposure's rows,
    which carry their times in ``_start`` and ``_end``; ``finish`` adds row-wise columns.
    """

    name: str
    intervals: DataFrame
    start: str
    end: str
    aggs: Callable[[Column], dict[str, Column]]
    finish: Callable[[DataFrame], DataFrame]


def attach_exposures(points: DataFrame, kinds: Sequence[Kind]) -> DataFrame:
    """Measurements with the given exposures: the intervals of all kinds go through a single join."""
    spans = None
    aggs: dict[str, Column] = {}
    for k in kinds:
        part = k.intervals.withColumnsRenamed({k.start: "_start", k.end: "_end"}).withColumn("_kind", F.lit(k.name))
        spans = part if spans is None else spans.unionByName(part, allowMissingColumns=True)
        on = F.col("_kind") == k.name
        aggs |= {k.start: F.min(F.when(on, F.col("_start"))), k.end: F.max(F.when(on, F.col("_end"))), **k.aggs(on)}
    clash = [c for c in spans.columns if c in points.columns and c != "stay_id"]
    out = expose(points, spans.drop(*clash), ["stay_id"], "time_seq", "_start", "_end", aggs, "left")
    for k in kinds:
        out = k.finish(out)
    return out


# dextrose

def is_dextrose() -> Column:
    return contains_any(F.col("label"), ["dextrose"])


def dextrose_rates(events: DataFrame) -> DataFrame:
    """Grams per hour: from the pump rate if continuous, over ten minutes if pushed, over its own length if
    parenteral; unknown otherwise."""
    strength = lookup(events.sparkSession, L.DEXTROSE_CONCENTRATION, "label string, strength double")
    order = F.col("ordercategorydescription")
    length = F.col("endtime_seq") - F.col("starttime_seq")
    rate = (F.when((F.col("rateuom") == "mL/hour") & order.isin(*L.CONTINUOUS_ORDERS) & F.col("strength").isNotNull(),
                   F.col("strength") * F.col("rate"))
            .when(order.isin(*L.PUSH_ORDERS) & F.col("strength").isNotNull(),
                  F.col("strength") * F.col("amount") / L.BOLUS_HOURS)
            .when((F.col("label") == L.DEXTROSE_PARENTERAL) & (length > 0), F.col("amount") / length))
    return events.join(strength, "label", "left").select(
        "stay_id", F.col("starttime_seq").alias("starttime_dext_seq"), F.col("endtime_seq").alias("endtime_dext_seq"),
        F.col("label").alias("label_dext"), order.alias("ordercat_dext"), F.col("amount").alias("amount_total"),
        F.col("itemid").alias("itemid_dext"), rate.alias("rate_dext"))


def dextrose_kind(rates: DataFrame) -> Kind:
    order = F.struct("_start", "_end", "itemid_dext", "amount_total")
    return Kind("dextrose", rates, "starttime_dext_seq", "endtime_dext_seq", lambda on: {
        "rate_dext": sum_strict(F.col("rate_dext"), on),
        "label_dext": paste(F.col("label_dext"), order, on=on),
        "ordercat_dext": paste(F.col("ordercat_dext"), order, on=on),
    }, lambda df: df.withColumns({
        "dext_yn": F.when(F.col("starttime_dext_seq").isNotNull(), "y").otherwise("n"),
        "rate_dext": F.coalesce("rate_dext", F.lit(0.0))}))


# insulin

def is_insulin() -> Column:
    return contains_any(F.col("label"), ["insulin"]) & is_in(F.col("category"), ["Medications"])


def insulin_rates(events: DataFrame) -> DataFrame:
    """Action window and units per hour over it; a product not listed keeps its own times."""
    action = lookup(events.sparkSession, L.INSULIN_ACTION_HOURS, "label string, _tail double")
    order = F.col("ordercategorydescription")
    onset = F.when(F.col("_tail").isNotNull(), F.lit(L.INSULIN_ONSET_HOURS)).otherwise(F.lit(0.0))
    df = events.join(action, "label", "left").select(
        "stay_id", F.col("starttime_seq").alias("starttime_insu_seq"), F.col("endtime_seq").alias("endtime_insu_seq"),
        (F.col("starttime_seq") + onset).alias("starttime_insu_seq_corr"),
        (F.col("endtime_seq") + F.coalesce("_tail", F.lit(0.0))).alias("endtime_insu_seq_corr"),
        F.col("itemid").alias("itemid_insu"), F.col("label").alias("label_insu"), "ordercategoryname",
        order.alias("ordercat_insu"), F.col("amount").alias("units_insu"),
        F.when(order.isin(*L.CONTINUOUS_ORDERS), "infusion").when(order == "Drug Push", "bolus").alias("insu_cat"))
    length = F.col("endtime_insu_seq_corr") - F.col("starttime_insu_seq_corr")
    return df.withColumn("rate_insu", F.when(length > 0, F.col("units_insu") / length))


def _insulin_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"insu_yn": F.when(F.col("starttime_insu_seq_corr").isNotNull(), "y").otherwise("n"),
                           "rate_insu": F.coalesce("rate_insu", F.lit(0.0))})


def insulin_kind(rates: DataFrame) -> Kind:
    """Hull of the acting windows and the summed rate of all acting doses."""
    order = F.struct("_start", "_end", "itemid_insu", "units_insu")
    return Kind("insulin", rates, "starttime_insu_seq_corr", "endtime_insu_seq_corr", lambda on: {
        "insu_cat": paste(F.col("insu_cat"), order, on=on),
        "ordercategoryname": paste(F.col("ordercategoryname"), order, on=on),
        "rate_insu": sum_strict(F.col("rate_insu"), on),
    }, _insulin_flags)


def insulin_hull(points: DataFrame, rates: DataFrame) -> DataFrame:
    """Only the rates of doses whose window equals the hull of all acting windows; with none the rate is 0
    although the flag is ``y``."""
    order = F.struct("starttime_insu_seq_corr", "endtime_insu_seq_corr", "itemid_insu", "units_insu")
    found = hull_match(points, rates, ["stay_id"], "time_seq", "starttime_insu_seq_corr", "endtime_insu_seq_corr", {
        "insu_cat": paste(F.col("insu_cat"), order),
        "ordercategoryname": paste(F.col("ordercategoryname"), order),
        "rate_insu": sum_strict(F.col("rate_insu")),
    })
    return _insulin_flags(attach(points, found, KEY))


def daily_total(rates: DataFrame, t: str = "starttime_insu_seq", amount: str = "units_insu",
                name: str = "unitsperday_insu") -> DataFrame:
    """Amount per stay and day, by the uncorrected start."""
    return (rates.groupBy("stay_id", icu_day(F.col(t)).alias("time_icudays"))
            .agg(sum_strict(F.col(amount)).alias(name)))


def attach_daily(points: DataFrame, daily: DataFrame, name: str = "unitsperday_insu") -> DataFrame:
    return attach(points, daily, ["stay_id", "time_icudays"]).withColumn(name, F.coalesce(name, F.lit(0.0)))


# sedation

def score_periods(charted: DataFrame, item: int = L.SEDATION_ITEM, tie: Sequence[str] = ("valuenum",),
                  hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Runs of an unchanged score among the rows charted in a stay: each score lasts to the next one, the
    last to the end of the stay."""
    scores = charted.where(F.col("itemid") == item).select("stay_id", "charttime", "valuenum", "value", *_extra(tie),
                                                           "intime", "outtime")
    scores = add_clock(scores, {"charttime_seq": "charttime", "outtime_seq": "outtime"}, "intime")
    periods = points_to_periods(scores, ["stay_id"], "charttime_seq", "outtime_seq", tie,
                                "starttime_ras_seq", "endtime_ras_seq", hot)
    numbered = runs(periods, ["stay_id"], ["charttime_seq", *tie], "valuenum", "intnr", hot)
    return numbered.groupBy("stay_id", "intnr").agg(
        F.min("starttime_ras_seq").alias("starttime_ras_seq"), F.max("endtime_ras_seq").alias("endtime_ras_seq"),
        F.avg("valuenum").alias("ras_score"), F.min("value").alias("ras_label"))


def _extra(tie: Sequence[str]) -> list[str]:
    return [c for c in tie if c not in ("valuenum", "value", "charttime", "stay_id")]


def score_kind(periods: DataFrame) -> Kind:
    """Score in force; of overlapping periods the earliest."""
    return Kind("score", periods, "starttime_ras_seq", "endtime_ras_seq", lambda on: {
        "_score": F.min_by(F.when(on, F.struct("ras_score", "ras_label")), F.when(on, F.struct("_start", "intnr"))),
    }, lambda df: df.withColumns({"ras_score": F.col("_score.ras_score"), "ras_label": F.col("_score.ras_label")})
        .drop("_score", "starttime_ras_seq", "endtime_ras_seq"))


# ventilation

def ventilation_class(c: str = "ventilation_status"):
    return map_values(F.col(c), L.VENTILATION_CLASSES, F.when(F.col(c).isNull(), F.lit(L.NO_RECORD)))


def ventilation_intervals(ventilation: DataFrame, stays: DataFrame) -> DataFrame:
    df = ventilation.join(stays.select("stay_id", "intime"), "stay_id")
    return add_clock(df, {"starttime_vent_seq": "starttime", "endtime_vent_seq": "endtime"}, "intime").select(
        "stay_id", "starttime_vent_seq", "endtime_vent_seq", "ventilation_status")


def status_at(points: DataFrame, intervals: DataFrame, dedupe: bool = False) -> DataFrame:
    """Ventilation record in force and its class. Overlapping records repeat the measurement unless
    ``dedupe`` keeps the earliest record only."""
    start, end = "starttime_vent_seq", "endtime_vent_seq"
    out = attach_intervals(points, intervals, ["stay_id"], "time_seq", start, end)
    if dedupe:
        out = first_per_key(out, KEY, [start, end, "ventilation_status"])
    return out.withColumn("ventilation_status_cat", ventilation_class()).drop(start, end)


# glucocorticoids

def hadm_clock(df: DataFrame, stays: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Join stays by admission and put ``columns`` on the clock of the admission's first stay day."""
    origin = stays.groupBy("hadm_id").agg(F.min("intime").alias("_origin"))
    dim = stays.select("stay_id", "hadm_id", "intime", "outtime").join(origin, "hadm_id")
    dim = add_clock(dim, {"intime_seq": "intime", "outtime_seq": "outtime"}, "intime")
    out = df.join(dim, "hadm_id")
    zero = midnight(F.col("_origin"))
    return out.withColumns({new: hours_between(zero, F.col(ts)) for new, ts in columns.items()}).drop("_origin")


def systemic_glucocorticoid(medication: str = "medication"):
    """Named drug, not study medication, with a pharmacy id and a systemic route."""
    m = F.col(medication)
    return (contains_any(m, L.GLUCOCORTICOIDS) & exclude_any(m, L.STUDY_WORDS)
            & F.col("pharmacy_id").isNotNull() & is_in(F.col("route"), L.SYSTEMIC_ROUTES))


def drug_intervals(pharmacy: DataFrame, stays: DataFrame) -> DataFrame:
    """Periods of action that touch the stay: ends put in order, lengthened by 24 h, clamped at 0."""
    df = hadm_clock(pharmacy.where(systemic_glucocorticoid()), stays,
                    {"starttime_seq": "starttime", "stoptime_seq": "stoptime"})
    start, stop = F.col("starttime_seq"), F.col("stoptime_seq")
    df = df.where(overlaps(start, stop, F.col("intime_seq"), F.col("outtime_seq")))
    first, last = order_pair(start, stop)
    return df.select("stay_id", F.greatest(first, F.lit(0.0)).alias("cort_interval_starttime_seq"),
                     (last + L.GLUCOCORTICOID_HOURS).alias("cort_interval_endtime_seq"))


def drug_periods(pharmacy: DataFrame, stays: DataFrame, hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Merged periods of action per stay."""
    return merge_intervals(drug_intervals(pharmacy, stays), ["stay_id"], "cort_interval_starttime_seq",
                           "cort_interval_endtime_seq", hot=hot)


def drug_kind(periods: DataFrame) -> Kind:
    return Kind("glucocorticoid", periods, "cort_interval_starttime_seq", "cort_interval_endtime_seq", lambda on: {},
                lambda df: df.withColumn("glucocorticoid_yn", F.when(
                    F.col("cort_interval_starttime_seq").isNotNull(), "y").otherwise("n")))


def administered_doses(emar: DataFrame, pharmacy: DataFrame, stays: DataFrame) -> DataFrame:
    """Systemic glucocorticoid doses given during the stay; the route comes from the pharmacy record."""
    drug = contains_any(F.col("medication"), L.GLUCOCORTICOIDS)
    doses = emar.where(drug & (F.col("event_txt") == "Administered") & F.col("pharmacy_id").isNotNull()
                       & exclude_any(F.col("medication"), L.STUDY_WORDS))
    doses = doses.withColumn("scheduletime", F.coalesce("scheduletime", "charttime"))
    doses = hadm_clock(doses, stays, {"charttime_seq": "charttime", "scheduletime_seq": "scheduletime"})
    doses = doses.where(within(F.col("charttime_seq"), F.col("intime_seq"), F.col("outtime_seq")))
    routes = pharmacy.where(drug & is_in(F.col("route"), L.SYSTEMIC_ROUTES)).select(
        "hadm_id", "pharmacy_id", F.col("medication").alias("medication_pharm"), "route", "frequency")
    return doses.join(routes, ["hadm_id", "pharmacy_id"])


def ever_exposed(inputs: DataFrame, items: DataFrame, stays: DataFrame) -> DataFrame:
    """Stays with at least one event of the listed items."""
    return (inputs.where(F.col("amount") > 0).join(items.select("itemid"), "itemid", "left_semi")
            .join(stays.select("stay_id"), "stay_id", "left_semi").select("stay_id").distinct())
