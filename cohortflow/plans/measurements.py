"""Glucose measurements: time correction, duplicates, limits, clock columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import measurement_clock
from ..functions.predicates import within
from ..operators.groups import dedupe_preferred
from ..operators.intervals import neighbour_gaps
from ..operators.skew import AUTO, HotGroups, salted_join
from ..sources import lookups as L

ITEMS = tuple(item for item, *_ in L.GLUCOSE_ITEMS)


def _by_item(values: Sequence[tuple[int, object]]) -> Column:
    expr = None
    for item, value in values:
        cond = F.col("itemid") == item
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr


def preference() -> Column:
    return _by_item([(item, pref) for item, pref, _, _ in L.GLUCOSE_ITEMS])


def upper_limit() -> Column:
    return _by_item([(item, limit) for item, _, limit, _ in L.GLUCOSE_ITEMS])


def sample_type() -> Column:
    return _by_item([(item, label) for item, _, _, label in L.GLUCOSE_ITEMS])


def invalid() -> Column:
    return F.col("valuenum") > upper_limit()


def corrected_time(missing_store: str = "null") -> Column:
    """The earlier of chart and store time. A missing store time gives no time, or with ``"chart"`` the
    chart time."""
    chart, store = F.col("charttime"), F.col("storetime")
    expr = F.when(store < chart, store).when(store >= chart, chart)
    return expr.otherwise(chart) if missing_store == "chart" else expr


def charted_in_stay(chart: DataFrame, cohort: DataFrame, items: Sequence[int] = (*ITEMS, L.SEDATION_ITEM),
                    hot: HotGroups | None = None) -> DataFrame:
    """Rows of the listed items charted during a cohort stay."""
    rows = salted_join(chart.where(F.col("itemid").isin(*items)), cohort.select("stay_id", "intime", "outtime", "los"),
                       ["stay_id"], "inner", hot)
    return rows.where(within(F.col("charttime"), F.col("intime"), F.col("outtime")))


def raw_measurements(charted: DataFrame, missing_store: str = "null") -> DataFrame:
    """Glucose rows at their corrected time."""
    return charted.where(F.col("itemid").isin(*ITEMS)).withColumn("charttime", corrected_time(missing_store))


def valid_measurements(raw: DataFrame, tie: Sequence[str] = ("storetime", "valuenum")) -> DataFrame:
    """One row per stay and time, the preferred sample; only then are values over the limit dropped."""
    kept = dedupe_preferred(raw, ["subject_id", "stay_id", "charttime"], preference(), tie)
    return kept.where(F.col("valuenum") <= upper_limit())


def clean_measurements(raw: DataFrame, tie: Sequence[str] = ("storetime", "valuenum"),
                       hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Valid rows with clock columns, gaps to the neighbours and the sample type."""
    timed = measurement_clock(valid_measurements(raw, tie), "charttime", "intime")
    timed = neighbour_gaps(timed, ["stay_id"], "time_seq", hot=hot)
    return timed.withColumn("sample_type", sample_type())
