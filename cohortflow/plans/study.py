"""The whole study table as one lazy plan over the thirteen clinical tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categories import glucose_mmol
from ..operators.skew import AUTO, HotGroups, hot_groups, merge, salted_join
from ..session import cut
from ..sources.tables import included_ids, write_table
from . import attributes, cohort, exposures, measurements, nutrition


@dataclass
class Study:
    """Each step is a frame that is planned on first use and never collected.

    The frames that several later steps read (cohort, its input events and chart rows, enteral events, fed
    measurements) are written to the checkpoint folder once. ``hot`` lists the stays too large for one task; it is looked up once and shared by every step.
    """

    tables: Mapping[str, DataFrame]
    min_los: float = 4.0
    missing_store: str = "null"
    insulin_mode: str = "sum"
    vent_dedupe: bool = False
    reference_compat: bool = False
    hot: HotGroups | None | str = AUTO

    def __post_init__(self) -> None:
        if isinstance(self.hot, str):
            self.hot = merge(hot_groups(self.tables["inputevents"], ["stay_id"]),
                             hot_groups(self.tables["chartevents"], ["stay_id"]))

    @cached_property
    def cohort(self) -> DataFrame:
        return cut(cohort.select_cohort(self.tables["icustays"], self.min_los))

    @cached_property
    def inputs(self) -> DataFrame:
        """Feeding, dextrose and insulin events of the cohort, from one scan of the input events."""
        items = self.tables["d_items"]
        wanted = items.where(nutrition.is_feeding() | exposures.is_dextrose() | exposures.is_insulin())
        return cut(nutrition.input_events(self.tables["inputevents"], wanted, self.cohort, self.hot))

    @cached_property
    def charted(self) -> DataFrame:
        """Glucose and sedation rows of the cohort, from one scan of the chart."""
        return cut(measurements.charted_in_stay(self.tables["chartevents"], self.cohort, hot=self.hot))

    @cached_property
    def feeding(self) -> DataFrame:
        events = nutrition.feeding_events(self.inputs, hot=self.hot)
        return nutrition.feeding_class(events, self.reference_compat, self.hot)

    @cached_property
    def enteral(self) -> DataFrame:
        return cut(nutrition.enteral_periods(self.feeding, self.hot))

    @cached_property
    def fed_stays(self) -> DataFrame:
        return self.enteral.select("stay_id").distinct()

    @cached_property
    def measured(self) -> DataFrame:
        """All glucose rows of the cohort."""
        return measurements.raw_measurements(self.charted, self.missing_store)

    @cached_property
    def raw(self) -> DataFrame:
        """Glucose rows of stays with enteral feeding."""
        return salted_join(self.measured, self.fed_stays, ["stay_id"], "left_semi", self.hot)

    @cached_property
    def valid(self) -> DataFrame:
        return measurements.clean_measurements(self.raw, hot=self.hot)

    @cached_property
    def exposed(self) -> DataFrame:
        """Valid measurements during enteral feeding, unknown and zero rates included."""
        return nutrition.feeding_exposure(self.valid, self.enteral)

    @cached_property
    def fed(self) -> DataFrame:
        return cut(nutrition.feeding_known(self.exposed))

    @cached_property
    def stays(self) -> DataFrame:
        """Cohort stays with at least one measurement left."""
        return self.cohort.join(self.fed.select("stay_id").distinct(), "stay_id", "left_semi")

    @cached_property
    def dextrose(self) -> DataFrame:
        return exposures.dextrose_rates(self.inputs.where(exposures.is_dextrose()))

    @cached_property
    def insulin(self) -> DataFrame:
        return exposures.insulin_rates(self.inputs.where(exposures.is_insulin()))

    @cached_property
    def sedation(self) -> DataFrame:
        return exposures.score_periods(self.charted, hot=self.hot)

    @cached_property
    def ventilation(self) -> DataFrame:
        return exposures.ventilation_intervals(self.tables["ventilation"], self.cohort)

    @cached_property
    def glucocorticoid(self) -> DataFrame:
        """Merged periods of glucocorticoid action."""
        return exposures.drug_periods(self.tables["pharmacy"], self.cohort, self.hot)

    @cached_property
    def exposures(self) -> DataFrame:
        """Measurements with every exposure attached."""
        kinds = [exposures.dextrose_kind(self.dextrose), exposures.score_kind(self.sedation),
                 exposures.drug_kind(self.glucocorticoid)]
        if self.insulin_mode == "sum":
            kinds.append(exposures.insulin_kind(self.insulin))
        df = exposures.attach_exposures(self.fed, kinds)
        if self.insulin_mode == "hull":
            df = exposures.insulin_hull(df, self.insulin)
        df = exposures.attach_daily(df, exposures.daily_total(self.insulin))
        return exposures.status_at(df, self.ventilation, self.vent_dedupe)

    @cached_property
    def analysis(self) -> DataFrame:
        """One row per measurement with exposures, stay facts and categories."""
        facts = attributes.stay_attributes(self.cohort, self.tables).drop("subject_id", "hadm_id")
        df = self.exposures.withColumnsRenamed({"valuenum": "glucose_value", "valueuom": "glucose_unit",
                                                "itemid": "glucose_itemid"})
        df = df.withColumn("glucose_value_mmolL", glucose_mmol(F.col("glucose_value")))
        return attributes.categorise(salted_join(df, facts, ["stay_id"], "left", self.hot))

    @cached_property
    def table(self) -> DataFrame:
        """``analysis`` with the commonest comorbidities of the included admissions and the index."""
        flags = attributes.attach_top_flags(self.cohort.select("stay_id", "hadm_id"), self.tables["charlson"], self.stays)
        return salted_join(self.analysis, flags.drop("hadm_id"), ["stay_id"], "left", self.hot)

    def subject_flow(self) -> DataFrame:
        return cohort.subject_flow(self.tables["icustays"], self.cohort, self.measured, self.fed_stays, self.min_los)

    def measurement_flow(self) -> DataFrame:
        return cohort.measurement_flow(self.raw, self.valid, self.exposed, self.fed_stays, measurements.invalid())

    def outputs(self) -> dict[str, DataFrame]:
        """The study's nine result tables."""
        return {
            "subject_flow": self.subject_flow(),
            "measurement_flow": self.measurement_flow(),
            "included_ids": included_ids(self.fed),
            "measurements_with_covariates": self.table,
            "insulin_administrations": self.insulin.join(self.stays.select("stay_id"), "stay_id", "left_semi"),
            "dextrose_administrations": self.dextrose.join(self.stays.select("stay_id"), "stay_id", "left_semi"),
            "enteral_feeding": self.enteral,
            "all_measurements": self.measured,
            "glucocorticoid_administrations": self.exposures.select(
                "stay_id", "time_seq", "cort_interval_starttime_seq", "cort_interval_endtime_seq").na.drop().distinct(),
        }

    def write(self, root: str, fmt: str = "parquet") -> None:
        """The nine result tables under ``root``."""
        for name, df in self.outputs().items():
            write_table(df, f"{root}/{name}", fmt)
