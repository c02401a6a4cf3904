"""Study steps on hand-made stays, and the whole study with and without hot stays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortflow.plans import attributes, cohort, descriptives, exposures, measurements, models, nutrition
from cohortflow.plans.study import Study
from cohortflow.sources import analogue, tables
from conftest import rows

DAY = dt.datetime(2024, 1, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def test_cohort_takes_first_long_stay_and_keeps_ties(spark):
    stays = spark.createDataFrame(
        [(1, 10, at(0), 1.0), (1, 11, at(100), 5.0), (1, 12, at(300), 9.0), (2, 20, at(5), 4.0), (2, 21, at(5), 6.0), (3, 30, at(0), 3.9)],
        "subject_id int, stay_id int, intime timestamp_ntz, los double")
    assert [r["stay_id"] for r in cohort.select_cohort(stays).orderBy("stay_id").collect()] == [11, 20, 21]


def test_feeding_classes(spark):
    data = [(1, c) for c in ("Nutrition - Enteral", None)] + [(2, "Nutrition - Supplements")]
    data += [(3, c) for c in ("Nutrition - Enteral", "Nutrition - Supplements")] + [(4, c) for c in ("Nutrition - Parenteral", "Fluids/Intake")]
    data += [(5, "Nutrition - Parenteral")]
    df = spark.createDataFrame([(s, c, "Fluids/Intake") for s, c in data], "stay_id int, category string, ordercategoryname string")
    got = {r["stay_id"]: r["nutritiongroup"] for r in nutrition.feeding_class(df).collect()}
    assert got == {1: "Combined", 2: "Oral intake only", 3: "Enteral feeding only", 4: "Combined", 5: "Parenteral feeding only"}
    compat = {r["stay_id"]: r["nutritiongroup"] for r in nutrition.feeding_class(df, True).collect()}
    assert compat == {**got, 1: None, 4: None}


def chart(spark, data):
    return spark.createDataFrame(
        [(k, 1, 2, 3, item, at(t), None if s is None else at(s), float(v)) for k, (item, t, s, v) in enumerate(data)],
        "event_id int, subject_id int, hadm_id int, stay_id int, itemid int, charttime timestamp_ntz, storetime timestamp_ntz, valuenum double")


@pytest.fixture(scope="module")
def stay(spark):
    return spark.createDataFrame([(1, 2, 3, at(5), at(80), 4.0)],
                                 "subject_id int, hadm_id int, stay_id int, intime timestamp_ntz, outtime timestamp_ntz, los double")


def test_measurement_times(spark, stay):
    c = chart(spark, [(220621, 10, 9.9, 1), (220621, 11, 11.1, 2), (220621, 12, None, 3), (220621, 4, 4, 4), (220621, 5, 4.5, 5), (999, 20, 20, 6)])
    got = {r["valuenum"]: r["charttime"] for r in measurements.raw_measurements(measurements.charted_in_stay(c, stay)).collect()}
    assert got == {1.0: at(9.9), 2.0: at(11), 3.0: None, 5.0: at(4.5)}
    kept = {r["valuenum"]: r["charttime"] for r in measurements.raw_measurements(measurements.charted_in_stay(c, stay), "chart").collect()}
    assert kept[3.0] == at(12)


def test_preferred_sample_goes_first_even_if_invalid(spark, stay):
    c = chart(spark, [(220621, 10, 10, 1200), (225664, 10, 10, 140), (225664, 20, 20, 500), (226537, 21, 21, 501), (225664, 22, 22, 501)])
    out = measurements.clean_measurements(measurements.raw_measurements(measurements.charted_in_stay(c, stay))).orderBy("time_seq").collect()
    assert [(r["time_seq"], r["valuenum"], r["sample_type"]) for r in out] == [
        (20.0, 500.0, "Fingerstick"), (21.0, 501.0, "Lab (whole blood)")]
    assert [r["time_next_measurement"] for r in out] == [1.0, None]


def points(spark, times):
    return spark.createDataFrame([(3, float(t)) for t in times], "stay_id int, time_seq double")


def test_insulin_modes(spark):
    def rates(*spans):
        return spark.createDataFrame(
            [(3, float(a), float(b), float(a), float(b), k, "x", "Drips", None, float(b - a), None, 1.0) for k, (a, b) in enumerate(spans)],
            "stay_id int, starttime_insu_seq double, endtime_insu_seq double, starttime_insu_seq_corr double, endtime_insu_seq_corr double, "
            "itemid_insu int, label_insu string, ordercategoryname string, ordercat_insu string, units_insu double, insu_cat string, rate_insu double")
    p = points(spark, [4, 40])
    apart = rates((0.5, 5), (2, 8))
    total = exposures.attach_exposures(p, [exposures.insulin_kind(apart)]).orderBy("time_seq").collect()
    assert [(r["insu_yn"], r["rate_insu"], r["insu_cat"]) for r in total] == [("y", 2.0, "NA_NA"), ("n", 0.0, None)]
    hull = exposures.insulin_hull(p, apart).orderBy("time_seq").collect()
    assert [(r["insu_yn"], r["rate_insu"], r["insu_cat"]) for r in hull] == [("y", 0.0, "NA"), ("n", 0.0, None)]
    spanning = exposures.insulin_hull(p, rates((0.5, 9), (2, 8))).orderBy("time_seq").collect()
    assert (spanning[0]["rate_insu"], spanning[0]["endtime_insu_seq_corr"]) == (1.0, 9.0)


def test_insulin_action(spark):
    ev = spark.createDataFrame([(3, 0.0, 1.0, 1, n, "o", "Drug Push", 9.0) for n in ("Insulin - NPH", "Insulin pump")],
                               "stay_id int, starttime_seq double, endtime_seq double, itemid int, label string, ordercategoryname string, "
                               "ordercategorydescription string, amount double")
    got = {r["label_insu"]: (r["starttime_insu_seq_corr"], r["endtime_insu_seq_corr"], r["rate_insu"], r["insu_cat"])
           for r in exposures.insulin_rates(ev).collect()}
    assert got == {"Insulin - NPH": (0.5, 11.0, 9 / 10.5, "bolus"), "Insulin pump": (0.0, 1.0, 9.0, "bolus")}


def test_dextrose_rates_and_unknown_sum(spark):
    data = [("Dextrose 5%", "Continuous IV", "mL/hour", 40.0, 100.0), ("Dextrose 50%", "Drug Push", None, None, 25.0),
            ("Dextrose PN", "Continuous IV", None, None, 30.0), ("Dextrose 10%", "Continuous IV", "units", 5.0, 7.0)]
    ev = spark.createDataFrame([(3, 0.0, 10.0, k, *r) for k, r in enumerate(data)],
                               "stay_id int, starttime_seq double, endtime_seq double, itemid int, label string, ordercategorydescription string, "
                               "rateuom string, rate double, amount double")
    rates = exposures.dextrose_rates(ev)
    got = {r["label_dext"]: r["rate_dext"] for r in rates.collect()}
    assert got == {"Dextrose 5%": 2.0, "Dextrose 50%": 0.5 * 25 / 0.1667, "Dextrose PN": 3.0, "Dextrose 10%": None}
    out = exposures.attach_exposures(points(spark, [5]), [exposures.dextrose_kind(rates)]).collect()[0]
    assert (out["dext_yn"], out["rate_dext"]) == ("y", 0.0)
    known = exposures.attach_exposures(points(spark, [5]), [exposures.dextrose_kind(rates.where("rate_dext is not null"))]).collect()[0]
    assert known["rate_dext"] == pytest.approx(5 + 0.5 * 25 / 0.1667)


def pharmacy(spark, *spans):
    return spark.createDataFrame(
        [(2, k, "Prednisone", "PO", "Q24H", at(a), at(b)) for k, (a, b) in enumerate(spans)],
        "hadm_id int, pharmacy_id int, medication string, route string, frequency string, starttime timestamp_ntz, stoptime timestamp_ntz")


def test_drug_intervals(spark, stay):
    def spans(*s):
        return sorted((r["cort_interval_starttime_seq"], r["cort_interval_endtime_seq"])
                      for r in exposures.drug_periods(pharmacy(spark, *s), stay).collect())
    assert spans((30, 20)) == [(20.0, 54.0)]
    assert spans((-5, 10)) == [(0.0, 34.0)]
    assert spans((6, 7), (31, 40), (90, 95)) == [(6.0, 64.0)]


def test_status_at(spark):
    v = spark.createDataFrame([(3, 0.0, 10.0, "InvasiveVent"), (3, 5.0, 15.0, "None"), (3, 20.0, 30.0, "Odd")],
                              "stay_id int, starttime_vent_seq double, endtime_vent_seq double, ventilation_status string")
    got = exposures.status_at(points(spark, [6, 12, 17, 25]), v)
    assert rows(got.select("time_seq", "ventilation_status_cat")) == sorted(
        [(6.0, "invasive"), (6.0, "none"), (12.0, "none"), (17.0, "NaN"), (25.0, None)], key=repr)
    assert exposures.status_at(points(spark, [6]), v, True).collect()[0]["ventilation_status"] == "InvasiveVent"


def test_stay_status(spark):
    stays = spark.createDataFrame([(k,) for k in range(5)], "stay_id int")
    v = spark.createDataFrame([(0, "InvasiveVent"), (0, "None"), (1, "HFNC"), (1, "None"), (2, "None"), (4, "Odd")], "stay_id int, ventilation_status string")
    got = {r["stay_id"]: r["ventilation_status_stay"] for r in descriptives.stay_status(stays, v).collect()}
    assert got == {0: "invasive", 1: "non-invasive only", 2: "none", 3: "NaN", 4: None}


def test_daily_total_uses_floor(spark):
    rates = spark.createDataFrame([(1, -1.5, 2.0), (1, 3.0, 4.0), (1, 4.0, None)], "stay_id int, starttime_insu_seq double, units_insu double")
    got = {r["time_icudays"]: r["unitsperday_insu"] for r in exposures.daily_total(rates).collect()}
    assert got == {-1: 2.0, 0: None}


def test_died(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 2), at(30), "HOME"), (dt.date(2024, 1, 3), at(30), "HOME"), (None, at(30), "HOSPICE"), (None, None, None)],
                               "dod date, out timestamp_ntz, loc string")
    got = [r[0] for r in df.select(attributes.died_in_hospital(F.col("dod"), F.col("out"), F.col("loc"))).collect()]
    assert got == ["y", "n", "y", "n"]


def test_insulin_need(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 0.0), (2, 70.0), (3, 100.0), (4, 36.0)], "stay_id int, unitsperday_insu double")
    got = {r["stay_id"]: r["insu_requirement"] for r in models.requirement_class(df).collect()}
    assert got == {1: "no", 2: "0-35 units/day", 3: ">70 units/day", 4: "35-70 units/day"}


def test_eighteen_subgroups():
    assert len({name for _, name, _ in models.subgroup_conditions()}) == 18


SF = "/root/testdata/sf0.001"


def test_whole_study_with_hot_stays(spark, hot):
    t = analogue.load(spark, SF)
    plain = Study(t, min_los=6)
    assert plain.hot is None
    text = [c for c, k in plain.table.dtypes if k in ("string", "bigint")]
    want = rows(plain.table.select(*text, F.round("rate_nut_cho", 6).alias("r"), F.round("rate_insu", 6).alias("i")))
    with hot(6):
        split = Study(t, min_los=6)
        assert split.hot is not None
        got = rows(split.table.select(*text, F.round("rate_nut_cho", 6).alias("r"), F.round("rate_insu", 6).alias("i")))
        flow = rows(split.measurement_flow())
    assert want and got == want
    assert flow == rows(plain.measurement_flow())


def test_results_are_written_and_read_back(spark, tmp_path):
    s = Study(analogue.load(spark, SF), min_los=6, insulin_mode="hull", vent_dedupe=True)
    s.write(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/included_ids").columns == ["subject_id", "hadm_id", "stay_id"]
    assert spark.read.parquet(f"{tmp_path}/measurements_with_covariates").count() == s.fed.count()
    tables.write_table(s.subject_flow(), f"{tmp_path}/flow_csv", "csv")
    back = tables.read_csv(spark, f"{tmp_path}/flow_csv", "metric string, value long")
    assert rows(back) == rows(s.subject_flow())


def test_tables_are_read_by_schema(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("stay_id"), F.lit(1).alias("sofa")).write.parquet(f"{tmp_path}/derived/first_day_sofa")
    got = tables.read_tables(spark, str(tmp_path), ["first_day_sofa"])
    assert got["first_day_sofa"].count() == 3 and len(tables.TABLES) == 13


def test_carbohydrate_products():
    from cohortflow.sources import lookups as L
    ids = [i for _, members, _ in L.NUTRITION_FACTORS for i in members]
    assert len(L.NUTRITION_FACTORS) == 33 and len(ids) == len(set(ids))
