"""Queries over single operators and the exposure steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, predicates
from ..functions.aggregates import mean_strict, sum_strict
from ..functions.categories import cut, glucose_mmol
from ..operators import groups, intervals, summaries
from ..plans import attributes, exposures, measurements, nutrition
from ..sources import analogue
from ..sources import lookups as L
from ..sources.tables import included_ids
from .registry import query, r, rounded, sel, study
from .views import NOT_STUDY, STEROID, VENT_CLASS, _seq, _strict, cut_sql


def tables(spark, sf_dir):
    return analogue.load(spark, sf_dir)


# clock, cohort, filters

@query("clock_columns", f"""
SELECT g.event_id, g.itemid, {sel(f"~{_seq('g.charttime', 's.intime')} AS time_seq, ~{_seq('g.charttime', 'g.charttime')} AS time_dec")},
       CAST(FLOOR({_seq('g.charttime', 'g.charttime')}) AS BIGINT) AS time_hbin,
       CAST(FLOOR({_seq('g.charttime', 's.intime')} / 24) AS BIGINT) AS time_icudays
FROM chartevents g JOIN icustays s ON g.stay_id = s.stay_id""")
def clock_columns(spark, d):
    t = tables(spark, d)
    df = t["chartevents"].join(t["icustays"].select("stay_id", "intime"), "stay_id")
    df = clock.measurement_clock(df, "charttime", "intime")
    return rounded(df.select("event_id", "itemid", "time_seq", "time_dec", "time_hbin", "time_icudays"))


@query("floor_modulo", f"""
SELECT g.event_id, g.itemid, CAST(FLOOR(x / 24) AS BIGINT) AS day, {r('x - 24 * FLOOR(x / 24)')} AS clock_hour FROM (
  SELECT g.event_id, g.itemid, {_seq('g.storetime', 's.outtime')} AS x FROM chartevents g JOIN icustays s ON g.stay_id = s.stay_id) g""")
def floor_modulo(spark, d):
    t = tables(spark, d)
    df = t["chartevents"].join(t["icustays"].select("stay_id", "outtime"), "stay_id")
    df = clock.add_clock(df, {"x": "storetime"}, "outtime")
    return rounded(df.select("event_id", "itemid", clock.icu_day(F.col("x")).alias("day"),
                             clock.clock_hour(F.col("x")).alias("clock_hour")))


@query("cohort_first_long_stay", f"SELECT {sel('subject_id, stay_id, hadm_id, ~los')} FROM cohort")
def cohort_first_long_stay(spark, d):
    return rounded(study(spark, d).cohort.select("subject_id", "stay_id", "hadm_id", "los"))


@query("semi_filter", f"""
SELECT {sel('g.event_id, g.itemid, ~g.valuenum')} FROM chartevents g WHERE g.stay_id IN (SELECT stay_id FROM cohort)""")
def semi_filter(spark, d):
    s = study(spark, d)
    return rounded(predicates.semi_filter(s.tables["chartevents"], s.cohort, "stay_id").select("event_id", "itemid", "valuenum"))


@query("code_prefix_flag", """
SELECT s.hadm_id, CASE WHEN s.hadm_id IN (SELECT hadm_id FROM diagnoses_icd WHERE REGEXP_MATCHES(icd_code, '^(250|E1[0-4])[0-9]'))
       THEN 'y' ELSE 'n' END AS diabetes_status FROM icustays s""")
def code_prefix_flag(spark, d):
    t = tables(spark, d)
    df = attributes.has_code(t["icustays"], t["diagnoses_icd"], "hadm_id", "icd_code", L.DIABETES_PREFIXES, "diabetes_status")
    return df.select("hadm_id", "diabetes_status")


@query("text_filter", f"""
SELECT p.pharmacy_id, p.hadm_id, p.medication, p.route FROM pharmacy p
WHERE {STEROID} AND {NOT_STUDY} AND pharmacy_id IS NOT NULL AND route IN ('IV', 'PO', 'ORAL', 'PO/NG')""")
def text_filter(spark, d):
    return (tables(spark, d)["pharmacy"].where(exposures.systemic_glucocorticoid())
            .select("pharmacy_id", "hadm_id", "medication", "route"))


@query("overlap_filter", """
SELECT p.pharmacy_id, p.hadm_id, p.medication FROM pharmacy p JOIN icustays s ON p.hadm_id = s.hadm_id
WHERE NOT (p.stoptime <= s.intime OR p.starttime >= s.outtime) OR (p.starttime <= s.intime AND p.stoptime >= s.outtime)""")
def overlap_filter(spark, d):
    t = tables(spark, d)
    df = t["pharmacy"].join(t["icustays"].select("hadm_id", "intime", "outtime"), "hadm_id")
    keep = predicates.overlaps(F.col("starttime"), F.col("stoptime"), F.col("intime"), F.col("outtime"))
    return df.where(keep).select("pharmacy_id", "hadm_id", "medication")


@query("keep_group_all", """
SELECT event_id, stay_id FROM (SELECT event_id, stay_id, BOOL_AND(COALESCE(value > 1, FALSE)) OVER (PARTITION BY stay_id) AS ok FROM base)
WHERE ok""")
def keep_group_all(spark, d):
    df = groups.keep_groups_all(tables(spark, d)["base"], ["stay_id"], F.col("value") > 1)
    return df.select("event_id", "stay_id")


# intervals

def _points(spark, d):
    """Measurements and input events of every stay in hours."""
    t = tables(spark, d)
    stays = t["icustays"].select("stay_id", "intime", "outtime")
    points = t["chartevents"].join(stays, "stay_id")
    points = clock.add_clock(points, {"t": "charttime"}, "intime").select("event_id", "stay_id", "itemid", "t", "valuenum")
    spans = t["inputevents"].join(stays, "stay_id")
    spans = clock.add_clock(spans, {"s": "starttime", "e": "endtime", "lo": "intime", "hi": "outtime"}, "intime")
    return points, spans.select("event_id", "stay_id", F.col("itemid").alias("input_itemid"), "s", "e", "amount", "lo", "hi")


POINTS = f"SELECT g.event_id, g.stay_id, g.itemid, {_seq('g.charttime', 'c.intime')} AS t, g.valuenum FROM chartevents g JOIN icustays c ON g.stay_id = c.stay_id"
SPANS = (f"SELECT i.event_id, i.stay_id, i.itemid AS input_itemid, {_seq('i.starttime')} AS s, {_seq('i.endtime')} AS e, i.amount, "
         f"{_seq('c.intime')} AS lo, {_seq('c.outtime')} AS hi FROM inputevents i JOIN icustays c ON i.stay_id = c.stay_id")


@query("interval_join", f"""
SELECT {sel('p.event_id, p.itemid, i.event_id AS input_id, ~p.t, ~i.s, ~i.e')}
FROM ({POINTS}) p JOIN ({SPANS}) i ON p.stay_id = i.stay_id AND p.t > i.s AND p.t <= i.e""")
def interval_join(spark, d):
    points, spans = _points(spark, d)
    out = intervals.interval_join(points, spans.withColumnRenamed("event_id", "input_id"), ["stay_id"], "t", "s", "e")
    return rounded(out.select("event_id", "itemid", "input_id", "t", "s", "e"))


@query("interval_semi", f"""
SELECT {sel('p.event_id, p.itemid, ~p.t')} FROM ({POINTS}) p
WHERE EXISTS (SELECT 1 FROM ({SPANS}) i WHERE p.stay_id = i.stay_id AND p.t > i.s AND p.t <= i.e)""")
def interval_semi(spark, d):
    points, spans = _points(spark, d)
    return rounded(intervals.semi_interval(points, spans, ["stay_id"], "t", "s", "e").select("event_id", "itemid", "t"))


@query("islands", f"""
SELECT event_id, stay_id, {sel('~s, ~e')}, CAST(SUM(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER
       (PARTITION BY stay_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
FROM (SELECT *, MAX(e) OVER (PARTITION BY stay_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM ({SPANS}))""")
def islands(spark, d):
    _, spans = _points(spark, d)
    return rounded(intervals.islands(spans, ["stay_id"], "s", "e", ["event_id"]).select("event_id", "stay_id", "s", "e", "island"))


@query("merge_intervals", f"""
SELECT stay_id, island + 1 AS interval_no, {sel('~MIN(s) AS s, ~MAX(e) AS e')} FROM (
  SELECT *, CAST(SUM(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER
         (PARTITION BY stay_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
  FROM (SELECT *, MAX(e) OVER (PARTITION BY stay_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
        FROM ({SPANS})))
GROUP BY stay_id, island""")
def merge_intervals(spark, d):
    _, spans = _points(spark, d)
    return rounded(intervals.merge_intervals(spans, ["stay_id"], "s", "e", ["event_id"]))


@query("run_periods", """
SELECT event_id, stay_id, CAST(SUM(fresh) OVER (PARTITION BY stay_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM LAG(event_type) OVER (PARTITION BY stay_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS fresh
      FROM base)""")
def run_periods(spark, d):
    df = intervals.runs(tables(spark, d)["base"], ["stay_id"], ["ts", "event_id"], "event_type")
    return df.select("event_id", "stay_id", "run")


@query("points_to_periods", f"""
SELECT p.event_id, {sel('~p.t AS period_start, ~COALESCE(LEAD(p.t) OVER (PARTITION BY p.stay_id ORDER BY p.t, p.event_id), s.hi) AS period_end')}
FROM base p JOIN (SELECT stay_id, MAX(t) AS hi FROM base GROUP BY stay_id) s ON p.stay_id = s.stay_id""")
def points_to_periods(spark, d):
    base = tables(spark, d)["base"]
    df = groups.group_attach(base.select("event_id", "stay_id", "t"), ["stay_id"], {"hi": F.max("t")})
    df = intervals.points_to_periods(df, ["stay_id"], "t", "hi", ["event_id"])
    return rounded(df.select("event_id", "period_start", "period_end"))


@query("lag_lead_gaps", f"""
SELECT event_id, {sel('~t - LAG(t) OVER (PARTITION BY stay_id ORDER BY t, event_id) AS time_last_measurement, ~LEAD(t) OVER (PARTITION BY stay_id ORDER BY t, event_id) - t AS time_next_measurement')}
FROM base""")
def lag_lead_gaps(spark, d):
    df = intervals.neighbour_gaps(tables(spark, d)["base"], ["stay_id"], "t", ["event_id"])
    return rounded(df.select("event_id", "time_last_measurement", "time_next_measurement"))


@query("hour_grid", f"""
SELECT stay_id, UNNEST(GENERATE_SERIES(CAST(FLOOR({_seq('intime', 'intime')}) AS BIGINT), CAST(CEIL({_seq('outtime', 'intime')}) AS BIGINT))) AS time_seq
FROM icustays""")
def hour_grid(spark, d):
    stays = clock.add_clock(tables(spark, d)["icustays"], {"lo": "intime", "hi": "outtime"}, "intime")
    return intervals.hour_grid(stays, "lo", "hi").select("stay_id", "time_seq")


def _hours_sql(lower: str) -> str:
    return f"""
SELECT i.event_id, h.time_seq FROM ({SPANS}) i
JOIN (SELECT stay_id, UNNEST(GENERATE_SERIES(CAST(FLOOR({_seq('intime', 'intime')}) AS BIGINT), CAST(CEIL({_seq('outtime', 'intime')}) AS BIGINT))) AS time_seq
      FROM icustays) h ON i.stay_id = h.stay_id AND h.time_seq >= {lower}(i.s) AND h.time_seq < CEIL(i.e)"""


@query("hour_grid_join_ceil", _hours_sql("CEIL"))
def hour_grid_join_ceil(spark, d):
    _, spans = _points(spark, d)
    return intervals.interval_hours(spans, "s", "e", "ceil", "lo", "hi").select("event_id", "time_seq")


@query("hour_grid_join_floor", _hours_sql("FLOOR"))
def hour_grid_join_floor(spark, d):
    _, spans = _points(spark, d)
    return intervals.interval_hours(spans, "s", "e", "floor", "lo", "hi").select("event_id", "time_seq")


# aggregates and categories

@query("sum_strict", f"""
SELECT stay_id, {sel(f"~{_strict('SUM', 'rate')} AS rate_sum, ~{_strict('AVG', 'rate')} AS rate_mean")}, COUNT(*) AS n FROM inputevents GROUP BY stay_id""")
def sum_strict_query(spark, d):
    df = tables(spark, d)["inputevents"].groupBy("stay_id").agg(
        sum_strict(F.col("rate")).alias("rate_sum"), mean_strict(F.col("rate")).alias("rate_mean"),
        F.count(F.lit(1)).alias("n"))
    return rounded(df)


@query("paste_agg", """
SELECT stay_id, STRING_AGG(COALESCE(rateuom, 'NA'), '_' ORDER BY starttime, event_id) AS units FROM inputevents GROUP BY stay_id""")
def paste_agg(spark, d):
    return groups.paste_groups(tables(spark, d)["inputevents"], ["stay_id"], "rateuom", ["starttime", "event_id"], "units")


@query("dedupe_preferred", f"""
SELECT event_id, stay_id, itemid, {sel('~valuenum')} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY stay_id, charttime ORDER BY CASE itemid WHEN 220621 THEN 1 WHEN 226537 THEN 2 ELSE 3 END, event_id) AS rn
  FROM chartevents WHERE itemid IN (220621, 226537, 225664)) WHERE rn = 1""")
def dedupe_preferred(spark, d):
    chart = tables(spark, d)["chartevents"].where(F.col("itemid").isin(*measurements.ITEMS))
    df = groups.dedupe_preferred(chart, ["stay_id", "charttime"], measurements.preference(), ["event_id"])
    return rounded(df.select("event_id", "stay_id", "itemid", "valuenum"))


@query("first_per_key", """
SELECT user_id, event_type, event_id FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM base) WHERE rn = 1""")
def first_per_key(spark, d):
    return groups.first_per_key(tables(spark, d)["base"], ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id")


@query("center_on_group", f"SELECT event_id, {r('value - AVG(value) OVER (PARTITION BY user_id)', 9)} AS centred FROM base")
def center_on_group(spark, d):
    return rounded(groups.center(tables(spark, d)["base"], ["user_id"], "value", "centred").select("event_id", "centred"), 9)


@query("quantiles", f"""
SELECT event_type, {', '.join(f"{r(f'QUANTILE_CONT(value, {p})')} AS q{int(p * 100):03d}" for p in (0.0, 0.25, 0.33, 0.5, 0.66, 0.75, 1.0))}
FROM base GROUP BY event_type""")
def quantiles(spark, d):
    return rounded(summaries.quantiles(tables(spark, d)["base"], "value", (0, 0.25, 0.33, 0.5, 0.66, 0.75, 1), ["event_type"]))


@query("cut_age", f"SELECT subject_id, {cut_sql('anchor_age', '55 65 75')} AS age_cat FROM patients")
def cut_age(spark, d):
    return tables(spark, d)["patients"].select("subject_id", cut(F.col("anchor_age"), L.AGE_BREAKS).alias("age_cat"))


@query("freq_table", f"SELECT age_cat, COUNT(*) AS n FROM (SELECT {cut_sql('anchor_age', '55 65 75')} AS age_cat FROM patients) GROUP BY age_cat")
def freq_table(spark, d):
    return summaries.freq(cut_age(spark, d), "age_cat")


FLAGS = ("myocardial_infarct", "congestive_heart_failure", "chronic_pulmonary_disease", "renal_disease",
         "malignant_cancer", "mild_liver_disease")


@query("top_columns_by_sum", "SELECT name, total FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, CAST(SUM({c}) AS DOUBLE) AS total, {k} AS pos FROM charlson" for k, c in enumerate(FLAGS))
    + " UNION ALL SELECT 'diabetes_charlson', CAST(SUM(CASE WHEN diabetes_without_cc = 1 OR diabetes_with_cc = 1 THEN 1 ELSE 0 END) AS DOUBLE), 6 FROM charlson"
    + ") ORDER BY total DESC, pos LIMIT 5")
def top_columns_by_sum(spark, d):
    t = tables(spark, d)
    return attributes.top_flags(t["charlson"], t["icustays"])


@query("histogram", f"SELECT {r('FLOOR(value / 0.5 + 0.5) * 0.5')} AS bin_centre, COUNT(*) AS n FROM base GROUP BY FLOOR(value / 0.5 + 0.5)")
def histogram(spark, d):
    return rounded(summaries.histogram(tables(spark, d)["base"], "value", 0.5))


@query("unit_conversion", f"SELECT event_id, {r('valuenum / 18.0182')} AS glucose_value_mmolL FROM chartevents WHERE itemid IN (220621, 226537, 225664)")
def unit_conversion(spark, d):
    chart = tables(spark, d)["chartevents"].where(F.col("itemid").isin(*measurements.ITEMS))
    return rounded(chart.select("event_id", glucose_mmol(F.col("valuenum")).alias("glucose_value_mmolL")))


@query("sample_n", """
SELECT event_id, user_id, value FROM base ORDER BY md5(concat_ws(':', CAST(event_id AS VARCHAR), '42')), event_id LIMIT 500""")
def sample_n(spark, d):
    return groups.sample_n(tables(spark, d)["base"], 500, ["event_id"]).select("event_id", "user_id", "value")


# study steps

@query("subject_flow", """
, f AS (SELECT s.subject_id, s.los >= 6 AS is_long, s.stay_id IN (SELECT stay_id FROM cohort) AS is_first,
                  s.stay_id IN (SELECT stay_id FROM measured) AS is_meas, s.stay_id IN (SELECT stay_id FROM enteral) AS is_fed FROM icustays s),
c AS (SELECT COUNT(*) AS a, COUNT(DISTINCT subject_id) AS ap, COUNT(*) FILTER (is_long) AS l,
             COUNT(DISTINCT subject_id) FILTER (is_long) AS lp, COUNT(*) FILTER (is_first) AS k,
             COUNT(DISTINCT subject_id) FILTER (is_first) AS kp, COUNT(*) FILTER (is_first AND is_fed) AS e,
             COUNT(*) FILTER (is_first AND is_meas) AS m, COUNT(*) FILTER (is_first AND is_meas AND is_fed) AS z FROM f)
SELECT 'total_icustays_all' AS metric, a AS value FROM c UNION ALL SELECT 'total_patients_all', ap FROM c
UNION ALL SELECT 'total_incl_icustays_los', l FROM c UNION ALL SELECT 'total_incl_patients_los', lp FROM c
UNION ALL SELECT 'total_excl_icustays_los', a - l FROM c UNION ALL SELECT 'total_excl_patients_los', ap - lp FROM c
UNION ALL SELECT 'total_incl_icustays_readm', k FROM c UNION ALL SELECT 'total_incl_patients_readm', kp FROM c
UNION ALL SELECT 'total_excl_icustays_readm', l - k FROM c UNION ALL SELECT 'total_excl_patients_readm', lp - kp FROM c
UNION ALL SELECT 'total_incl_icustays_entfeed', e FROM c UNION ALL SELECT 'total_excl_icustays_noentfeed', k - e FROM c
UNION ALL SELECT 'total_incl_icustays_glucm', m FROM c UNION ALL SELECT 'total_excl_icustays_noglucm', k - m FROM c
UNION ALL SELECT 'total_final_included_icustays', z FROM c""")
def subject_flow(spark, d):
    return study(spark, d).subject_flow()


@query("measurement_flow", """
SELECT 'total_glucose_m' AS metric, COUNT(*) AS value FROM raw
UNION ALL SELECT 'total_glucose_m_patients', COUNT(DISTINCT stay_id) FROM raw
UNION ALL SELECT 'total_duplicates_glucose_m', (SELECT COUNT(*) FROM raw) - COUNT(*) FROM (SELECT DISTINCT subject_id, stay_id, charttime FROM raw) k
UNION ALL SELECT 'total_invalid_glucose_m', COUNT(*) FROM raw WHERE valuenum > CASE WHEN itemid = 225664 THEN 500 ELSE 1000 END
UNION ALL SELECT 'total_valid_glucose_m', COUNT(*) FROM valid
UNION ALL SELECT 'total_valid_glucose_m_icustays', COUNT(DISTINCT stay_id) FROM valid
UNION ALL SELECT 'total_during_feeding_glucose_m', COUNT(*) FROM exposed
UNION ALL SELECT 'total_missing_cho_glucose_m', COUNT(*) FROM exposed WHERE rate_nut_cho IS NULL
UNION ALL SELECT 'total_zero_cho_glucose_m', COUNT(*) FROM exposed WHERE rate_nut_cho = 0
UNION ALL SELECT 'total_outside_feeding_glucose_m', (SELECT COUNT(*) FROM valid) - (SELECT COUNT(*) FROM exposed)
UNION ALL SELECT 'total_outside_feeding_glucose_m_patients', (SELECT COUNT(DISTINCT stay_id) FROM enteral) - (SELECT COUNT(DISTINCT stay_id) FROM fed)
UNION ALL SELECT 'total_final_glucose_m', COUNT(*) FROM fed
UNION ALL SELECT 'total_final_glucose_m_patients', COUNT(DISTINCT stay_id) FROM fed""")
def measurement_flow(spark, d):
    return study(spark, d).measurement_flow()


@query("included_ids", "SELECT DISTINCT subject_id, hadm_id, stay_id FROM fed")
def included_ids_query(spark, d):
    return included_ids(study(spark, d).fed)


@query("stay_class", f"SELECT {sel('event_id, stay_id, category, nutritiongroup, island AS nut_intervalnr, ~s AS starttime_seq, ~e AS endtime_seq')} FROM feeding")
def stay_class(spark, d):
    return rounded(study(spark, d).feeding.select("event_id", "stay_id", "category", "nutritiongroup", "nut_intervalnr",
                                                  "starttime_seq", "endtime_seq"))


@query("enteral_periods", f"SELECT {sel('event_id, stay_id, nutritiongroup, island AS nut_intervalnr, itemid AS itemid_nut, ~amount AS amount_nut')} FROM enteral")
def enteral_periods(spark, d):
    return rounded(study(spark, d).enteral.select("event_id", "stay_id", "nutritiongroup", "nut_intervalnr", "itemid_nut", "amount_nut"))


@query("clean_measurements", f"""SELECT {sel('event_id, stay_id, itemid, sample_type, ~valuenum, ~time_seq, ~time_dec, time_hbin, time_icudays, ~time_last_measurement, ~time_next_measurement')} FROM valid""")
def clean_measurements(spark, d):
    return rounded(study(spark, d).valid.select(
        "event_id", "stay_id", "itemid", "sample_type", "valuenum", "time_seq", "time_dec", "time_hbin", "time_icudays",
        "time_last_measurement", "time_next_measurement"))


@query("feeding_exposure", f"""SELECT {sel('event_id, stay_id, label_nut, itemid_nut, ~rate_nut, ~rate_nut_cho, ~starttime_nut_seq, ~endtime_nut_seq')} FROM exposed""")
def feeding_exposure(spark, d):
    return rounded(study(spark, d).exposed.select("event_id", "stay_id", "label_nut", "itemid_nut", "rate_nut", "rate_nut_cho",
                                                  "starttime_nut_seq", "endtime_nut_seq"))


@query("carbohydrate_rate", f"SELECT {sel('event_id, stay_id, ~rate_nut, ~rate_nut_cho')} FROM feeds_rate")
def carbohydrate_rate(spark, d):
    return rounded(nutrition.carbohydrate_rate(study(spark, d).enteral).select("event_id", "stay_id", "rate_nut", "rate_nut_cho"))


@query("dextrose_rates", f"SELECT {sel('stay_id, itemid AS itemid_dext, label AS label_dext, ordercat AS ordercat_dext, ~s AS starttime_dext_seq, ~e AS endtime_dext_seq, ~amount AS amount_total, ~rate_dext')} FROM dextrose")
def dextrose_rates(spark, d):
    return rounded(study(spark, d).dextrose)


@query("dextrose_exposure", f"""
SELECT {sel('v.event_id, v.stay_id, ~d.starttime_dext_seq, ~d.endtime_dext_seq, ~COALESCE(d.rate_dext, 0) AS rate_dext, d.label_dext, d.ordercat_dext')},
       CASE WHEN d.stay_id IS NULL THEN 'n' ELSE 'y' END AS dext_yn
FROM fed v LEFT JOIN dext_at d ON v.stay_id = d.stay_id AND v.time_seq = d.time_seq""")
def dextrose_exposure(spark, d):
    s = study(spark, d)
    out = exposures.attach_exposures(s.fed, [exposures.dextrose_kind(s.dextrose)])
    return rounded(out.select("event_id", "stay_id", "starttime_dext_seq", "endtime_dext_seq", "rate_dext", "label_dext",
                              "ordercat_dext", "dext_yn"))


@query("insulin_rates", f"SELECT {sel('stay_id, itemid AS itemid_insu, label AS label_insu, insu_cat, ~cs AS starttime_insu_seq_corr, ~ce AS endtime_insu_seq_corr, ~amount AS units_insu, ~rate_insu')} FROM insulin")
def insulin_rates(spark, d):
    return rounded(study(spark, d).insulin.select("stay_id", "itemid_insu", "label_insu", "insu_cat", "starttime_insu_seq_corr",
                                                  "endtime_insu_seq_corr", "units_insu", "rate_insu"))


def _insulin_sql(view: str) -> str:
    return f"""
SELECT {sel('v.event_id, v.stay_id, ~i.starttime_insu_seq_corr, ~i.endtime_insu_seq_corr, i.insu_cat, ~COALESCE(i.rate_insu, 0) AS rate_insu')},
       CASE WHEN i.stay_id IS NULL THEN 'n' ELSE 'y' END AS insu_yn
FROM fed v LEFT JOIN {view} i ON v.stay_id = i.stay_id AND v.time_seq = i.time_seq"""


INSULIN_COLUMNS = ("event_id", "stay_id", "starttime_insu_seq_corr", "endtime_insu_seq_corr", "insu_cat", "rate_insu", "insu_yn")


@query("insulin_exposure_sum", _insulin_sql("insu_at"))
def insulin_exposure_sum(spark, d):
    s = study(spark, d)
    return rounded(exposures.attach_exposures(s.fed, [exposures.insulin_kind(s.insulin)]).select(*INSULIN_COLUMNS))


@query("insulin_exposure_hull", _insulin_sql("insu_hull"))
def insulin_exposure_hull(spark, d):
    s = study(spark, d)
    return rounded(exposures.insulin_hull(s.fed, s.insulin).select(*INSULIN_COLUMNS))


@query("daily_total", f"""
SELECT {sel('v.event_id, v.stay_id, v.time_icudays, ~COALESCE(u.unitsperday_insu, 0) AS unitsperday_insu')}
FROM fed v LEFT JOIN insu_daily u ON v.stay_id = u.stay_id AND v.time_icudays = u.time_icudays""")
def daily_total(spark, d):
    s = study(spark, d)
    out = exposures.attach_daily(s.fed, exposures.daily_total(s.insulin))
    return rounded(out.select("event_id", "stay_id", "time_icudays", "unitsperday_insu"))


@query("score_periods", f"SELECT {sel('stay_id, intnr, ~s AS starttime_ras_seq, ~e AS endtime_ras_seq, ~ras_score, ras_label')} FROM score_runs")
def score_periods(spark, d):
    return rounded(study(spark, d).sedation.select("stay_id", "intnr", "starttime_ras_seq", "endtime_ras_seq", "ras_score", "ras_label"))


@query("score_at", f"""
SELECT {sel('v.event_id, v.stay_id, ~r.ras_score, r.ras_label')}
FROM fed v LEFT JOIN score_at r ON v.stay_id = r.stay_id AND v.time_seq = r.time_seq""")
def score_at(spark, d):
    s = study(spark, d)
    out = exposures.attach_exposures(s.fed, [exposures.score_kind(s.sedation)])
    return rounded(out.select("event_id", "stay_id", "ras_score", "ras_label"))


@query("status_at", f"""
SELECT v.event_id, v.stay_id, x.ventilation_status, {VENT_CLASS} AS ventilation_status_cat
FROM fed v LEFT JOIN vent_at x ON v.stay_id = x.stay_id AND v.time_seq = x.time_seq""")
def status_at(spark, d):
    s = study(spark, d)
    return exposures.status_at(s.fed, s.ventilation).select("event_id", "stay_id", "ventilation_status", "ventilation_status_cat")


@query("status_at_first", f"""
SELECT v.event_id, v.stay_id, x.ventilation_status, {VENT_CLASS} AS ventilation_status_cat
FROM fed v LEFT JOIN (
  SELECT stay_id, time_seq, ventilation_status FROM (
    SELECT v.stay_id, v.time_seq, x.ventilation_status, ROW_NUMBER() OVER (PARTITION BY v.stay_id, v.time_seq ORDER BY x.s, x.e, x.ventilation_status) AS rn
    FROM fed v JOIN vent x ON v.stay_id = x.stay_id AND v.time_seq > x.s AND v.time_seq <= x.e) WHERE rn = 1) x
  ON v.stay_id = x.stay_id AND v.time_seq = x.time_seq""")
def status_at_first(spark, d):
    s = study(spark, d)
    return exposures.status_at(s.fed, s.ventilation, True).select("event_id", "stay_id", "ventilation_status", "ventilation_status_cat")


@query("drug_intervals", f"SELECT stay_id, interval_no, {sel('~s AS cort_interval_starttime_seq, ~e AS cort_interval_endtime_seq')} FROM drug_merged")
def drug_intervals(spark, d):
    s = study(spark, d)
    return rounded(exposures.drug_periods(s.tables["pharmacy"], s.cohort, s.hot))


@query("drug_exposure", f"""
SELECT {sel('v.event_id, v.stay_id, ~g.cort_interval_starttime_seq, ~g.cort_interval_endtime_seq')},
       CASE WHEN g.stay_id IS NULL THEN 'n' ELSE 'y' END AS glucocorticoid_yn
FROM fed v LEFT JOIN drug_at g ON v.stay_id = g.stay_id AND v.time_seq = g.time_seq""")
def drug_exposure(spark, d):
    s = study(spark, d)
    out = exposures.attach_exposures(s.fed, [exposures.drug_kind(s.glucocorticoid)])
    return rounded(out.select("event_id", "stay_id", "cort_interval_starttime_seq", "cort_interval_endtime_seq", "glucocorticoid_yn"))


@query("administered_doses", f"""
SELECT {sel(f"c.stay_id, m.hadm_id, m.pharmacy_id, m.medication, p.medication AS medication_pharm, p.route, p.frequency, ~{_seq('m.charttime')} AS charttime_seq, ~{_seq('COALESCE(m.scheduletime, m.charttime)')} AS scheduletime_seq")}
FROM (SELECT * FROM emar WHERE {STEROID} AND {NOT_STUDY} AND event_txt = 'Administered' AND pharmacy_id IS NOT NULL) m
JOIN cohort c ON m.hadm_id = c.hadm_id
JOIN (SELECT * FROM pharmacy WHERE {STEROID} AND route IN ('IV', 'PO', 'ORAL', 'PO/NG')) p
  ON m.hadm_id = p.hadm_id AND m.pharmacy_id = p.pharmacy_id
WHERE {_seq('m.charttime')} BETWEEN {_seq('c.intime')} AND {_seq('c.outtime')}""")
def administered_doses(spark, d):
    s = study(spark, d)
    out = exposures.administered_doses(s.tables["emar"], s.tables["pharmacy"], s.cohort)
    return rounded(out.select("stay_id", "hadm_id", "pharmacy_id", "medication", "medication_pharm", "route", "frequency",
                              "charttime_seq", "scheduletime_seq"))


# stay facts

@query("age_at", """
SELECT s.stay_id, CAST(EXTRACT(year FROM s.intime) - p.anchor_year + p.anchor_age AS BIGINT) AS age
FROM icustays s LEFT JOIN patients p ON s.subject_id = p.subject_id""")
def age_at(spark, d):
    t = tables(spark, d)
    df = t["icustays"].join(t["patients"], "subject_id", "left")
    return df.select("stay_id", clock.age_at(F.col("intime"), F.col("anchor_year"), F.col("anchor_age")).cast("long").alias("age"))


@query("map_category", """
SELECT a.hadm_id, CASE p WHEN 'WHITE' THEN 'White' WHEN 'BLACK/AFRICAN AMERICAN' THEN 'Black' WHEN 'ASIAN' THEN 'Asian'
         WHEN 'UNKNOWN' THEN 'Unknown' WHEN 'HISPANIC/LATINO' THEN 'Hispanic' ELSE p END AS race_cat,
       CASE WHEN admission_type IN ('URGENT', 'EW EMER.', 'OBSERVATION ADMIT') THEN 'Emergency'
            WHEN admission_type IN ('ELECTIVE', 'SURGICAL SAME DAY ADMISSION') THEN 'Elective' END AS admtype_cat
FROM (SELECT *, SPLIT_PART(race, ' -', 1) AS p FROM admissions) a""")
def map_category(spark, d):
    return tables(spark, d)["admissions"].select(
        "hadm_id", attributes.race_category(F.col("race")).alias("race_cat"),
        attributes.admission_category(F.col("admission_type")).alias("admtype_cat"))


@query("died_flag", """
SELECT a.hadm_id, CASE WHEN date_diff('day', CAST(a.dischtime AS DATE), p.dod) <= 0 OR a.discharge_location IN ('HOSPICE', 'DIED')
       THEN 'y' ELSE 'n' END AS died_hospstay_yn
FROM admissions a LEFT JOIN patients p ON a.subject_id = p.subject_id""")
def died_flag(spark, d):
    t = tables(spark, d)
    df = t["admissions"].join(t["patients"].select("subject_id", "dod"), "subject_id", "left")
    return df.select("hadm_id", attributes.died_in_hospital(F.col("dod"), F.col("dischtime"),
                                                            F.col("discharge_location")).alias("died_hospstay_yn"))


FACT_COLUMNS = ("stay_id", "sex", "race_cat", "died_hospstay_yn", "diabetes_status", "admtype_cat")


@query("stay_facts", f"""
SELECT {', '.join(FACT_COLUMNS)}, CAST(age AS BIGINT) AS age, CAST(sofa AS BIGINT) AS sofa, CAST(oasis AS BIGINT) AS oasis,
       CAST(charlson_comorbidity_index AS BIGINT) AS charlson_comorbidity_index FROM facts""")
def stay_facts(spark, d):
    s = study(spark, d)
    df = attributes.attach_top_flags(attributes.stay_attributes(s.cohort, s.tables), s.tables["charlson"], s.cohort)
    return df.select(*FACT_COLUMNS, *[F.col(c).cast("long").alias(c) for c in ("age", "sofa", "oasis", "charlson_comorbidity_index")])


STUDY_TEXT = ("sample_type", "dext_yn", "insu_yn", "glucocorticoid_yn", "ras_label", "ventilation_status", "ventilation_status_cat",
              "sex", "race_cat", "died_hospstay_yn", "diabetes_status", "admtype_cat", "age_cat", "rate_dext_cat", "rate_insu_cat",
              "rate_nut_cho_cat")
STUDY_NUMBERS = ("time_seq", "time_dec", "glucose_value_mmolL", "rate_nut_cho", "rate_dext", "rate_insu", "unitsperday_insu", "ras_score",
                 "starttime_nut_seq", "endtime_nut_seq", "starttime_dext_seq", "starttime_insu_seq_corr", "cort_interval_starttime_seq",
                 "endtime_dext_seq", "endtime_insu_seq_corr", "cort_interval_endtime_seq", "time_next_measurement", "los")
STUDY_COUNTS = ("subject_id", "age", "sofa", "oasis", "charlson_comorbidity_index")


@query("measurement_table", f"""
SELECT stay_id, time_hbin, time_icudays, {', '.join(STUDY_TEXT)}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in STUDY_COUNTS)},
       {sel(', '.join('~' + c for c in STUDY_NUMBERS))} FROM study""")
def measurement_table(spark, d):
    return rounded(study(spark, d).table.select("stay_id", "time_hbin", "time_icudays", *STUDY_TEXT, *STUDY_NUMBERS,
                                                *[F.col(c).cast("long").alias(c) for c in STUDY_COUNTS]))


SOURCE_TIMES = ("charttime", "storetime", "intime", "outtime")
SOURCE_TEXT = ("glucose_unit", "label_nut", "itemid_nut", "label_dext", "ordercat_dext", "insu_cat", "ordercategoryname")
SOURCE_NUMBERS = ("time_seq", "glucose_value", "rate_nut", "time_last_measurement")
DIABETES = "CASE WHEN diabetes_without_cc = 1 OR diabetes_with_cc = 1 THEN 1 WHEN diabetes_without_cc = 0 AND diabetes_with_cc = 0 THEN 0 END"


@query("measurement_sources", f"""
, included AS (SELECT DISTINCT hadm_id FROM fed),
flags AS (SELECT hadm_id, {', '.join(FLAGS)}, {DIABETES} AS diabetes_charlson FROM charlson),
totals AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS name, SUM({c}) AS total, {k} AS pos FROM flags WHERE hadm_id IN (SELECT hadm_id FROM included)"
    for k, c in enumerate((*FLAGS, 'diabetes_charlson')))}),
top AS (SELECT name, ROW_NUMBER() OVER (ORDER BY total DESC, pos) AS rank FROM totals),
flagged AS (SELECT c.stay_id, STRING_AGG(t.name || '=' || COALESCE(CASE t.name {' '.join(
    f"WHEN '{c}' THEN CAST(f.{c} AS VARCHAR)" for c in (*FLAGS, 'diabetes_charlson'))} END, 'NA'), ',' ORDER BY t.rank) AS comorbidities
  FROM cohort c CROSS JOIN (SELECT * FROM top WHERE rank <= 5) t LEFT JOIN flags f ON c.hadm_id = f.hadm_id GROUP BY c.stay_id),
orders AS (SELECT v.stay_id, v.time_seq, STRING_AGG(COALESCE(i.ordercategoryname, 'NA'), '_' ORDER BY i.cs, i.ce, i.itemid, i.amount) AS ordercategoryname
  FROM fed v JOIN insulin i ON v.stay_id = i.stay_id AND v.time_seq > i.cs AND v.time_seq <= i.ce GROUP BY v.stay_id, v.time_seq)
SELECT v.stay_id, v.hadm_id, v.itemid AS glucose_itemid,
       {', '.join(f"strftime(v.{c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in SOURCE_TIMES)},
       {sel('~v.time_seq AS time_seq, ~v.valuenum AS glucose_value, ~v.rate_nut AS rate_nut, ~v.time_last_measurement AS time_last_measurement')},
       m.valueuom AS glucose_unit, v.label_nut, v.itemid_nut, d.label_dext, d.ordercat_dext, i.insu_cat, o.ordercategoryname,
       CAST(p.dod AS VARCHAR) AS dod, g.comorbidities
FROM fed v JOIN chartevents m ON v.event_id = m.event_id AND v.itemid = m.itemid
  LEFT JOIN dext_at d ON v.stay_id = d.stay_id AND v.time_seq = d.time_seq
  LEFT JOIN insu_at i ON v.stay_id = i.stay_id AND v.time_seq = i.time_seq
  LEFT JOIN orders o ON v.stay_id = o.stay_id AND v.time_seq = o.time_seq
  LEFT JOIN vent_at x ON v.stay_id = x.stay_id AND v.time_seq = x.time_seq
  LEFT JOIN patients p ON v.subject_id = p.subject_id LEFT JOIN flagged g ON v.stay_id = g.stay_id""")
def measurement_sources(spark, d):
    """The columns of the measurement table that `measurement_table` leaves out: where each row comes from, the texts of what was
    running, and the commonest comorbidities, named in order of frequency."""
    df = study(spark, d).table
    names = [c for c in df.columns if c in (*FLAGS, "diabetes_charlson")]
    flags = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NA"))) for c in names]
    return rounded(df.select(
        "stay_id", "hadm_id", "glucose_itemid", *SOURCE_TEXT, *SOURCE_NUMBERS, F.col("dod").cast("string").alias("dod"),
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in SOURCE_TIMES],
        F.concat_ws(",", *flags).alias("comorbidities")))
