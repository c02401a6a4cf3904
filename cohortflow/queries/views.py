"""The study steps in plain SQL for DuckDB, on the stand-in tables. Written apart from the Spark code."""

from __future__ import annotations

from ..sources import lookups as L

MIN_LOS = 6


def _h(a: str, b: str) -> str:
    return f"date_diff('microsecond', {a}, {b}) / 3.6e9"


def _seq(ts: str, origin: str = "c.intime") -> str:
    return _h(f"date_trunc('day', {origin})", ts)


def _values(rows) -> str:
    def lit(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


def _strict(agg: str, c: str) -> str:
    return f"CASE WHEN COUNT(*) = COUNT({c}) THEN {agg}({c}) END"


def cut_sql(c: str, breaks: str) -> str:
    lo, mid, hi = breaks.split()
    return (f"CASE WHEN {c} <= {lo} THEN '[-Inf,{lo}]' WHEN {c} <= {mid} THEN '({lo},{mid}]' "
            f"WHEN {c} <= {hi} THEN '({mid},{hi}]' WHEN {c} > {hi} THEN '({hi}, Inf]' END")


FACTORS = [(item, f) for _, ids, f in L.NUTRITION_FACTORS for item in ids]
PREFERENCE = "CASE itemid WHEN 220621 THEN 1 WHEN 226537 THEN 2 ELSE 3 END"
CEILING = "CASE WHEN itemid = 225664 THEN 500 ELSE 1000 END"
STEROID = ("(LOWER(medication) LIKE '%dexamethasone%' OR LOWER(medication) LIKE '%cortisone%' "
           "OR LOWER(medication) LIKE '%prednisolone%' OR LOWER(medication) LIKE '%prednisone%')")
NOT_STUDY = "LOWER(medication) NOT LIKE '%study%' AND LOWER(medication) NOT LIKE '%placebo%'"
VENT_CLASS = ("CASE WHEN ventilation_status IN ('InvasiveVent', 'Tracheostomy') THEN 'invasive' "
              "WHEN ventilation_status IN ('NonInvasiveVent', 'HFNC', 'SupplementalOxygen') THEN 'noninvasive' "
              "WHEN ventilation_status = 'None' THEN 'none' WHEN ventilation_status IS NULL THEN 'NaN' END")

STUDY = {
    "cohort": f"""
SELECT * FROM (SELECT *, MIN(intime) OVER (PARTITION BY subject_id) AS first_in FROM icustays WHERE los >= {MIN_LOS})
WHERE intime = first_in""",
    "nut_events": f"""
SELECT i.event_id, i.stay_id, i.itemid, d.label, d.category, i.ordercategoryname, i.amount,
       {_seq('i.starttime')} AS s, {_seq('i.endtime')} AS e, {_seq('c.intime')} AS intime_seq, {_seq('c.outtime')} AS outtime_seq
FROM inputevents i JOIN d_items d ON i.itemid = d.itemid JOIN cohort c ON i.stay_id = c.stay_id
WHERE i.amount > 0 AND (LOWER(d.category) LIKE '%nutrition%' OR d.label = 'PO Intake')""",
    "nut_reach": """
SELECT *, MAX(e) OVER (PARTITION BY stay_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
FROM nut_events""",
    "nut_islands": """
SELECT *, CAST(SUM(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER
       (PARTITION BY stay_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
FROM nut_reach""",
    "feeding": """
SELECT *, CASE WHEN BOOL_AND(category IN ('Fluids/Intake', 'Nutrition - Supplements')) OVER w THEN 'Oral intake only'
               WHEN BOOL_AND(category IN ('Nutrition - Enteral', 'Nutrition - Supplements')) OVER w THEN 'Enteral feeding only'
               WHEN BOOL_AND(category IN ('Nutrition - Parenteral', 'Nutrition - Supplements')) OVER w THEN 'Parenteral feeding only'
               ELSE 'Combined' END AS nutritiongroup
FROM nut_islands WINDOW w AS (PARTITION BY stay_id)""",
    "enteral": """
SELECT * FROM (SELECT *, BOOL_AND(category IN ('Nutrition - Enteral', 'Nutrition - Supplements'))
                         OVER (PARTITION BY stay_id, island) AS pure
               FROM feeding WHERE nutritiongroup IN ('Combined', 'Enteral feeding only'))
WHERE pure""",
    "measured": """
SELECT g.event_id, g.subject_id, g.hadm_id, g.stay_id, g.itemid, g.storetime, g.valuenum, c.intime, c.outtime, c.los,
       CASE WHEN g.storetime < g.charttime THEN g.storetime WHEN g.storetime >= g.charttime THEN g.charttime END AS charttime
FROM chartevents g JOIN cohort c ON g.stay_id = c.stay_id
WHERE g.itemid IN (220621, 226537, 225664) AND g.charttime BETWEEN c.intime AND c.outtime""",
    "raw": "\nSELECT * FROM measured WHERE stay_id IN (SELECT stay_id FROM enteral)",
    "deduped": f"""
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id, stay_id, charttime
                      ORDER BY {PREFERENCE}, storetime NULLS FIRST, valuenum NULLS FIRST) AS rn FROM raw)
WHERE rn = 1 AND valuenum <= {CEILING}""",
    "timed": f"""
SELECT *, {_seq('charttime', 'intime')} AS time_seq, {_seq('charttime', 'charttime')} AS time_dec,
       CAST(FLOOR({_seq('charttime', 'charttime')}) AS BIGINT) AS time_hbin,
       CAST(FLOOR({_seq('charttime', 'intime')} / 24) AS BIGINT) AS time_icudays,
       CASE itemid WHEN 220621 THEN 'Lab (serum)' WHEN 226537 THEN 'Lab (whole blood)' ELSE 'Fingerstick' END AS sample_type
FROM deduped""",
    "valid": """
SELECT *, time_seq - LAG(time_seq) OVER w AS time_last_measurement, LEAD(time_seq) OVER w - time_seq AS time_next_measurement
FROM timed WINDOW w AS (PARTITION BY stay_id ORDER BY time_seq NULLS FIRST)""",
    "factors": f"\nSELECT * FROM (VALUES {_values(FACTORS)}) AS f(itemid, factor)",
    "feeds_rate": """
SELECT e.*, e.amount / (e.e - e.s) AS rate_nut, e.amount / (e.e - e.s) * f.factor AS rate_nut_cho
FROM enteral e LEFT JOIN factors f ON e.itemid = f.itemid WHERE e.e > e.s""",
    "feed_at": f"""
SELECT v.stay_id, v.time_seq, {_strict('SUM', 'f.rate_nut_cho')} AS rate_nut_cho, {_strict('SUM', 'f.rate_nut')} AS rate_nut,
       STRING_AGG(f.label, '_' ORDER BY f.s, f.e, f.itemid) AS label_nut,
       STRING_AGG(CAST(f.itemid AS VARCHAR), '_' ORDER BY f.s, f.e, f.itemid) AS itemid_nut,
       MIN(f.s) AS starttime_nut_seq, MAX(f.e) AS endtime_nut_seq
FROM valid v JOIN feeds_rate f ON v.stay_id = f.stay_id AND v.time_seq > f.s AND v.time_seq <= f.e
GROUP BY v.stay_id, v.time_seq""",
    "exposed": "\nSELECT v.*, f.* EXCLUDE (stay_id, time_seq) FROM valid v JOIN feed_at f ON v.stay_id = f.stay_id AND v.time_seq = f.time_seq",
    "fed": "\nSELECT * FROM exposed WHERE rate_nut_cho IS NOT NULL AND rate_nut_cho <> 0",
    "given": f"""
SELECT i.event_id, i.stay_id, i.itemid, d.label, d.category, i.amount, i.rate, i.rateuom, i.ordercategoryname,
       i.ordercategorydescription AS ordercat, {_seq('i.starttime')} AS s, {_seq('i.endtime')} AS e
FROM inputevents i JOIN d_items d ON i.itemid = d.itemid JOIN cohort c ON i.stay_id = c.stay_id WHERE i.amount > 0""",
    "dextrose": """
SELECT *, CASE
  WHEN label = 'Dextrose PN' THEN CASE WHEN e > s THEN amount / (e - s) END
  WHEN rateuom = 'mL/hour' AND ordercat IN ('Continuous Med', 'Continuous IV') THEN
    rate * CASE label WHEN 'Dextrose 5%' THEN 0.05 WHEN 'Dextrose 10%' THEN 0.1 WHEN 'Dextrose 20%' THEN 0.2
                      WHEN 'Dextrose 40%' THEN 0.4 WHEN 'Dextrose 50%' THEN 0.5 END
  WHEN ordercat IN ('Drug Push', 'Bolus') THEN
    amount * CASE label WHEN 'Dextrose 5%' THEN 0.05 WHEN 'Dextrose 10%' THEN 0.1 WHEN 'Dextrose 20%' THEN 0.2
                        WHEN 'Dextrose 40%' THEN 0.4 WHEN 'Dextrose 50%' THEN 0.5 END / 0.1667 END AS rate_dext
FROM given WHERE LOWER(label) LIKE '%dextrose%'""",
    "dext_at": f"""
SELECT v.stay_id, v.time_seq, MIN(d.s) AS starttime_dext_seq, MAX(d.e) AS endtime_dext_seq,
       {_strict('SUM', 'd.rate_dext')} AS rate_dext,
       STRING_AGG(d.label, '_' ORDER BY d.s, d.e, d.itemid, d.amount) AS label_dext,
       STRING_AGG(COALESCE(d.ordercat, 'NA'), '_' ORDER BY d.s, d.e, d.itemid, d.amount) AS ordercat_dext
FROM fed v JOIN dextrose d ON v.stay_id = d.stay_id AND v.time_seq > d.s AND v.time_seq <= d.e
GROUP BY v.stay_id, v.time_seq""",
    "insulin": """
SELECT *, amount / (ce - cs) AS rate_insu FROM (
  SELECT *, s + CASE WHEN tail IS NULL THEN 0 ELSE 0.5 END AS cs, e + COALESCE(tail, 0) AS ce,
         CASE WHEN ordercat IN ('Continuous Med', 'Continuous IV') THEN 'infusion' WHEN ordercat = 'Drug Push' THEN 'bolus' END AS insu_cat
  FROM (SELECT *, CASE label WHEN 'Insulin - Regular' THEN 4 WHEN 'Insulin - Humalog' THEN 4 WHEN 'Insulin - Novolog' THEN 2
                             WHEN 'Insulin - NPH' THEN 10 WHEN 'Insulin - 70/30' THEN 10 WHEN 'Insulin - Humalog 75/25' THEN 10
                             WHEN 'Insulin - U500' THEN 10 WHEN 'Insulin - Glargine' THEN 12 END AS tail
        FROM given WHERE LOWER(label) LIKE '%insulin%' AND category = 'Medications'))""",
    "insu_at": f"""
SELECT v.stay_id, v.time_seq, MIN(i.cs) AS starttime_insu_seq_corr, MAX(i.ce) AS endtime_insu_seq_corr,
       STRING_AGG(COALESCE(i.insu_cat, 'NA'), '_' ORDER BY i.cs, i.ce, i.itemid, i.amount) AS insu_cat,
       {_strict('SUM', 'i.rate_insu')} AS rate_insu
FROM fed v JOIN insulin i ON v.stay_id = i.stay_id AND v.time_seq > i.cs AND v.time_seq <= i.ce
GROUP BY v.stay_id, v.time_seq""",
    "insu_hull": f"""
SELECT h.stay_id, h.time_seq, h.cs AS starttime_insu_seq_corr, h.ce AS endtime_insu_seq_corr,
       STRING_AGG(COALESCE(i.insu_cat, 'NA'), '_' ORDER BY i.itemid, i.amount) AS insu_cat,
       {_strict('SUM', 'i.rate_insu')} AS rate_insu
FROM (SELECT stay_id, time_seq, starttime_insu_seq_corr AS cs, endtime_insu_seq_corr AS ce FROM insu_at) h
LEFT JOIN insulin i ON h.stay_id = i.stay_id AND h.cs = i.cs AND h.ce = i.ce
GROUP BY h.stay_id, h.time_seq, h.cs, h.ce""",
    "insu_daily": f"""
SELECT stay_id, CAST(FLOOR(s / 24) AS BIGINT) AS time_icudays, {_strict('SUM', 'amount')} AS unitsperday_insu
FROM insulin GROUP BY 1, 2""",
    "score_points": f"""
SELECT g.stay_id, {_seq('g.charttime')} AS t, {_seq('c.outtime')} AS out_seq, g.valuenum, g.value
FROM chartevents g JOIN cohort c ON g.stay_id = c.stay_id
WHERE g.itemid = 228096 AND g.charttime BETWEEN c.intime AND c.outtime""",
    "score_lasting": """
SELECT *, COALESCE(LEAD(t) OVER w, out_seq) AS t2,
       CASE WHEN valuenum IS DISTINCT FROM LAG(valuenum) OVER w OR ROW_NUMBER() OVER w = 1 THEN 1 ELSE 0 END AS fresh
FROM score_points WINDOW w AS (PARTITION BY stay_id ORDER BY t, valuenum)""",
    "score_runs": """
SELECT stay_id, intnr, MIN(t) AS s, MAX(t2) AS e, AVG(valuenum) AS ras_score, MIN(value) AS ras_label
FROM (SELECT *, CAST(SUM(fresh) OVER (PARTITION BY stay_id ORDER BY t, valuenum ROWS UNBOUNDED PRECEDING) AS BIGINT) AS intnr
      FROM score_lasting) GROUP BY stay_id, intnr""",
    "score_at": """
SELECT stay_id, time_seq, ras_score, ras_label FROM (
  SELECT v.stay_id, v.time_seq, r.ras_score, r.ras_label,
         ROW_NUMBER() OVER (PARTITION BY v.stay_id, v.time_seq ORDER BY r.s, r.intnr) AS rn
  FROM fed v JOIN score_runs r ON v.stay_id = r.stay_id AND v.time_seq > r.s AND v.time_seq <= r.e) WHERE rn = 1""",
    "vent": f"""
SELECT x.stay_id, x.ventilation_status, {_seq('x.starttime')} AS s, {_seq('x.endtime')} AS e
FROM ventilation x JOIN cohort c ON x.stay_id = c.stay_id""",
    "vent_at": """
SELECT v.stay_id, v.time_seq, x.ventilation_status FROM fed v JOIN vent x
  ON v.stay_id = x.stay_id AND v.time_seq > x.s AND v.time_seq <= x.e""",
    "drug_raw": f"""
SELECT c.stay_id, p.pharmacy_id, {_seq('p.starttime')} AS s, {_seq('p.stoptime')} AS e,
       {_seq('c.intime')} AS lo, {_seq('c.outtime')} AS hi
FROM pharmacy p JOIN cohort c ON p.hadm_id = c.hadm_id
WHERE {STEROID} AND {NOT_STUDY} AND p.pharmacy_id IS NOT NULL AND p.route IN ('IV', 'PO', 'ORAL', 'PO/NG')""",
    "drug_acting": """
SELECT stay_id, CASE WHEN LEAST(s, e) < 0 THEN 0 ELSE LEAST(s, e) END AS s, GREATEST(s, e) + 24 AS e
FROM drug_raw WHERE NOT (e <= lo OR s >= hi) OR (s <= lo AND e >= hi)""",
    "drug_merged": """
SELECT stay_id, island + 1 AS interval_no, MIN(s) AS s, MAX(e) AS e FROM (
  SELECT *, CAST(SUM(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER
              (PARTITION BY stay_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
  FROM (SELECT *, MAX(e) OVER (PARTITION BY stay_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
        FROM drug_acting))
GROUP BY stay_id, island""",
    "drug_at": """
SELECT v.stay_id, v.time_seq, MIN(d.s) AS cort_interval_starttime_seq, MAX(d.e) AS cort_interval_endtime_seq
FROM fed v JOIN drug_merged d ON v.stay_id = d.stay_id AND v.time_seq > d.s AND v.time_seq <= d.e
GROUP BY v.stay_id, v.time_seq""",
    "facts": f"""
SELECT c.stay_id, c.subject_id, c.hadm_id, p.gender AS sex, EXTRACT(year FROM c.intime) - p.anchor_year + p.anchor_age AS age,
       CASE WHEN SPLIT_PART(a.race, ' -', 1) = 'WHITE' THEN 'White' WHEN SPLIT_PART(a.race, ' -', 1) = 'BLACK/AFRICAN AMERICAN' THEN 'Black'
            WHEN SPLIT_PART(a.race, ' -', 1) = 'ASIAN' THEN 'Asian' WHEN SPLIT_PART(a.race, ' -', 1) = 'UNKNOWN' THEN 'Unknown'
            WHEN SPLIT_PART(a.race, ' -', 1) = 'HISPANIC/LATINO' THEN 'Hispanic' ELSE SPLIT_PART(a.race, ' -', 1) END AS race_cat,
       CASE WHEN date_diff('day', CAST(a.dischtime AS DATE), p.dod) <= 0 OR a.discharge_location IN ('HOSPICE', 'DIED')
            THEN 'y' ELSE 'n' END AS died_hospstay_yn,
       CASE WHEN c.hadm_id IN (SELECT hadm_id FROM diagnoses_icd WHERE REGEXP_MATCHES(icd_code, '^(250|E1[0-4])[0-9]'))
            THEN 'y' ELSE 'n' END AS diabetes_status,
       CASE WHEN a.admission_type IN ('URGENT', 'EW EMER.', 'OBSERVATION ADMIT', 'AMBULATORY OBSERVATION', 'DIRECT EMER.',
                                      'DIRECT OBSERVATION', 'EU OBSERVATION') THEN 'Emergency'
            WHEN a.admission_type IN ('ELECTIVE', 'SURGICAL SAME DAY ADMISSION') THEN 'Elective' END AS admtype_cat,
       f.sofa, o.oasis, ch.charlson_comorbidity_index
FROM cohort c LEFT JOIN patients p ON c.subject_id = p.subject_id LEFT JOIN admissions a ON c.hadm_id = a.hadm_id
     LEFT JOIN first_day_sofa f ON c.stay_id = f.stay_id LEFT JOIN oasis o ON c.stay_id = o.stay_id
     LEFT JOIN charlson ch ON c.hadm_id = ch.hadm_id""",
    "study": f"""
SELECT v.stay_id, v.time_seq, v.time_dec, v.time_hbin, v.time_icudays, v.time_next_measurement, v.sample_type, v.los,
       v.valuenum / 18.0182 AS glucose_value_mmolL, v.rate_nut_cho, v.starttime_nut_seq, v.endtime_nut_seq,
       d.starttime_dext_seq, d.endtime_dext_seq, COALESCE(d.rate_dext, 0) AS rate_dext,
       CASE WHEN d.stay_id IS NULL THEN 'n' ELSE 'y' END AS dext_yn,
       i.starttime_insu_seq_corr, i.endtime_insu_seq_corr, COALESCE(i.rate_insu, 0) AS rate_insu,
       CASE WHEN i.stay_id IS NULL THEN 'n' ELSE 'y' END AS insu_yn, COALESCE(u.unitsperday_insu, 0) AS unitsperday_insu,
       r.ras_score, r.ras_label, g.cort_interval_starttime_seq, g.cort_interval_endtime_seq,
       CASE WHEN g.stay_id IS NULL THEN 'n' ELSE 'y' END AS glucocorticoid_yn,
       x.ventilation_status, {VENT_CLASS} AS ventilation_status_cat,
       f.subject_id, f.sex, f.age, f.race_cat, f.died_hospstay_yn, f.diabetes_status, f.admtype_cat, f.sofa, f.oasis,
       f.charlson_comorbidity_index,
       {cut_sql('f.age', '55 65 75')} AS age_cat, {cut_sql('COALESCE(d.rate_dext, 0)', '0 0.5 2')} AS rate_dext_cat,
       {cut_sql('COALESCE(i.rate_insu, 0)', '0 1.5 3')} AS rate_insu_cat, {cut_sql('v.rate_nut_cho', '4.5 6.5 8.5')} AS rate_nut_cho_cat
FROM fed v
  LEFT JOIN dext_at d ON v.stay_id = d.stay_id AND v.time_seq = d.time_seq
  LEFT JOIN insu_at i ON v.stay_id = i.stay_id AND v.time_seq = i.time_seq
  LEFT JOIN insu_daily u ON v.stay_id = u.stay_id AND v.time_icudays = u.time_icudays
  LEFT JOIN score_at r ON v.stay_id = r.stay_id AND v.time_seq = r.time_seq
  LEFT JOIN drug_at g ON v.stay_id = g.stay_id AND v.time_seq = g.time_seq
  LEFT JOIN vent_at x ON v.stay_id = x.stay_id AND v.time_seq = x.time_seq
  LEFT JOIN facts f ON v.stay_id = f.stay_id""",
    "model_rows": """
SELECT * FROM study WHERE glucose_value_mmolL IS NOT NULL AND time_hbin IS NOT NULL AND diabetes_status IS NOT NULL
  AND age_cat IS NOT NULL AND sex IS NOT NULL AND rate_insu_cat IS NOT NULL AND rate_dext_cat IS NOT NULL
  AND glucocorticoid_yn IS NOT NULL AND rate_nut_cho_cat IS NOT NULL""",
    "grouped_rows": """
SELECT *, CASE WHEN MAX(unitsperday_insu) OVER w = 0 THEN 'no'
               WHEN AVG(unitsperday_insu) OVER w > 0 AND AVG(unitsperday_insu) OVER w <= 35 THEN '0-35 units/day'
               WHEN AVG(unitsperday_insu) OVER w > 35 AND AVG(unitsperday_insu) OVER w <= 70 THEN '35-70 units/day'
               WHEN AVG(unitsperday_insu) OVER w > 70 THEN '>70 units/day' END AS insu_requirement
FROM study WINDOW w AS (PARTITION BY stay_id)""",
}
