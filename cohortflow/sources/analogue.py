"""Stand-ins for the clinical tables, derived from the driver's tables.

Every row of ``events`` becomes part of a stay: the 8-day blocks of a user's events are that user's stays.
The text is plain SQL that Spark and DuckDB both run; only ``base`` differs, where the engines name the same
clock functions differently. The operators under test are not in here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import cut

SOURCES = ("events", "customer", "orders", "lineitem", "part")

_BASE = """
SELECT event_id, user_id, event_type, value, ts, {hour_ts} AS hour_ts, {t} AS t,
       user_id * 10 + CAST(FLOOR({t} / 192e0) AS BIGINT) AS stay_id
FROM events"""

BASE_SPARK = _BASE.format(hour_ts="CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ)",
                          t="(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 3.6e9)")
BASE_DUCKDB = _BASE.format(hour_ts="date_trunc('hour', ts)",
                           t="(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 3.6e9)")

VIEWS = {
    "icustays": """
SELECT user_id AS subject_id, stay_id * 2 + 1 AS hadm_id, stay_id, MIN(ts) AS intime, MAX(ts) AS outtime,
       (MAX(t) - MIN(t)) / 24e0 AS los,
       CASE WHEN user_id % 2 = 0 THEN 'MICU' ELSE 'SICU' END AS first_careunit,
       CASE WHEN user_id % 3 = 0 THEN 'MICU' ELSE 'SICU' END AS last_careunit
FROM base GROUP BY user_id, stay_id""",
    "d_items": """
SELECT * FROM (VALUES
  (CAST(225930 AS BIGINT), 'Peptamen 1.5 (Full)', 'Nutrition - Enteral'),
  (228356, 'Glucerna (Full)', 'Nutrition - Enteral'),
  (226020, 'Impact (1/2)', 'Nutrition - Enteral'),
  (229297, 'Osmolite 1.5 (Full)', 'Nutrition - Enteral'),
  (229574, 'Fiber Supplement (i.e. Banana Flakes)', 'Nutrition - Supplements'),
  (225970, 'Beneprotein', 'Nutrition - Supplements'),
  (225916, 'TPN w/ Lipids', 'Nutrition - Parenteral'),
  (226452, 'PO Intake', 'Fluids/Intake'),
  (220949, 'Dextrose 5%', 'Fluids/Intake'),
  (220950, 'Dextrose 10%', 'Fluids/Intake'),
  (220952, 'Dextrose 50%', 'Fluids/Intake'),
  (225947, 'Dextrose PN', 'Fluids/Intake'),
  (223258, 'Insulin - Regular', 'Medications'),
  (223262, 'Insulin - Humalog', 'Medications'),
  (223259, 'Insulin - NPH', 'Medications'),
  (223260, 'Insulin - Glargine', 'Medications'),
  (229619, 'Insulin - U500', 'Medications'),
  (229299, 'Insulin pump', 'Medications'),
  (225664, 'Glucose finger stick', 'Labs'),
  (220621, 'Glucose (serum)', 'Labs'),
  (226537, 'Glucose (whole blood)', 'Labs')
) AS v(itemid, label, category)""",
    "feeds": """
SELECT event_id, stay_id, user_id, ts,
       CASE WHEN stay_id % 8 = 5 THEN 225916
            WHEN stay_id % 8 = 6 THEN 226452
            WHEN stay_id % 8 = 7 AND event_id % 3 = 0 THEN 225916
            WHEN stay_id % 8 = 7 AND event_id % 3 = 1 THEN 226452
            ELSE CASE event_id % 24 WHEN 0 THEN 229574 WHEN 1 THEN 225970 WHEN 2 THEN 228356 WHEN 3 THEN 228356
                 WHEN 4 THEN 226020 WHEN 5 THEN 226020 WHEN 6 THEN 229297 WHEN 7 THEN 229297 ELSE 225930 END
       END AS itemid,
       16 + event_id % 62 AS hours, value * 40e0 AS amount
FROM base WHERE event_type = 'signup'""",
    "drips": """
SELECT event_id, stay_id, user_id, ts,
       CASE event_id % 10 WHEN 0 THEN 220949 WHEN 1 THEN 220950 WHEN 2 THEN 220952 WHEN 3 THEN 225947
            WHEN 4 THEN 223262 WHEN 5 THEN 223259 WHEN 6 THEN 223260 WHEN 7 THEN 229619 WHEN 8 THEN 229299
            ELSE 223258 END AS itemid,
       CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 + event_id % 22 END AS hours, value AS amount,
       CASE event_id % 4 WHEN 0 THEN 'Drug Push' WHEN 1 THEN 'Continuous Med' WHEN 2 THEN 'Continuous IV'
            ELSE 'Continuous Med' END AS ordercat
FROM base WHERE event_type = 'error'""",
    "inputevents": """
SELECT event_id, user_id AS subject_id, stay_id, CAST(itemid AS BIGINT) AS itemid, ts AS starttime,
       ts + INTERVAL '1' HOUR * hours AS endtime, amount, amount / hours AS rate, 'mL/hour' AS rateuom,
       CASE WHEN itemid = 226452 THEN 'Fluids/Intake' ELSE 'Nutrition' END AS ordercategoryname,
       'Continuous IV' AS ordercategorydescription
FROM feeds
UNION ALL
SELECT event_id, user_id, stay_id, CAST(itemid AS BIGINT), ts,
       ts + INTERVAL '1' HOUR * hours + INTERVAL '1' MINUTE, amount,
       CASE WHEN ordercat = 'Drug Push' OR event_id % 30 = 1 THEN NULL ELSE amount / 4e0 END,
       CASE WHEN ordercat = 'Drug Push' THEN NULL ELSE 'mL/hour' END, 'Drips', ordercat
FROM drips""",
    "chartevents": """
SELECT event_id, user_id AS subject_id, stay_id * 2 + 1 AS hadm_id, stay_id,
       CAST(CASE event_type WHEN 'view' THEN 220621 WHEN 'click' THEN 226537 ELSE 225664 END AS BIGINT) AS itemid,
       hour_ts AS charttime,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE hour_ts + INTERVAL '1' MINUTE * (event_id % 7 - 2) END AS storetime,
       value * 8e0 AS valuenum, CAST(event_id AS STRING) AS value, 'mg/dL' AS valueuom
FROM base WHERE event_type IN ('view', 'click', 'purchase')
UNION ALL
SELECT event_id, user_id, stay_id * 2 + 1, stay_id, CAST(228096 AS BIGINT), ts, ts,
       CAST(CAST(FLOOR(value / 30e0) AS BIGINT) % 4 - 3 AS DOUBLE),
       CASE CAST(FLOOR(value / 30e0) AS BIGINT) % 4 WHEN 0 THEN '-3 Moderate sedation' WHEN 1 THEN '-2 Light sedation'
            WHEN 2 THEN '-1 Awakens to voice' ELSE '0 Alert and calm' END, NULL
FROM base WHERE event_type = 'view'""",
    "patients": """
SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CAST(30 + c_custkey % 60 AS INT) AS anchor_age, CAST(2010 + c_custkey % 12 AS INT) AS anchor_year,
       CASE WHEN c_acctbal < 500 THEN CAST('2024-01-20' AS DATE) WHEN c_acctbal < 1500 THEN CAST('2025-03-01' AS DATE)
            END AS dod
FROM customer""",
    "admissions": """
SELECT s.subject_id, s.hadm_id, s.intime AS admittime, s.outtime + INTERVAL '1' HOUR * 30 AS dischtime,
       CASE s.hadm_id % 6 WHEN 0 THEN 'ELECTIVE' WHEN 1 THEN 'URGENT' WHEN 2 THEN 'SURGICAL SAME DAY ADMISSION'
            WHEN 3 THEN 'EW EMER.' WHEN 4 THEN 'OBSERVATION ADMIT' ELSE 'WALK IN' END AS admission_type,
       CASE s.stay_id % 9 WHEN 0 THEN 'DIED' WHEN 1 THEN 'HOSPICE' WHEN 2 THEN NULL ELSE 'HOME' END AS discharge_location,
       CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'WHITE - RUSSIAN' WHEN 'BUILDING' THEN 'BLACK/AFRICAN AMERICAN'
            WHEN 'FURNITURE' THEN 'ASIAN - KOREAN' WHEN 'HOUSEHOLD' THEN 'UNKNOWN'
            ELSE CONCAT('HISPANIC/LATINO - ', c.c_name) END AS race
FROM icustays s LEFT JOIN customer c ON s.subject_id = c.c_custkey""",
    "users": "\nSELECT MAX(user_id) + 1 AS n FROM base",
    "placed": """
SELECT o.*, o.o_custkey % u.n AS subject_id FROM orders o CROSS JOIN users u""",
    "diagnoses_icd": """
SELECT s.hadm_id, CONCAT(CASE o.o_orderkey % 12 WHEN 0 THEN '250' WHEN 1 THEN 'E11' ELSE 'I10' END,
                         CAST(FLOOR(o.o_totalprice) AS BIGINT) % 10) AS icd_code
FROM placed o JOIN icustays s ON s.subject_id = o.subject_id AND s.stay_id % 10 = o.o_orderkey % 4""",
    "pharmacy": """
SELECT s.hadm_id, CASE WHEN l.l_partkey % 13 = 0 THEN NULL ELSE l.l_orderkey * 10 + l.l_linenumber END AS pharmacy_id,
       CASE p.p_size % 6 WHEN 0 THEN 'Dexamethasone' WHEN 1 THEN 'Hydrocortisone Na Succ.' WHEN 2 THEN 'PredniSONE'
            WHEN 3 THEN 'MethylPREDNISolone' WHEN 4 THEN 'Prednisone *STUDY*' ELSE p.p_name END AS medication,
       CASE l.l_returnflag WHEN 'A' THEN 'IV' WHEN 'N' THEN 'PO/NG' ELSE 'TP' END AS route,
       CASE WHEN l.l_discount < 0.05 THEN 'Q24H' ELSE 'Q12H' END AS frequency,
       s.intime + INTERVAL '1' HOUR * (CAST(l.l_quantity AS INT) * 5 - 30) AS starttime,
       s.intime + INTERVAL '1' HOUR * (CAST(l.l_quantity AS INT) * 5 - 30 + l.l_linenumber * 8 - 12) AS stoptime,
       l.l_linestatus, l.l_linenumber, l.l_suppkey, l.l_extendedprice
FROM lineitem l JOIN placed o ON l.l_orderkey = o.o_orderkey
     JOIN icustays s ON s.subject_id = o.subject_id AND s.stay_id % 10 = l.l_linenumber % 4
     JOIN part p ON l.l_partkey = p.p_partkey""",
    "emar": """
SELECT hadm_id, pharmacy_id, medication,
       CASE WHEN l_linestatus = 'O' THEN 'Administered' ELSE 'Not Given' END AS event_txt,
       starttime + INTERVAL '1' HOUR * l_linenumber AS charttime,
       CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE starttime + INTERVAL '1' HOUR * (l_linenumber - 1) END AS scheduletime
FROM pharmacy""",
    "charlson": """
SELECT subject_id, hadm_id, CAST(subject_id % 5 AS INT) AS age_score,
       CASE WHEN hadm_id % 3 = 0 THEN 1 ELSE 0 END AS myocardial_infarct,
       CASE WHEN hadm_id % 5 = 0 THEN 1 ELSE 0 END AS congestive_heart_failure,
       CASE WHEN hadm_id % 7 = 0 THEN 1 ELSE 0 END AS chronic_pulmonary_disease,
       CASE WHEN hadm_id % 9 = 0 THEN 1 ELSE 0 END AS renal_disease,
       CASE WHEN hadm_id % 11 = 0 THEN 1 ELSE 0 END AS malignant_cancer,
       CASE WHEN hadm_id % 13 = 0 THEN 1 ELSE 0 END AS mild_liver_disease,
       CASE WHEN hadm_id % 8 = 1 THEN 1 ELSE 0 END AS diabetes_without_cc,
       CASE WHEN hadm_id % 8 = 3 THEN 1 ELSE 0 END AS diabetes_with_cc,
       CAST(hadm_id % 10 AS INT) AS charlson_comorbidity_index
FROM icustays""",
    "first_day_sofa": "\nSELECT stay_id, CAST(stay_id * 7 % 15 AS INT) AS sofa FROM icustays",
    "oasis": "\nSELECT stay_id, CAST(20 + stay_id * 3 % 31 AS INT) AS oasis FROM icustays",
    "ventilation": """
SELECT event_id, stay_id, ts AS starttime, ts + INTERVAL '1' HOUR * (6 + event_id % 30) AS endtime,
       CASE event_id % 8 WHEN 0 THEN 'NonInvasiveVent' WHEN 1 THEN 'HFNC' WHEN 2 THEN 'SupplementalOxygen'
            WHEN 3 THEN 'None' WHEN 4 THEN 'Tracheostomy' ELSE 'InvasiveVent' END AS ventilation_status
FROM base WHERE event_type = 'click'""",
}


def _needs(text: str, names: tuple[str, ...]) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)]


def with_clause(views: dict[str, str], wanted: list[str], stop: tuple[str, ...] = ()) -> str:
    """WITH list holding ``wanted`` and all they read, in definition order; ``stop`` names are left out."""
    names = tuple(views)
    keep: set[str] = set()
    stack = list(wanted)
    while stack:
        n = stack.pop()
        if n not in keep and n not in stop:
            keep.add(n)
            stack += _needs(views[n], names)
    return ",\n".join(f"{n} AS ({views[n]}\n)" for n in names if n in keep)


def duckdb_sql(query: str, extra: dict[str, str] | None = None) -> str:
    """``query`` with the stand-in views (and ``extra`` ones) it reads put in front."""
    views = {"base": BASE_DUCKDB, **VIEWS, **(extra or {})}
    wanted = _needs(query, tuple(views))
    text = query.strip()
    if not wanted:
        return text
    # a query that starts with a comma goes on with the WITH list
    return f"WITH {with_clause(views, wanted)}{'' if text.startswith(',') else chr(10)}{text}"


class AnalogueTables(dict):
    """Clinical tables by name, each built when first asked for.

    ``icustays``, which seven of them read, is written to the checkpoint folder once, as a stored table would be.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir
        self._views = {"base": BASE_SPARK, **VIEWS}

    def __missing__(self, name: str) -> DataFrame:
        if name in SOURCES:
            self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return self[name]
        clause = with_clause(self._views, [name], () if name == "icustays" else ("icustays",))
        defined = tuple(n for n in self._views if f"{n} AS (" in clause)
        used = [s for s in _needs(clause, (*SOURCES, "icustays")) if s not in defined]
        for s in used:
            clause = re.sub(rf"\b(FROM|JOIN)\s+{s}\b", rf"\1 {{{s}}}", clause)
        df = self.spark.sql(f"WITH {clause}\nSELECT * FROM {name}", **{s: self[s] for s in used})
        self[name] = cut(df) if name == "icustays" else df
        return self[name]


def load(spark: SparkSession, sf_dir: str) -> AnalogueTables:
    return AnalogueTables(spark, sf_dir)
