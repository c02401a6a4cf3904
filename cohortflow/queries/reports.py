"""Queries over the finished measurement table: descriptives, models, trees."""

from __future__ import annotations

import itertools
import math
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import boosting, mixed, trees
from ..operators import summaries
from ..plans import descriptives, exposures
from ..plans import models as M
from ..session import checkpoint_root, cut
from . import steps  # noqa: F401  (its texts are used here)
from .registry import REGISTRY, query, r, rounded, sel, study
from .views import VENT_CLASS, cut_sql


def table(spark, d):
    return study(spark, d).analysis


# descriptives

NUMERIC = descriptives.PATIENT_NUMERIC
CATEGORICAL = descriptives.PATIENT_CATEGORICAL
ONE_ROW = f"SELECT DISTINCT stay_id, {', '.join(NUMERIC + CATEGORICAL)} FROM study"


def _numeric_sql(c: str) -> str:
    q = ", ".join(f"{r(f'QUANTILE_CONT(CAST({c} AS DOUBLE), {p})')} AS q{int(p * 100):03d}" for p in (0.25, 0.5, 0.75))
    return (f"SELECT '{c}' AS variable, 'numeric' AS kind, CAST(NULL AS VARCHAR) AS level, COUNT({c}) AS n, "
            f"COUNT(*) - COUNT({c}) AS n_missing, CAST(NULL AS DOUBLE) AS pct, {q} FROM ({ONE_ROW})")


def _categorical_sql(c: str, source: str) -> str:
    return (f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level, COUNT(*) AS n, "
            f"{r(f'CASE WHEN {c} IS NOT NULL THEN 100.0 * COUNT(*) / SUM(CASE WHEN {c} IS NOT NULL THEN COUNT(*) END) OVER () END')} AS pct "
            f"FROM ({source}) GROUP BY {c}")


@query("describe_table", " UNION ALL ".join([_numeric_sql(c) for c in NUMERIC] + [
    f"SELECT variable, 'categorical', level, n, NULL, pct, NULL, NULL, NULL FROM ({_categorical_sql(c, ONE_ROW)})" for c in CATEGORICAL]))
def describe_table(spark, d):
    return rounded(descriptives.patient_table(table(spark, d)))


@query("sample_table", " UNION ALL ".join(_categorical_sql(c, "SELECT * FROM study") for c in descriptives.SAMPLE_CATEGORICAL))
def sample_table(spark, d):
    return rounded(descriptives.sample_table(table(spark, d)))


@query("icu_day_total", """
SELECT CAST(SUM(days) AS BIGINT) AS total_icu_days, COUNT(*) AS n_stays FROM (SELECT stay_id, COUNT(DISTINCT time_icudays) AS days FROM study GROUP BY stay_id)""")
def icu_day_total(spark, d):
    return descriptives.icu_day_total(table(spark, d))


@query("stay_status", f"""
SELECT stay_id, CASE WHEN BOOL_OR(cat = 'invasive') THEN 'invasive' WHEN BOOL_OR(cat = 'noninvasive') THEN 'non-invasive only'
       WHEN BOOL_AND(cat = 'none') THEN 'none' WHEN BOOL_AND(cat = 'NaN') THEN 'NaN' END AS ventilation_status_stay
FROM (SELECT s.stay_id, {VENT_CLASS} AS cat FROM icustays s LEFT JOIN ventilation x ON s.stay_id = x.stay_id) GROUP BY stay_id""")
def stay_status(spark, d):
    t = study(spark, d).tables
    return descriptives.stay_status(t["icustays"], t["ventilation"])


@query("ever_exposed", """
SELECT 'insulin' AS kind, COUNT(DISTINCT i.stay_id) AS n_stays FROM inputevents i JOIN d_items d ON i.itemid = d.itemid
WHERE i.amount > 0 AND LOWER(d.label) LIKE '%insulin%' AND d.category = 'Medications' AND i.stay_id IN (SELECT stay_id FROM fed)
UNION ALL SELECT 'dextrose', COUNT(DISTINCT i.stay_id) FROM inputevents i JOIN d_items d ON i.itemid = d.itemid
WHERE i.amount > 0 AND LOWER(d.label) LIKE '%dextrose%' AND i.stay_id IN (SELECT stay_id FROM fed)""")
def ever_exposed(spark, d):
    s = study(spark, d)
    kinds = {"insulin": exposures.is_insulin(), "dextrose": exposures.is_dextrose()}
    parts = [exposures.ever_exposed(s.tables["inputevents"], s.tables["d_items"].where(pick), s.stays)
             .agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_stays")) for kind, pick in kinds.items()]
    return parts[0].unionByName(parts[1])


@query("sampling_density", f"""
SELECT {', '.join(f"{r(f'QUANTILE_CONT(n, {p})')} AS q{int(p * 100):03d}" for p in (0.25, 0.5, 0.75))}
FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM study GROUP BY stay_id, time_icudays)""")
def sampling_density(spark, d):
    return rounded(descriptives.sampling_density(table(spark, d)))


@query("hourly_counts", "SELECT time_hbin, COUNT(*) AS n FROM study GROUP BY time_hbin")
def hourly_counts(spark, d):
    return descriptives.hourly_counts(table(spark, d))


@query("hourly_share", " UNION ALL ".join(
    f"SELECT time_hbin, '{f}' AS flag, COUNT(*) FILTER ({f} = 'y') AS n_yes, COUNT(*) FILTER ({f} = 'n') AS n_no, "
    f"{r(f'''COUNT(*) FILTER ({f} = 'y') / CAST(COUNT(*) AS DOUBLE)''')} AS share FROM study GROUP BY time_hbin"
    for f in ("insu_yn", "dext_yn", "glucocorticoid_yn")))
def hourly_share(spark, d):
    return rounded(descriptives.hourly_share(table(spark, d)))


@query("hourly_share_fed", f"""
SELECT time_hbin, COUNT(*) FILTER (fed_yn = 'y') AS n_yes, COUNT(*) FILTER (fed_yn = 'n') AS n_no,
       {r("COUNT(*) FILTER (fed_yn = 'y') / CAST(COUNT(*) AS DOUBLE)")} AS share
FROM (SELECT v.time_hbin, CASE WHEN f.stay_id IS NULL THEN 'n' ELSE 'y' END AS fed_yn
      FROM valid v LEFT JOIN feed_at f ON v.stay_id = f.stay_id AND v.time_seq = f.time_seq) GROUP BY time_hbin""")
def hourly_share_fed(spark, d):
    """Share of the valid measurements of each hour taken during enteral feeding."""
    s = study(spark, d)
    during = s.exposed.select(*exposures.KEY).withColumn("fed", F.lit(True))
    marked = exposures.attach(s.valid, during, exposures.KEY)
    marked = marked.withColumn("fed_yn", F.when(F.col("fed"), "y").otherwise("n"))
    return rounded(summaries.flag_share(marked, "time_hbin", "fed_yn"))


MIX_LABEL = """CASE rate_nut_cho_cat WHEN '(-Inf,4.5]' THEN '≤ 4.5 grams/hour' WHEN '(4.5,6.5]' THEN '4.5-6.5 grams/hour'
       WHEN '(6.5,8.5]' THEN '6.5-8.5 grams/hour' ELSE '≥ 8.5 grams/hour' END"""

MIX_ORDER = """CAST(CASE rate_nut_cho_cat WHEN '(-Inf,4.5]' THEN 0 WHEN '(4.5,6.5]' THEN 1 WHEN '(6.5,8.5]' THEN 2 ELSE 3 END AS INT)"""


@query("hourly_rate_mix", f"""
SELECT time_dec, rate_nut_cho_cat, {MIX_ORDER} AS level_ord, {MIX_LABEL} AS level_label, n, {r('n / CAST(SUM(n) OVER (PARTITION BY time_dec) AS DOUBLE)')} AS prop
FROM (SELECT CAST(h - 24 * FLOOR(h / 24) AS DOUBLE) AS time_dec, rate_nut_cho_cat, COUNT(*) AS n
      FROM (SELECT UNNEST(GENERATE_SERIES(CAST(GREATEST(CEIL(s), FLOOR(intime_seq)) AS BIGINT), CAST(LEAST(CEIL(e) - 1, CEIL(outtime_seq)) AS BIGINT))) AS h,
                   REPLACE({cut_sql('rate_nut_cho', '4.5 6.5 8.5')}, '[-Inf', '(-Inf') AS rate_nut_cho_cat
            FROM feeds_rate WHERE rate_nut_cho IS NOT NULL AND stay_id IN (SELECT stay_id FROM fed)) GROUP BY 1, 2)""")
def hourly_rate_mix(spark, d):
    s = study(spark, d)
    return rounded(descriptives.hourly_rate_mix(s.enteral, s.stays))


def _track_sql(name: str, a: str, b: str, source: str = "study") -> str:
    return (f"SELECT DISTINCT stay_id, '{name}' AS track, {r(a)} AS track_start, {r(b)} AS track_end FROM {source} "
            f"WHERE time_seq > 72 AND time_seq < 144 AND {a} IS NOT NULL AND {b} IS NOT NULL")


@query("timeline", " UNION ALL ".join([
    _track_sql("glucose", "time_seq", "time_seq"),
    *[_track_sql(n, a, b) for n, (a, b) in descriptives.TRACKS.items()],
    _track_sql("all glucose", "time_seq", "time_seq",
               "(SELECT stay_id, date_diff('microsecond', date_trunc('day', intime), charttime) / 3.6e9 AS time_seq FROM measured) m")]))
def timeline(spark, d):
    s = study(spark, d)
    return rounded(descriptives.timeline(s.analysis, 72, 144, measured=s.measured))


@query("day_hour_grid", """
, bouts AS (SELECT stay_id, island, MIN(s) AS s, MAX(e) AS e, MAX(intime_seq) AS lo, MAX(outtime_seq) AS hi FROM enteral GROUP BY stay_id, island),
fedh AS (SELECT DISTINCT stay_id, h FROM (SELECT stay_id, UNNEST(GENERATE_SERIES(CAST(GREATEST(FLOOR(s), FLOOR(lo)) AS BIGINT), CAST(LEAST(CEIL(e) - 1, CEIL(hi)) AS BIGINT))) AS h FROM bouts)),
grid AS (SELECT stay_id, UNNEST(GENERATE_SERIES(CAST(FLOOR(MAX(lo)) AS BIGINT), CAST(CEIL(MAX(hi)) AS BIGINT))) AS h FROM bouts GROUP BY stay_id)
SELECT g.stay_id, CAST(FLOOR(g.h / 24) AS BIGINT) AS day, CASE WHEN f.h IS NULL THEN 'n' ELSE 'y' END AS feeding_yn,
       CAST(MIN(g.h - 24 * FLOOR(g.h / 24)) AS DOUBLE) AS time_dec_start, CAST(MAX(g.h - 24 * FLOOR(g.h / 24) + 1) AS DOUBLE) AS time_dec_end
FROM grid g LEFT JOIN fedh f ON g.stay_id = f.stay_id AND g.h = f.h
WHERE g.stay_id IN (SELECT stay_id FROM fedh) GROUP BY 1, 2, 3""")
def day_hour_grid(spark, d):
    return rounded(descriptives.day_hour_grid(study(spark, d).enteral))


@query("normalized_profile", f"""
SELECT time_hbin, COUNT(x) AS n, {sel('~AVG(x) AS mean, ~STDDEV_SAMP(x) AS sd, ~STDDEV_SAMP(x) / SQRT(COUNT(x)) AS se')}
FROM (SELECT time_hbin, glucose_value_mmolL - AVG(glucose_value_mmolL) OVER (PARTITION BY stay_id) AS x FROM study) GROUP BY time_hbin""")
def normalized_profile(spark, d):
    return rounded(descriptives.normalized_profile(table(spark, d)))


# P(|T| <= t) is the share of the integral of cos(a)^(df - 1) up to atan(t / sqrt(df)): Simpson's rule on 400 steps, halved 45 times
PROFILE = "FROM (SELECT time_hbin, glucose_value_mmolL - AVG(glucose_value_mmolL) OVER (PARTITION BY stay_id) AS x FROM study) GROUP BY time_hbin"


@query("normalized_profile_ci", f"""
SELECT * FROM (
WITH RECURSIVE s AS (SELECT time_hbin, COUNT(x) AS n, AVG(x) AS mean, STDDEV_SAMP(x) AS sd, STDDEV_SAMP(x) / SQRT(COUNT(x)) AS se {PROFILE}),
grid AS (SELECT k, CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 401) g(k)),
whole AS (SELECT n, SUM(w * POW(COS(k / 400.0 * PI() / 2), n - 2)) * PI() / 2 AS total
          FROM (SELECT DISTINCT n FROM s WHERE n > 1), grid GROUP BY n),
halved(n, total, lo, hi, step) AS (
    SELECT n, total, 0e0, PI() / 2, 0 FROM whole
    UNION ALL
    SELECT n, total, CASE WHEN part < 0.95 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN part < 0.95 THEN hi ELSE (lo + hi) / 2 END, step + 1
    FROM (SELECT h.n, h.total, h.lo, h.hi, h.step,
                 SUM(w * POW(COS(k / 400.0 * (lo + hi) / 2), h.n - 2)) * (lo + hi) / 2 / h.total AS part
          FROM halved h, grid WHERE h.step < 45 GROUP BY h.n, h.total, h.lo, h.hi, h.step)),
t AS (SELECT n, SQRT(n - 1) * TAN((lo + hi) / 2) AS t FROM halved WHERE step = 45)
SELECT time_hbin, s.n, {sel('~mean, ~sd, ~se, ~mean - t * se AS lower, ~mean + t * se AS upper')}
FROM s LEFT JOIN t ON t.n = s.n)""")
def normalized_profile_ci(spark, d):
    return rounded(descriptives.normalized_profile(table(spark, d), ci=True))


# what the cut points rest on

CUT_VALUES = {"age": "age", "rate_dext > 0": "rate_dext", "rate_insu > 0": "rate_insu", "rate_nut_cho": "rate_nut_cho"}
CUT_PROBS = (0, 0.25, 0.5, 0.75, 1)
CATEGORIES = ("age_cat", "rate_dext_cat", "rate_insu_cat", "rate_nut_cho_cat")


@query("cut_point_quantiles", " UNION ALL ".join(
    f"SELECT '{name}' AS variable, " + ", ".join(
        f"{r(f'QUANTILE_CONT(CAST({c} AS DOUBLE), {p})')} AS {summaries.quantile_name(p)}" for p in CUT_PROBS)
    + f" FROM study WHERE {name if '>' in name else 'TRUE'}" for name, c in CUT_VALUES.items()))
def cut_point_quantiles(spark, d):
    """Quantiles of what is cut into categories, of rates above zero only."""
    rows = table(spark, d).select(*[
        (F.when(F.col(c) > 0, F.col(c)) if ">" in name else F.col(c)).cast("double").alias(name) for name, c in CUT_VALUES.items()])
    long = rows.unpivot([], [f"`{n}`" for n in CUT_VALUES], "variable", "x")
    return rounded(summaries.quantiles(long, "x", CUT_PROBS, ["variable"]))


@query("category_frequencies", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS level, COUNT(*) AS n FROM study GROUP BY {c}" for c in CATEGORIES))
def category_frequencies(spark, d):
    long = table(spark, d).select(*CATEGORIES).unpivot([], list(CATEGORIES), "variable", "level")
    return long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))


# mixed models

TERM_COLUMNS = [t.column for t in M.FINAL]
ACTIVE = "LIST_FILTER([0, " + ", ".join(
    "CASE " + t.column + " " + " ".join(
        f"WHEN {level if isinstance(level, int) else repr(level)} THEN {k}"
        for k, (c, level) in enumerate(mixed.Design(M.RESPONSE, M.GROUP, M.FINAL).columns, start=1) if c == t.column) + " END"
    for t in M.FINAL) + "], lambda x: x IS NOT NULL)"
LAST = mixed.Design(M.RESPONSE, M.GROUP, M.FINAL).size


@query("lmm_xtx", f"""
, act AS (SELECT ROW_NUMBER() OVER () AS rid, glucose_value_mmolL AS y, {ACTIVE} AS ids FROM model_rows),
long AS (SELECT rid, UNNEST(ids) AS id, 1.0 AS v FROM act UNION ALL SELECT rid, {LAST}, y FROM act)
SELECT CAST(p.id AS INT) AS a, CAST(q.id AS INT) AS b, {r('SUM(CAST(p.v AS DOUBLE) * q.v)', 4)} AS v
FROM long p JOIN long q ON p.rid = q.rid AND p.id <= q.id GROUP BY 1, 2""")
def lmm_xtx(spark, d):
    df = M.analysis_rows(table(spark, d)).withColumn("subgroup", F.lit(mixed.ALL))
    design = mixed.Design(M.RESPONSE, M.GROUP, M.FINAL)
    return rounded(mixed.cross_products(mixed.cells(df, design), design).drop("subgroup"), 4)


@query("lmm_group_moments", f"""
, act AS (SELECT stay_id, glucose_value_mmolL AS y, {ACTIVE} AS ids FROM model_rows),
sizes AS (SELECT stay_id, COUNT(*) AS n FROM act GROUP BY stay_id),
long AS (SELECT stay_id, UNNEST(ids) AS id, CAST(1.0 AS DOUBLE) AS v FROM act UNION ALL SELECT stay_id, {LAST}, y FROM act),
sums AS (SELECT stay_id, id, SUM(v) AS v FROM long GROUP BY stay_id, id)
SELECT s.n, CAST(p.id AS INT) AS a, CAST(q.id AS INT) AS b, {r('SUM(p.v * q.v)', 4)} AS v
FROM sums p JOIN sums q ON p.stay_id = q.stay_id AND p.id <= q.id JOIN sizes s ON p.stay_id = s.stay_id GROUP BY 1, 2, 3""")
def lmm_group_moments(spark, d):
    df = M.analysis_rows(table(spark, d)).withColumn("subgroup", F.lit(mixed.ALL))
    design = mixed.Design(M.RESPONSE, M.GROUP, M.FINAL)
    return rounded(mixed.group_moments(mixed.cells(df, design), design).drop("subgroup"), 4)


RATIOS = (0.0, 0.01, 0.1, 0.5, 1.0, 10.0)


def _final_statistics(spark, d, terms):
    return mixed.Statistics(M.final_cells(M.analysis_rows(table(spark, d))), mixed.Design(M.RESPONSE, M.GROUP, terms))


@query("lmm_profile", f"""
, g AS (SELECT stay_id, CAST(COUNT(*) AS DOUBLE) AS n, SUM(glucose_value_mmolL) AS s, SUM(glucose_value_mmolL * glucose_value_mmolL) AS q
        FROM model_rows GROUP BY stay_id),
ratios AS (SELECT UNNEST([{', '.join(f'CAST({x} AS DOUBLE)' for x in RATIOS)}]) AS l),
t AS (SELECT l, SUM(n) AS nn, SUM(n / (1 + n * l)) AS a, SUM(s / (1 + n * l)) AS b, SUM(q - l / (1 + n * l) * s * s) AS c,
             SUM(LN(1 + n * l)) AS d FROM g CROSS JOIN ratios GROUP BY l)
SELECT l AS lam, {r('(nn - 1) * LN(2 * PI() * (c - b * b / a) / (nn - 1)) + nn - 1 + d + LN(a)', 4)} AS value, {r('b / a', 6)} AS intercept
FROM t""")
def lmm_profile(spark, d):
    """Restricted likelihood of the intercept-only model over variance ratios."""
    out = mixed.profile(spark, _final_statistics(spark, d, ()), RATIOS).drop("subgroup")
    return out.withColumns({"value": F.round("value", 4) + F.lit(0.0), "intercept": F.round("intercept", 6) + F.lit(0.0)})


@query("lmm_normal_equations", f"""
, act AS (SELECT ROW_NUMBER() OVER () AS rid, stay_id, glucose_value_mmolL AS y, {ACTIVE} AS ids FROM model_rows),
sizes AS (SELECT stay_id, COUNT(*) AS n FROM act GROUP BY stay_id),
long AS (SELECT rid, stay_id, UNNEST(ids) AS id, CAST(1.0 AS DOUBLE) AS v FROM act UNION ALL SELECT rid, stay_id, {LAST}, y FROM act),
sums AS (SELECT stay_id, id, SUM(v) AS v FROM long GROUP BY stay_id, id),
plain AS (SELECT p.id AS a, q.id AS b, SUM(p.v * q.v) AS v FROM long p JOIN long q ON p.rid = q.rid AND p.id <= q.id GROUP BY 1, 2),
shrunk AS (SELECT p.id AS a, q.id AS b, SUM(p.v * q.v * 0.5e0 / (1 + 0.5e0 * s.n)) AS v
           FROM sums p JOIN sums q ON p.stay_id = q.stay_id AND p.id <= q.id JOIN sizes s ON p.stay_id = s.stay_id GROUP BY 1, 2)
SELECT CAST(i.range AS INT) AS a, CAST(j.range AS INT) AS b, {r('COALESCE(x.v, 0) - COALESCE(w.v, 0)', 4)} AS v
FROM range({LAST} + 1) i JOIN range({LAST} + 1) j ON i.range <= j.range
     LEFT JOIN plain x ON x.a = i.range AND x.b = j.range LEFT JOIN shrunk w ON w.a = i.range AND w.b = j.range""")
def lmm_normal_equations(spark, d):
    """Left and right side of the final model's equations at a variance ratio of one half."""
    return rounded(mixed.normal_equations(spark, _final_statistics(spark, d, M.FINAL), 0.5).drop("subgroup"), 4)


@query("lmm_hour_means", f"""
SELECT CAST(time_hbin AS VARCHAR) AS time_hbin, {r('AVG(glucose_value_mmolL)', 6)} AS emmean FROM model_rows GROUP BY time_hbin""")
def lmm_hour_means(spark, d):
    """Marginal means of the model with the hour alone, without variance between stays: the hourly means."""
    hour = tuple(t for t in M.FINAL if t.column == "time_hbin")
    fits = mixed.fit_at(_final_statistics(spark, d, hour), 0.0)
    return rounded(mixed.marginal_means(spark, fits, "time_hbin").select("time_hbin", "emmean"))


def _intercept_sql(restricted: bool) -> str:
    """Views up to ``best``, the intercept-only model at the ratio where the derivative of its likelihood changes sign: halved
    60 times over the logarithm of the ratio."""
    free = "nn - 1" if restricted else "nn"
    slope = f"({free}) * rss1 / rss + d1" + (" - a1 / a" if restricted else "")
    value = f"({free}) * LN(2 * PI() * rss / ({free})) + ({free}) + ld" + (" + LN(a)" if restricted else "")

    def total(f: str) -> str:
        return f"LIST_SUM(LIST_TRANSFORM(gs, lambda g: {f}))"

    return f"""
, g AS (SELECT CAST(n AS DOUBLE) AS n, CAST(COUNT(*) AS DOUBLE) AS k, SUM(s) AS s, SUM(s * s) AS q, SUM(yy) AS yy
        FROM (SELECT stay_id, COUNT(*) AS n, SUM(glucose_value_mmolL) AS s, SUM(glucose_value_mmolL * glucose_value_mmolL) AS yy
              FROM model_rows GROUP BY stay_id) GROUP BY n),
packed AS (SELECT LIST({{'n': n, 'k': k, 's': s, 'q': q}} ORDER BY n) AS gs, SUM(n * k) AS nn, SUM(yy) AS yy, SUM(k) AS stays FROM g),
search AS (SELECT * FROM (
  WITH RECURSIVE half AS (
    SELECT 0 AS round, LN(1e-6) AS lo, LN(1e5) AS hi
    UNION ALL
    SELECT round + 1, CASE WHEN {slope} > 0 THEN lo ELSE u END, CASE WHEN {slope} > 0 THEN u ELSE hi END FROM (
      SELECT *, yy - wq - b * b / a AS rss, -(q1 - 2 * b / a * s1 + b * b / a / a * a1) AS rss1 FROM (
        SELECT *, {total('g.k * g.n / (1 + g.n * EXP(u))')} AS a, {total('g.s / (1 + g.n * EXP(u))')} AS b,
               {total('g.q * EXP(u) / (1 + g.n * EXP(u))')} AS wq, {total('g.q / (1 + g.n * EXP(u)) ** 2')} AS q1,
               {total('g.s * g.n / (1 + g.n * EXP(u)) ** 2')} AS s1, {total('g.k * g.n * g.n / (1 + g.n * EXP(u)) ** 2')} AS a1,
               {total('g.k * g.n / (1 + g.n * EXP(u))')} AS d1
        FROM (SELECT round, lo, hi, (lo + hi) / 2 AS u, packed.* FROM half, packed WHERE round < 60))))
  SELECT EXP((lo + hi) / 2) AS lam FROM half WHERE round = 60)),
best AS (SELECT *, {value} AS value, rss / ({free}) AS sigma2, b / a AS beta FROM (
  SELECT *, yy - wq - b * b / a AS rss FROM (
    SELECT lam, nn, yy, stays, {total('g.k * g.n / (1 + g.n * lam)')} AS a, {total('g.s / (1 + g.n * lam)')} AS b,
           {total('g.q * lam / (1 + g.n * lam)')} AS wq, {total('g.k * LN(1 + g.n * lam)')} AS ld FROM search, packed)))"""


def _fit_stats_sql(criterion: str) -> str:
    return f"""{_intercept_sql(criterion == 'REML')}
SELECT '{criterion}' AS criterion, CAST(nn AS BIGINT) AS nobs, CAST(stays AS BIGINT) AS ngroups, {r('-value / 2', 4)} AS loglik,
       {r('6 + value', 4)} AS aic, {r('3 * LN(nn) + value', 4)} AS bic, {r('SQRT(sigma2)', 4)} AS sigma,
       {r('SQRT(lam * sigma2)', 4)} AS group_sd, {r('beta', 4)} AS estimate, {r('SQRT(sigma2 / a)', 4)} AS std_error FROM best"""


def _intercept_fit(spark, d, reml):
    rows = cut(M.analysis_rows(table(spark, d)))
    stats = mixed.Statistics(M.final_cells(rows), mixed.Design(M.RESPONSE, M.GROUP, ()))
    return rows, stats, mixed.fit_statistics(stats, reml)[0]


def _fit_row(spark, d, reml):
    _, _, fit = _intercept_fit(spark, d, reml)
    one = mixed.fit_stats(spark, {"intercept": fit}).join(mixed.coefficients(spark, [fit]), "subgroup")
    return rounded(one.select("criterion", "nobs", "ngroups", "loglik", "aic", "bic", "sigma", "group_sd", "estimate", "std_error"), 4)


@query("lmm_intercept_reml", _fit_stats_sql("REML"))
def lmm_intercept_reml(spark, d):
    """The first of the nested models, maximised: the ratio is searched for, not given."""
    return _fit_row(spark, d, True)


@query("lmm_intercept_ml", _fit_stats_sql("ML"))
def lmm_intercept_ml(spark, d):
    return _fit_row(spark, d, False)


@query("lmm_residual_rows", f"""{_intercept_sql(True)}
, effects AS (SELECT stay_id, beta + lam / (1 + COUNT(*) * lam) * SUM(glucose_value_mmolL - beta) AS fitted
              FROM model_rows, best GROUP BY stay_id, lam, beta)
SELECT m.stay_id, {r('glucose_value_mmolL', 4)} AS glucose_value_mmolL, {r('fitted', 4)} AS fitted,
       {r('glucose_value_mmolL - fitted', 4)} AS residual
FROM model_rows m JOIN effects e ON m.stay_id = e.stay_id""")
def lmm_residual_rows(spark, d):
    """Fitted value and residual of every row of the intercept-only model."""
    rows, stats, fit = _intercept_fit(spark, d, True)
    return rounded(mixed.residuals(stats, fit, M.complete(rows)).select("stay_id", "glucose_value_mmolL", "fitted", "residual"), 4)


def final_fit(spark, d):
    return mixed.fit(M.analysis_rows(table(spark, d)), M.RESPONSE, M.FINAL, M.GROUP)


@query("lmm_coefficients")
def lmm_coefficients(spark, d):
    return mixed.coefficients(spark, final_fit(spark, d))


@query("lmm_compare")
def lmm_compare(spark, d):
    stats = M.nested_statistics(table(spark, d))
    return mixed.compare(spark, [(n, mixed.fit_statistics(s, reml=False)[0]) for n, s in stats.items()])


@query("lmm_fit_stats")
def lmm_fit_stats(spark, d):
    stats = M.nested_statistics(table(spark, d))
    return mixed.fit_stats(spark, {n: mixed.fit_statistics(s)[0] for n, s in stats.items()})


@query("marginal_means")
def marginal_means(spark, d):
    return mixed.marginal_means(spark, final_fit(spark, d), "time_hbin")


@query("lmm_residual_hist")
def lmm_residual_hist(spark, d):
    rows = cut(M.analysis_rows(table(spark, d)))
    stats = mixed.Statistics(M.final_cells(rows), mixed.Design(M.RESPONSE, M.GROUP, M.FINAL))
    return mixed.residual_histogram(mixed.residuals(stats, mixed.fit_statistics(stats)[0], rows))


SUBGROUP_SQL = " UNION ALL ".join(f"SELECT '{name}' AS subgroup, * FROM grouped_rows WHERE {cond}" for name, cond in [
    ("ventilation | Invasive", "ventilation_status_cat = 'invasive'"),
    ("ventilation | Non-Invasive", "ventilation_status_cat = 'noninvasive'"),
    ("survival | Non-survivors", "died_hospstay_yn = 'y'"),
    ("survival | Survivors", "died_hospstay_yn = 'n'"),
    ("sedation | RASS ≥ -1", "ras_score > -2"),
    ("sedation | RASS ≤ -2", "ras_score <= -2"),
    ("sample type | Point-of-care test", "sample_type = 'Fingerstick'"),
    ("sample type | Lab test", "sample_type IN ('Lab (serum)', 'Lab (whole blood)')"),
    ("time in ICU | Day 0-2", "time_icudays <= 2"),
    ("time in ICU | Day 3-7", "time_icudays > 2 AND time_icudays <= 7"),
    ("time in ICU | Day ≥ 8", "time_icudays > 7"),
    ("time to next | < 4 hours", "time_next_measurement < 4"),
    ("time to next | 4-8 hours", "time_next_measurement >= 4 AND time_next_measurement <= 8"),
    ("time to next | > 8 hours", "time_next_measurement > 8"),
    ("insulin need | No insulin administration during ICU stay", "insu_requirement = 'no'"),
    ("insulin need | Mean insulin administration of 0<x≤35 units/day over ICU stay", "insu_requirement = '0-35 units/day'"),
    ("insulin need | Mean insulin administration of 35<x≤70 units/day over ICU stay", "insu_requirement = '35-70 units/day'"),
    ("insulin need | Mean insulin administration of >70 units/day over ICU stay", "insu_requirement = '>70 units/day'"),
])


@query("subgroup_sizes", f"""
SELECT subgroup, COUNT(DISTINCT stay_id) AS npat, COUNT(*) AS nmeas,
       COUNT(*) FILTER (glucose_value_mmolL IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in TERM_COLUMNS)}) AS nmodel
FROM ({SUBGROUP_SQL}) GROUP BY subgroup""")
def subgroup_sizes(spark, d):
    return M.subgroup_sizes(table(spark, d))


@query("requirement_class", "SELECT DISTINCT stay_id, insu_requirement FROM grouped_rows")
def requirement_class(spark, d):
    return M.requirement_class(M.analysis_rows(table(spark, d))).select("stay_id", "insu_requirement").distinct()


@query("subgroup_marginal_means")
def subgroup_marginal_means(spark, d):
    return mixed.marginal_means(spark, M.subgroup_fits(table(spark, d)), "time_hbin")


@query("subgroup_value_positions", f"""
, m AS (SELECT SPLIT_PART(subgroup, ' | ', 1) AS family, SPLIT_PART(subgroup, ' | ', 2) AS name, AVG(mean) AS mean
           FROM (SELECT subgroup, time_hbin, AVG(glucose_value_mmolL) AS mean FROM ({SUBGROUP_SQL}) GROUP BY subgroup, time_hbin)
           GROUP BY subgroup)
SELECT family, name, {sel('~mean')}, CASE WHEN mean = MAX(mean) OVER (PARTITION BY family) THEN 'max'
       WHEN mean = MIN(mean) OVER (PARTITION BY family) THEN 'min' ELSE 'mid' END AS position FROM m""")
def subgroup_value_positions(spark, d):
    """Label positions from the plain means of each subgroup and hour."""
    rows = M.with_subgroups(table(spark, d))
    return rounded(M.label_positions(rows.groupBy("subgroup", "time_hbin").agg(F.avg("glucose_value_mmolL").alias("emmean"))))


@query("subgroup_label_positions")
def subgroup_label_positions(spark, d):
    return M.label_positions(subgroup_marginal_means(spark, d))


# the study's own outputs

def _output_sql(name: str, sql: str, stays: bool = True) -> str:
    if sql.strip().startswith(","):  # goes on with the list of views
        sql = "WITH zero AS (SELECT 0) " + sql
    return f"SELECT '{name}' AS output, COUNT(*) AS n, {'COUNT(DISTINCT stay_id)' if stays else 'CAST(NULL AS BIGINT)'} AS stays FROM ({sql})"


@query("study_outputs", " UNION ALL ".join([
    _output_sql("subject_flow", REGISTRY["subject_flow"].sql, False),
    _output_sql("measurement_flow", REGISTRY["measurement_flow"].sql, False),
    _output_sql("included_ids", REGISTRY["included_ids"].sql),
    _output_sql("measurements_with_covariates", "SELECT * FROM study"),
    _output_sql("insulin_administrations", "SELECT * FROM insulin WHERE stay_id IN (SELECT stay_id FROM fed)"),
    _output_sql("dextrose_administrations", "SELECT * FROM dextrose WHERE stay_id IN (SELECT stay_id FROM fed)"),
    _output_sql("enteral_feeding", "SELECT * FROM enteral"),
    _output_sql("all_measurements", "SELECT * FROM measured"),
    _output_sql("glucocorticoid_administrations", """SELECT DISTINCT stay_id, time_seq, cort_interval_starttime_seq, cort_interval_endtime_seq
        FROM study WHERE cort_interval_starttime_seq IS NOT NULL AND cort_interval_endtime_seq IS NOT NULL"""),
]))
def study_outputs(spark, d):
    """Writes the nine result tables to the shared folder, reads them back and counts."""
    root = f"{checkpoint_root(spark)}/outputs-{uuid.uuid4().hex}"
    s = study(spark, d)
    s.write(root)
    parts = []
    for name in s.outputs():
        df = spark.read.parquet(f"{root}/{name}")
        stays = F.count_distinct("stay_id") if "stay_id" in df.columns else F.lit(None).cast("long")
        parts.append(df.agg(F.count(F.lit(1)).alias("n"), stays.alias("stays")).select(F.lit(name).alias("output"), "n", "stays"))
    return reduce(DataFrame.unionByName, parts)


# boosted trees

LEVELS = {"sex": ("F", "M"), "diabetes_status": ("n", "y"), "glucocorticoid_yn": ("n", "y")}


@query("feature_table", f"""
SELECT {sel('stay_id, ~time_seq, ~glucose_value_mmolL, ~time_dec, ~CAST(age AS DOUBLE) AS age, ~rate_insu, ~rate_dext, ~rate_nut_cho')},
       CASE WHEN sex = 'M' THEN 1e0 ELSE 0e0 END AS sex_M, CASE WHEN diabetes_status = 'y' THEN 1e0 ELSE 0e0 END AS diabetes_status_y,
       CASE WHEN glucocorticoid_yn = 'y' THEN 1e0 ELSE 0e0 END AS glucocorticoid_yn_y
FROM study WHERE glucose_value_mmolL IS NOT NULL AND time_dec IS NOT NULL AND age IS NOT NULL AND rate_nut_cho IS NOT NULL""")
def feature_table(spark, d):
    return rounded(trees.feature_table(table(spark, d), levels=LEVELS)[0])


def _features(spark, d):
    df, names = trees.feature_table(table(spark, d), levels=LEVELS)
    return cut(df), names


@query("gbt_score")
def gbt_score(spark, d):
    df, names = _features(spark, d)
    return trees.train_rmse(trees.score(trees.fit_gbt(df, names), df, names))


@query("gbt_tune")
def gbt_tune(spark, d):
    """The whole grid in five folds; all its models grow together."""
    df, names = _features(spark, d)
    return boosting.tuning_table(boosting.tune(df, names))


FLAGS = ("sex_M", "diabetes_status_y", "glucocorticoid_yn_y")
STUMP = {"max_depth": (1,), "eta": (1.0,), "n_estimators": (1,), "min_child_weight": (5,), "subsample": (1.0,), "colsample_bytree": (1.0,)}


@query("gbt_stump_folds", f""", flagged AS (
    SELECT CAST(stay_id % 5 AS INTEGER) AS fold, ROUND_EVEN(glucose_value_mmolL * {boosting.SCALE}, 0) AS y, [
           CASE WHEN sex = 'M' THEN 1 ELSE 0 END, CASE WHEN diabetes_status = 'y' THEN 1 ELSE 0 END,
           CASE WHEN glucocorticoid_yn = 'y' THEN 1 ELSE 0 END] AS flags
    FROM study WHERE glucose_value_mmolL IS NOT NULL AND time_dec IS NOT NULL AND age IS NOT NULL AND rate_nut_cho IS NOT NULL),
models AS (SELECT CAST(k AS INTEGER) AS k FROM RANGE(5) t(k)),
cells AS (SELECT k, f, SUM(y - {boosting.SCALE * boosting.BASE}) AS g, COUNT(*) AS n,
                 COALESCE(SUM(y - {boosting.SCALE * boosting.BASE}) FILTER (flags[f] = 0), 0) AS gl, COUNT(*) FILTER (flags[f] = 0) AS nl
          FROM flagged, models, RANGE(1, 4) t(f) WHERE fold <> k GROUP BY k, f),
gains AS (SELECT *, CASE WHEN nl >= 5 AND n - nl >= 5
                         THEN gl * gl / (nl + 1.0) + (g - gl) * (g - gl) / (n - nl + 1.0) - g * g / (n + 1.0) ELSE 0.0 END AS gain FROM cells),
best AS (SELECT * FROM gains QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY gain DESC, f) = 1)
SELECT k AS fold, COUNT(*) AS n, {r(f"""SQRT(AVG(POW(y / {boosting.SCALE} - {boosting.BASE} - (CASE
           WHEN gain <= {boosting.LEAST_GAIN} THEN g / (n + 1.0) WHEN flags[f] = 0 THEN gl / (nl + 1.0)
           ELSE (g - gl) / (n - nl + 1.0) END) / {boosting.SCALE}, 2)))""")} AS rmse
FROM flagged JOIN best ON fold = k GROUP BY k""")
def gbt_stump_folds(spark, d):
    """Held-out error, by fold of stays, of one tree with one split on the 0/1 features."""
    df, _ = _features(spark, d)
    found = boosting.tune(df, FLAGS, STUMP, fold=F.col("stay_id") % 5)
    return rounded(found.where("n > 0").select("fold", "n", "rmse"))


def _shap(spark, d):
    df, names = _features(spark, d)
    model = trees.fit_gbt(df, names)
    return trees.tree_shap(model, trees.shap_sample(df), names), names


# A small tree that is given, not fitted: nodes as (id, left, right, feature, threshold, rows, value)
GIVEN_FEATURES = ("time_dec", "age", "rate_nut_cho", "diabetes_status_y")
GIVEN_TREE = (
    (0, 1, 4, 0, 12.0, 100.0, 0.0), (1, 2, 3, 1, 60.0, 60.0, 0.0), (2, -1, -1, -1, 0.0, 25.0, 7.0), (3, 9, 10, 3, 0.5, 35.0, 0.0),
    (4, 5, 6, 2, 5.0, 40.0, 0.0), (5, 7, 8, 1, 70.0, 30.0, 0.0), (6, -1, -1, -1, 0.0, 10.0, 10.0), (7, 11, 12, 0, 18.0, 10.0, 0.0),
    (8, -1, -1, -1, 0.0, 20.0, 6.5), (9, -1, -1, -1, 0.0, 20.0, 8.0), (10, -1, -1, -1, 0.0, 15.0, 8.75), (11, -1, -1, -1, 0.0, 4.0, 9.0),
    (12, -1, -1, -1, 0.0, 6.0, 9.5))


def _game_sql(known: tuple[int, ...], node: int = 0) -> str:
    """Expected value of the given tree when only the ``known`` features are known, as SQL."""
    _, left, right, feature, threshold, rows, value = GIVEN_TREE[node]
    if left < 0:
        return f"{value!r}::DOUBLE"
    a, b = _game_sql(known, left), _game_sql(known, right)
    if feature in known:
        return f"CASE WHEN {GIVEN_FEATURES[feature]} <= {threshold!r} THEN {a} ELSE {b} END"
    return f"({GIVEN_TREE[left][5] / rows!r}::DOUBLE * ({a}) + {GIVEN_TREE[right][5] / rows!r}::DOUBLE * ({b}))"


def _shapley_sql(j: int) -> str:
    """Sum over all coalitions without feature ``j`` of their weight times what it adds."""
    others = [k for k in range(len(GIVEN_FEATURES)) if k != j]
    return " + ".join(
        f"{math.factorial(size) * math.factorial(len(others) - size) / math.factorial(len(others) + 1)!r}::DOUBLE"
        f" * (({_game_sql((*c, j))}) - ({_game_sql(c)}))"
        for size in range(len(others) + 1) for c in itertools.combinations(others, size))


GIVEN_ROWS = """(SELECT *, CASE WHEN diabetes_status = 'y' THEN 1e0 ELSE 0e0 END AS diabetes_status_y FROM study
      WHERE glucose_value_mmolL IS NOT NULL AND time_dec IS NOT NULL AND age IS NOT NULL AND rate_nut_cho IS NOT NULL)"""
GIVEN_LABELS = {"time_dec": "Time", "age": "Age", "rate_nut_cho": "Carbohydrate administration rate", "diabetes_status_y": "Diabetes"}


def _given_nodes() -> pd.DataFrame:
    return pd.DataFrame([(0, *x) for x in GIVEN_TREE], columns=["treeID", "id", "left", "right", "feature", "threshold", "cover", "value"])


def _given_shap(spark, d):
    return trees.tree_shap(_given_nodes(), trees.feature_table(table(spark, d), levels=LEVELS)[0], GIVEN_FEATURES)


@query("shap_given_tree", f"""
SELECT stay_id, {sel('~time_seq')}, {', '.join(f"{r(_shapley_sql(k))} AS shap_{n}" for k, n in enumerate(GIVEN_FEATURES))}
FROM {GIVEN_ROWS}""")
def shap_given_tree(spark, d):
    return rounded(_given_shap(spark, d).select("stay_id", "time_seq", *[f"shap_{n}" for n in GIVEN_FEATURES]))


@query("shap_given_importance", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, '{GIVEN_LABELS[n]}' AS label, {r(f'AVG(ABS({_shapley_sql(k)}))')} AS mean_abs_shap FROM {GIVEN_ROWS}"
    for k, n in enumerate(GIVEN_FEATURES)))
def shap_given_importance(spark, d):
    return rounded(trees.shap_importance(_given_shap(spark, d), GIVEN_FEATURES))


@query("shap_given_dependence", " UNION ALL ".join(
    f"SELECT stay_id, {r('time_seq')} AS time_seq, '{n}' AS feature, '{GIVEN_LABELS[n]}' AS label, {r(f'CAST({n} AS DOUBLE)')} AS value, "
    f"{r(_shapley_sql(k))} AS shap FROM {GIVEN_ROWS}" for k, n in enumerate(GIVEN_FEATURES) if n in ("age", "rate_nut_cho")))
def shap_given_dependence(spark, d):
    return rounded(trees.shap_dependence(_given_shap(spark, d), GIVEN_FEATURES, only=["age", "rate_nut_cho"]))


@query("given_tree_rmse", f"""
SELECT COUNT(*) AS n, {r(f'SQRT(AVG(POW(glucose_value_mmolL - ({_game_sql(tuple(range(len(GIVEN_FEATURES))))}), 2)))')} AS rmse
FROM {GIVEN_ROWS}""")
def given_tree_rmse(spark, d):
    df = trees.feature_table(table(spark, d), levels=LEVELS)[0]
    return rounded(trees.train_rmse(df.withColumn("prediction", trees.forest_column(_given_nodes(), GIVEN_FEATURES))))


@query("shap_importance")
def shap_importance(spark, d):
    return trees.shap_importance(*_shap(spark, d))


@query("shap_dependence")
def shap_dependence(spark, d):
    return trees.shap_dependence(*_shap(spark, d))
