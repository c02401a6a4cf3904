"""Counts, shares, exact quantiles and descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import t_quantile
from .groups import group_attach
from .scan import SumTo, scan
from .skew import AUTO, HotGroups, resolve, salted_join


def freq(df: DataFrame, c: str) -> DataFrame:
    """Rows per level."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))


def flag_share(df: DataFrame, by: str, flag: str, yes: str = "y", no: str = "n") -> DataFrame:
    """Rows with and without the flag and the share with it."""
    return (df.groupBy(by).agg(F.count_if(F.col(flag) == yes).alias("n_yes"), F.count_if(F.col(flag) == no).alias("n_no"))
            .withColumn("share", F.col("n_yes") / (F.col("n_yes") + F.col("n_no"))))


def flag_shares(df: DataFrame, by: str, flags: Sequence[str], yes: str = "y", no: str = "n") -> DataFrame:
    """``flag_share`` of several flags in one pass: (by, flag, n_yes, n_no, share)."""
    counts = df.groupBy(by).agg(*[F.count_if(F.col(f) == v).alias(f"{f}|{v}") for f in flags for v in (yes, no)])
    cells = F.explode(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.col(f"`{f}|{yes}`").alias("n_yes"), F.col(f"`{f}|{no}`").alias("n_no"))
        for f in flags])).alias("c")
    return (counts.select(by, cells).select(by, "c.*")
            .withColumn("share", F.col("n_yes") / (F.col("n_yes") + F.col("n_no"))))


def share_within(df: DataFrame, by: str, cat: str) -> DataFrame:
    """Rows per (by, cat) and their share of ``by``; totals are taken over the counts, not the rows."""
    n = group_attach(df.groupBy(by, cat).agg(F.count(F.lit(1)).alias("n")), [by], {"_total": F.sum("n")})
    return n.withColumn("prop", F.col("n") / F.col("_total")).drop("_total")


def histogram(df: DataFrame, c: str, width: float) -> DataFrame:
    """Rows per bin of ``width``, bins centred on multiples of it."""
    return (df.where(F.col(c).isNotNull())
            .groupBy((F.floor(F.col(c) / width + 0.5) * F.lit(width)).alias("bin_centre"))
            .agg(F.count(F.lit(1)).alias("n")))


def quantile_name(p: float) -> str:
    return f"q{round(p * 100):03d}"


def quantiles(df: DataFrame, c: str, probs: Sequence[float], by: Sequence[str] = (),
              hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Exact quantiles with linear interpolation, one column ``qNNN`` per probability.

    Groups that fit one task use ``percentile``. Otherwise equal values are counted first and the values
    at the wanted ranks are read off a running count along the sorted distinct values.
    """
    df = df.where(F.col(c).isNotNull()).select(*by, F.col(c).cast("double").alias("_v"))
    keys = list(by) or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(0))
    df, hot = resolve(df, keys, hot)
    names = [quantile_name(p) for p in probs]
    if hot is None:
        out = df.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("_q"))
        out = out.select(*keys, *[F.col("_q")[k].alias(n) for k, n in enumerate(names)])
    else:
        values = df.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m"))
        ranked = scan(values, keys, ["_v"], {"_cum": SumTo("_m")}, hot=hot)
        ranked = salted_join(ranked, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")), keys, "left", hot)
        aggs = []
        for p, n in zip(probs, names):
            at = F.floor((F.col("_total") - 1) * F.lit(float(p)))
            aggs += [F.min(F.when(F.col("_cum") > at, F.col("_v"))).alias(f"_lo_{n}"),
                     F.min(F.when(F.col("_cum") > at + 1, F.col("_v"))).alias(f"_hi_{n}")]
        out = ranked.groupBy(*keys, "_total").agg(*aggs)
        cols = []
        for p, n in zip(probs, names):
            h = (F.col("_total") - 1) * F.lit(float(p))
            lo, hi = F.col(f"_lo_{n}"), F.coalesce(F.col(f"_hi_{n}"), F.col(f"_lo_{n}"))
            cols.append((lo + (h - F.floor(h)) * (hi - lo)).alias(n))
        out = out.select(*keys, *cols)
    return out if by else out.drop("_all")


def per_group_count_summary(df: DataFrame, by: Sequence[str], hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Median and quartiles of the number of rows per group."""
    return quantiles(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "n", (0.25, 0.5, 0.75), hot=hot)


def describe_numeric(df: DataFrame, columns: Sequence[str], hot: HotGroups | None | str = AUTO) -> DataFrame:
    """(variable, n, n_missing, q025, q050, q075) per column, from one unpivoted pass."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "variable", "_v")
    n = long.groupBy("variable").agg(F.count("_v").alias("n"), F.count_if(F.col("_v").isNull()).alias("n_missing"))
    return n.join(quantiles(long, "_v", (0.25, 0.5, 0.75), ["variable"], hot), "variable", "left")


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, level, n, pct): share of the known rows; the unknown row has a null level and share."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "variable", "level")
    n = long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    n = group_attach(n, ["variable"], {"_known": F.sum(F.when(F.col("level").isNotNull(), F.col("n")))})
    share = F.when(F.col("level").isNotNull(), F.lit(100.0) * F.col("n") / F.col("_known"))
    return n.withColumn("pct", share).drop("_known")


def describe_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                   hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Both kinds in one long table, categories by falling frequency."""
    num = describe_numeric(df, numeric, hot).withColumns({"level": F.lit(None).cast("string"), "kind": F.lit("numeric")})
    cat = describe_categorical(df, categorical).withColumn("kind", F.lit("categorical"))
    return num.unionByName(cat, allowMissingColumns=True).select(
        "variable", "kind", "level", "n", "n_missing", "pct", "q025", "q050", "q075")


def top_columns_by_sum(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The ``k`` columns with the largest totals; equal totals in column order. Missing values void a total."""
    totals = df.agg(*[F.when(F.count(F.lit(1)) == F.count(c), F.sum(c)).cast("double").alias(c) for c in columns])
    ranks = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("total"), F.lit(j).alias("_pos"))
                                for j, c in enumerate(columns)])).alias("r")
    return totals.select(ranks).select("r.*").orderBy(F.desc_nulls_last("total"), "_pos").limit(k).drop("_pos")


def mean_sd(df: DataFrame, by: str, c: str) -> DataFrame:
    """n, mean, standard deviation and standard error per group."""
    return (df.groupBy(by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"))
            .withColumn("se", F.col("sd") / F.sqrt("n")))


def mean_ci(df: DataFrame, by: str, c: str, level: float = 0.95) -> DataFrame:
    """``mean_sd`` with a t interval; a group of one row has none."""
    out = mean_sd(df, by, c).withColumn("_half", t_quantile(F.col("n") - 1, level) * F.col("se"))
    return out.withColumns({"lower": F.col("mean") - F.col("_half"), "upper": F.col("mean") + F.col("_half")}).drop("_half")


def extreme_flag(df: DataFrame, by: Sequence[str], c: str, within: Sequence[str] = ()) -> DataFrame:
    """Mean of ``c`` per subgroup and whether it is the largest or smallest of its family.

    ``df`` is a table of model results, so the window sees one row per subgroup.
    """
    means = df.groupBy(*within, *by).agg(F.avg(c).alias("mean"))
    w = Window.partitionBy(*(within or [F.lit(0)]))
    flag = (F.when(F.col("mean") == F.max("mean").over(w), "max")
            .when(F.col("mean") == F.min("mean").over(w), "min").otherwise("mid"))
    return means.withColumn("position", flag)
