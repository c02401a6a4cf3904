"""Query name -> Spark query and, where SQL can say it, the DuckDB text with the same columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.study import Study
from ..sources import analogue
from .views import MIN_LOS, STUDY

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a Spark query; ``sql`` may read the stand-in tables and the study views."""
    def wrap(fn: Query) -> Query:
        REGISTRY[name] = Entry(fn, sql)
        return fn
    return wrap


def oracle(name: str) -> str | None:
    sql = REGISTRY[name].sql
    return None if sql is None else analogue.duckdb_sql(sql, STUDY)


def study(spark: SparkSession, sf_dir: str, **options) -> Study:
    return Study(analogue.load(spark, sf_dir), min_los=MIN_LOS, **options)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"ROUND({expr}, {digits}) + 0.0"


def sel(columns: str, digits: int = 6) -> str:
    """SELECT list in which ``~name`` and ``~expr AS name`` are rounded."""
    out = []
    for part in _split(columns):
        if part.startswith("~"):
            expr, _, name = part[1:].rpartition(" AS ")
            expr, name = (expr, name) if expr else (name, name.split(".")[-1])
            part = f"{r(expr, digits)} AS {name}"
        out.append(part)
    return ", ".join(out)


def _split(columns: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*parts, cur.strip()]
