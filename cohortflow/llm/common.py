"""Registry and small helpers of the operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, cut  # noqa: F401  (cut is re-exported)

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        REGISTRY[name] = Entry(fn, sql)
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name, as a URI, in the folder that driver and executors share."""
    return re.sub(r"^(file:)?/+", "file:///", checkpoint_root(spark)) + f"/{what}-{uuid.uuid4().hex}"


def fold(key: str, parts: int) -> Column:
    """crc32 of the key written as text, modulo ``parts``: decides which rows a model may learn from.

    A null key counts as the empty text.
    """
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


ROW = "row"  # identity of a row: (doc_id missing, doc_id, file, position), ordered; ties on doc_id go by place


def located(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row`` and ``text``: each row's identity and content locator, the same on every read and in every retry.

    A frame that isn't read from files is written to the shared folder first. Columns of other names are left out.
    """
    from pyspark.errors import AnalysisException

    place = (F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    try:
        rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                           place[0].alias("file"), place[1].alias("position"))
        rows.schema  # noqa: B018  (resolves the hidden column)
    except AnalysisException:
        rows = cut(plain).select("doc_id", "text", place[0].alias("file"), place[1].alias("position"))
    return rows.select(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "file", "position").alias(ROW), "text")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs``, as read from files, less the rows whose identity ``dropped`` holds; all columns stay."""
    file, position = f"_file_{uuid.uuid4().hex}", f"_position_{uuid.uuid4().hex}"
    placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(position))
    gone = dropped.select(F.col(f"{ROW}.file").alias(file), F.col(f"{ROW}.position").alias(position))
    return placed.join(gone, [file, position], "left_anti").select(*[f"`{c}`" for c in docs.columns])
