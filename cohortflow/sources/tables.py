"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tables of the three schemas of the hospital database.
SCHEMAS = {
    "icu": ("icustays", "d_items", "inputevents", "chartevents"),
    "hosp": ("patients", "admissions", "diagnoses_icd", "pharmacy", "emar"),
    "derived": ("charlson", "first_day_sofa", "oasis", "ventilation"),
}
TABLES = tuple(t for names in SCHEMAS.values() for t in names)


def schema_of(name: str) -> str:
    return next(s for s, names in SCHEMAS.items() if name in names)


def read_parquet(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{schema_of(name)}/{name}")


def read_jdbc(spark: SparkSession, url: str, name: str, schema: str, *, column: str, lower: int, upper: int,
              partitions: int, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A database table read in ``partitions`` ranges of a numeric key; filters and columns are pushed down."""
    return spark.read.jdbc(url, f"{schema}.{name}", column=column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=dict(properties or {}))


def read_tables(spark: SparkSession, root: str, names: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    return {n: read_parquet(spark, root, n) for n in names}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A delimited file with a header; the schema is given, so the file is read once."""
    return (spark.read.schema(schema).option("header", True).option("nullValue", "NA")
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]['Z']").csv(path))


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A fixed table written in the program, marked for broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
    else:
        writer.format(fmt).save(path)


def included_ids(df: DataFrame) -> DataFrame:
    """Distinct (subject, admission, stay) triples of a measurement table."""
    return df.select("subject_id", "hadm_id", "stay_id").distinct()
