"""Exact deduplication as a stream with keyed state that lives on disk and never expires.

1. Arrivals: digest of the normalised text, row identity and content locator (file and position) of every row, written
   to the shared folder. A stream reads this table; more files may arrive there later.
2. The stream keeps, per digest, the smallest row identity with its locator and the number of rows. The state is RocksDB's, on
   disk, with its snapshots in the shared folder, so a lost executor's part is loaded elsewhere. It has no watermark.
3. Hits, that is digests with more than one row, are read again and compared in full: grouped by digest and bytes, copies
   combined before the shuffle. Digests that turn out to stand for several texts are split by the texts.

Only DataFrame operations are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, cut, located, query, scratch, table

BLANKS = r"[\x20\x09-\x0D]+"
BROADCAST_ROWS = 500_000  # digests of hits up to this number (about 30 MB) are broadcast; beyond it the join shuffles

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition's state takes 4 MB at least
}


def normalised(text: str) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def absorb(spark: SparkSession, arrivals: str, checkpoint: str, schema) -> DataFrame:
    """Feed what has arrived and wasn't read yet to the state; returns the whole state: digest, keeper, n."""
    with settings(spark, ROCKS):
        stream = (spark.readStream.schema(schema).parquet(arrivals)
                  .groupBy("digest").agg(F.min(ROW).alias("keeper"), F.count(F.lit(1)).alias("n")))
        run = (stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
        run.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        keeper, n = (F.col(f"value.`{f.name}`") for f in state.schema["value"].dataType.fields)
        return cut(state.select("key.digest", keeper.alias("keeper"), n.alias("n")))


def duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
               digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row with its group: row (identity), doc_id, keep_id, group_size, kept, digest.

    Texts are equal when their normalised bytes are. The smallest doc_id stays; of rows with that doc_id the first by file and
    position, and a missing doc_id only if the group has no other. Null counts as empty. An empty table gives no row.
    """
    spark = docs.sparkSession
    rows = located(docs, key, text).withColumn("text", normalised("text"))
    hashed = rows.withColumn("digest", digest(F.col("text")))
    folder = scratch(spark, "exact")
    hashed.select("digest", ROW).write.parquet(f"{folder}/arrivals")
    keys = spark.read.parquet(f"{folder}/arrivals")
    state = absorb(spark, f"{folder}/arrivals", f"{folder}/state", keys.schema)

    hits = state.where("n > 1").select("digest")
    few = hits.count() <= BROADCAST_ROWS
    compared = cut(hashed.join(F.broadcast(hits) if few else hits, "digest", "left_semi")
                   .groupBy("digest", "text").agg(F.min(ROW).alias("keeper"), F.count(F.lit(1)).alias("n"))
                   .select("digest", "keeper", "n"))
    clashing = compared.groupBy("digest").count().where("count > 1").select("digest")
    if clashing.isEmpty():
        found = keys.join(state, "digest")
    else:
        found = keys.join(clashing, "digest", "left_anti").join(state, "digest").unionByName(_split(hashed, clashing))
    return found.select(ROW, f"{ROW}.doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col(ROW) == F.col("keeper")).alias("kept"), "digest")


def _split(hashed: DataFrame, clashing: DataFrame) -> DataFrame:
    """Rows of digests that stand for several texts, grouped by the texts themselves."""
    rows = hashed.join(clashing, "digest", "left_semi")
    groups = rows.groupBy("digest", "text").agg(F.min(ROW).alias("keeper"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups, ["digest", "text"]).drop("text")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS n FROM t)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


@query("op6_exact_dedup", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
