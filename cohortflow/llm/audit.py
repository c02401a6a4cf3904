"""Filter interaction audit: what each filter removes under every order of the filters.

A document is reduced to the set of filters it fails (a mask). Under one order it is removed by the first filter of that set,
so all orders that begin alike treat it alike, and orders that begin alike are neighbours in lexicographic order. For every mask
and every beginning whose last filter is the first failing one, the orders form one interval of ranks. The mask's count is
added where the interval begins and taken off where it ends; a running sum over the ranks gives all orders at once.

The rank of a beginning is its Lehmer code: digit k says how many filters not used before are smaller than the k-th.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, query, table
from .exact import BLANKS, sha256

COPY = "E"  # the filter that compares documents; the others look at one text


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters on one text that isn't null."""
    words = F.array_remove(F.split(text, BLANKS), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def lehmer_rank(order: str, letters: str) -> int:
    """Lexicographic rank of the first permutation that begins with ``order``."""
    left, rank = sorted(letters), 0
    for letter in order:
        digit = left.index(letter)
        rank += digit * math.factorial(len(left) - 1)
        left.pop(digit)
    return rank


def removal_intervals(letters: str) -> Iterator[tuple[int, int, int, int]]:
    """(mask, step, lo, hi): permutations of rank lo to hi - 1 remove documents of this mask at this step."""
    for mask in range(1, 1 << len(letters)):
        fails = [c for k, c in enumerate(letters) if mask >> k & 1]
        passes = [c for c in letters if c not in fails]
        for step in range(1, len(passes) + 2):
            for before in itertools.permutations(passes, step - 1):
                for last in fails:
                    lo = lehmer_rank("".join(before) + last, letters)
                    yield mask, step, lo, lo + math.factorial(len(letters) - step)


def masks(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang",
          filters: Mapping[str, Column] | None = None) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the set of filters they fail; at most 2^filters rows a part.

    Bit k of a mask is the k-th filter; the last one is ``COPY``. Copies share their digest and so their other filters: they are
    counted per digest and kind, and of each digest only those rows pass that have its smallest id. Counts meet before the
    shuffle, so a group of copies of any size reaches a task as one row per kind and task.
    """
    value = F.coalesce(F.col("text"), F.lit(""))
    tests = filters or text_filters(F.col("text"))
    bits = [F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests.values())]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
                       F.col(text).alias("text")).withColumn("text", value)
    marked = cut(rows.select("doc_id", "part", sha256(F.col("text")).alias("digest"), sum(bits, F.lit(0)).alias("mask")))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(
        F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    # an id may stand in several rows: each is counted
    once = (marked.where("doc_id IS NOT NULL").join(known, "doc_id", "left")
            .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
            .groupBy("digest", "part", "mask", "good", "toxic", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    kinds = once.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    first = F.when(F.col("least") == F.min("least").over(W.partitionBy("digest")), F.col("n_least")).otherwise(0)
    split = kinds.withColumn("first", first).select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("first").alias("n")),
        F.struct((F.col("mask") + (1 << len(tests))).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("s"))
    counted = split.groupBy("part", "s.mask").agg(F.sum("s.n").alias("n"), *[
        F.sum(F.when(F.col(c), F.col("s.n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    nameless = marked.where("doc_id IS NULL").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), *[F.lit(0).cast("long").alias(c) for c in ("good", "toxic")])
    both = counted.unionByName(nameless).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return both.where("n > 0")


def audit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang",
          filters: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per part, order of the filters and step: counts kept and removed, and how the filters overlap.

    ``filters`` names one-letter failure conditions on the column ``text`` (null texts are empty); ``COPY`` is added to them.
    A row without an id is no copy of another and none is a copy of it; it has no label. Several labels of a
    document count as one: it is good or toxic if any says so. A null part counts as the empty string. Rows with equal ids don't make
    copies of each other. An empty table gives no row. Other columns are left out.
    """
    spark = docs.sparkSession
    letters = "".join(filters or text_filters(F.col("text"))) + COPY
    if sorted(letters) != list(letters) or len(set(letters)) < len(letters):
        raise ValueError("filters must be named by single letters in ascending order before " + COPY)
    measures = ["n", "good", "toxic"]
    found = cut(masks(docs, labels, key=key, text=text, part=part, filters=filters))

    # both tables are given by the number of filters alone
    spans = spark.createDataFrame(list(removal_intervals(letters)), "mask int, step int, lo int, hi int")
    orders = ["".join(p) for p in itertools.permutations(letters)]
    steps = spark.createDataFrame([(rank, o, k + 1, letter) for rank, o in enumerate(orders) for k, letter in enumerate(o)],
                                  "rank int, filter_order string, step int, filter string")

    ends = found.join(F.broadcast(spans), "mask").select("part", "step", F.explode(F.array(
        F.struct(F.col("lo").alias("rank"), *measures),
        F.struct(F.col("hi").alias("rank"), *[(-F.col(m)).alias(m) for m in measures]))).alias("e")).select("part", "step", "e.*")
    grid = (found.select("part").distinct().withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))))
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))))
    zeros = grid.select("part", "step", "rank", *[F.lit(0).cast("long").alias(m) for m in measures])
    changes = ends.unionByName(zeros).groupBy("part", "step", "rank").agg(*[F.sum(m).alias(m) for m in measures])
    along = W.partitionBy("part", "step").orderBy("rank")
    removed = changes.select("part", "step", "rank", *[F.sum(m).over(along).alias(m) for m in measures]).where(
        F.col("rank") < len(orders))

    bit = {c: 1 << k for k, c in enumerate(letters)}
    sizes = found.groupBy("part").agg(F.sum("n").alias("total"), *[
        F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(f"{name}_{c}")
        for c, b in bit.items() for name, cond in (("fails", F.col("mask").bitwiseAND(b) > 0), ("only", F.col("mask") == b))])
    own = sizes.select("part", "total", F.explode(F.array(*[
        F.struct(F.lit(c).alias("filter"), F.col(f"fails_{c}").alias("fails"), F.col(f"only_{c}").alias("only"))
        for c in letters])).alias("f")).select("part", "total", "f.*")
    before = W.partitionBy("part", "rank").orderBy("step")
    return (removed.join(F.broadcast(steps), ["rank", "step"]).join(own, ["part", "filter"])
            .select("part", "filter_order", "step", (F.col("total") - F.sum("n").over(before)).alias("kept"),
                    F.col("n").alias("removed"), (F.col("fails") - F.col("n")).alias("failing_later"), "only", "good", "toxic",
                    F.sum("n").over(W.partitionBy("part", "filter")).alias("shapley"), "filter", "rank"))


SQL = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
    SELECT t.part, coalesce(lab.good, false) AS good, coalesce(lab.toxic, false) AS toxic,
           len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
           100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
           regexp_matches(text, '[#$%&*|]') AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e
    FROM t LEFT JOIN lab ON lab.doc_id = t.doc_id),
m AS (
    SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
           || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS mask,
           count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM f GROUP BY 1, 2),
orders(o) AS (
    SELECT '' UNION ALL
    SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE strpos(o, l) = 0),
steps AS (SELECT o AS filter_order, s::INT AS step, o[s] AS f FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
x AS (
    SELECT m.part, filter_order, step, f,
           sum(CASE WHEN translate(o_before, mask, '') = o_before AND strpos(mask, f) > 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN strpos(mask, f) > 0 THEN n ELSE 0 END) AS fails,
           sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN translate(o_before, mask, '') = o_before AND strpos(mask, f) > 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN translate(o_before, mask, '') = o_before AND strpos(mask, f) > 0 THEN toxic ELSE 0 END) AS toxic_lost,
           sum(CASE WHEN translate(o_before || f, mask, '') = o_before || f THEN n ELSE 0 END) AS kept
    FROM m, (SELECT *, left(filter_order, step - 1) AS o_before FROM steps) s
    GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, (fails - removed)::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM x
"""


@query("op13_filter_audit", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("part", "filter_order", "step", "kept", "removed", F.col("failing_later").alias("redundant"),
                        F.col("only").alias("unique_fails"), F.col("good").alias("good_lost"),
                        F.col("toxic").alias("toxic_lost"), "shapley")
