"""Merkle manifest of a dataset, with a witness for every row, grown by appending.

Leaves are appended in order to open subtrees. An open subtree keeps, besides its root, which leaves hang on it; each of
those has a partial witness. When the run of siblings around a subtree is complete, the witnesses of all its leaves are extended by its
siblings, and the run's root is appended one level higher. So every witness grows from its leaf to the root while
leaves come in.

Spark deals the leaves of a group in aligned blocks of ``arity ** HEIGHT``, each a subtree of its own. Block roots are
appended in the same way, as nodes of the next round, until a group has one root; group roots are then the nodes of one last
tree. A row's witness is its own and that of its block, of the block's block and so on up to the root.

Digests are sha256 over hex text. A witness is, per level, the place in the run and the run's size (one byte each) and the
digests of the others from left to right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, query, table

ARITY = 3
HEIGHT = 7  # levels of a block: 2,187 leaves for runs of three
SIZE = 32  # bytes of a digest


def join_digests(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


class Appender:
    """Appends digests to open subtrees; ``witness`` holds those of all leaves so far."""

    def __init__(self, arity: int = ARITY) -> None:
        self.arity = arity
        self.open: list[list[tuple[bytes, list[int]]]] = [[]]  # per level: the nodes of the last run, each with its leaves
        self.witness: list[bytes] = []

    def append(self, digest: bytes) -> None:
        self.witness.append(b"")
        node, level = (digest, [len(self.witness) - 1]), 0
        while True:
            self._put(level, node)
            if len(self.open[level]) < self.arity:
                return
            node, level = self._complete(level), level + 1

    def _put(self, level: int, node: tuple[bytes, list[int]]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)

    def _complete(self, level: int) -> tuple[bytes, list[int]]:
        """Extends the witnesses below the run by the siblings; the run's parent with all their leaves."""
        run, self.open[level] = self.open[level], []
        digests, below = [d for d, _ in run], []
        for place, (_, leaves) in enumerate(run):
            step = bytes((place, len(run))) + b"".join(digests[:place] + digests[place + 1:])
            for leaf in leaves:
                self.witness[leaf] += step
            below += leaves
        return join_digests(digests), below

    def finish(self, height: int | None = None) -> bytes:
        """Completes runs that are short, up to ``height`` levels or, without one, until a single node is left."""
        level = 0
        while True:
            if level == height or (height is None and len(self.open[level]) == 1 and not any(self.open[level + 1:])):
                return self.open[level][0][0]
            if self.open[level]:
                self._put(level + 1, self._complete(level))
            level += 1


def steps(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, the others of the run) from the lowest level up."""
    at = 0
    while at < len(witness):
        place, n = witness[at], witness[at + 1]
        at += 2
        yield place, [witness[k:k + SIZE] for k in range(at, at + SIZE * (n - 1), SIZE)]
        at += SIZE * (n - 1)


def refold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and a witness give."""
    for place, others in steps(witness):
        leaf = join_digests([*others[:place], leaf, *others[place:]])
    return leaf


def siblings(witness: bytes) -> bytes:
    return b"".join(d for _, others in steps(witness) for d in others)


def record(*fields: Column) -> Column:
    """A leaf: digest over all fields, each ``-`` if null, else its byte count, a colon and its value as text."""
    texts = [f.cast("string") for f in fields]
    framed = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*framed).cast("binary"), 256))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``pos`` (from 0, by ``order`` within ``g``) and ``total`` (rows of ``g``).

    Rows are range-partitioned, so a group of any size is spread; what is summed over partitions is one row per group
    and partition that meet.
    """
    keys = ["g", *order]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .withColumn("place", F.monotonically_increasing_id())).withColumn("range", F.shiftright("place", 33))
    runs = placed.groupBy("g", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy("g")
    runs = runs.select("g", "range", "first", F.sum("n").over(whole).alias("total"), F.coalesce(
        F.sum("n").over(whole.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(runs, ["g", "range"]).withColumn(
        "pos", F.col("place") - F.col("first") + F.col("before")).drop("place", "range", "first", "before")


def grow(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """One round: nodes (g, pos, total, digest, others) in blocks; adds ``block``, ``witness`` and the block's ``top``."""
    size = arity ** height
    dealt = nodes.withColumn("block", F.floor(F.col("pos") / size)).repartition("g", "block").sortWithinPartitions(
        "g", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of complete blocks, then of the open one
        witness, tops = [], []
        tree, current, alone = Appender(arity), None, True

        def close() -> None:
            top = tree.finish(None if alone else height)
            witness.extend(tree.witness)
            tops.extend([top] * len(tree.witness))

        def ready() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = pa.RecordBatch.from_arrays([*rows.columns, pa.array(witness, pa.binary()), pa.array(tops, pa.binary())],
                                             names=[*rows.schema.names, "witness", "top"])
            held.clear()
            witness.clear()
            tops.clear()
            return out

        for batch in batches:
            begin = 0
            columns = (batch.column(c).to_pylist() for c in ("g", "block", "total", "digest"))
            for k, (g, block, total, digest) in enumerate(zip(*columns)):
                if (g, block) != current:
                    if current is not None:
                        close()
                        if k > begin:
                            held.append(batch.slice(begin, k - begin))
                            begin = k
                        if len(witness) >= size:
                            yield ready()
                    tree, current, alone = Appender(arity), (g, block), total <= size
                tree.append(digest)
            held.append(batch.slice(begin))
        if current is not None:
            close()
            yield ready()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema), "witness binary, top binary"])
    return cut(dealt.mapInArrow(run, schema))


def rounds(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """All rounds of ``grow``, from the leaves up to one block per ``g``."""
    size, tables = arity ** height, [grow(nodes, arity, height)]
    most = tables[0].agg(F.max("total")).first()[0] or 0
    while most > size:
        heads = tables[-1].where(F.col("pos") % size == 0)
        nodes = heads.select("g", F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"),
                             F.col("top").alias("digest"))
        tables.append(grow(nodes, arity, height))
        most = -(-most // size)
    return tables


def lifted(tables: Sequence[DataFrame]) -> DataFrame:
    """Witnesses of the lowest table's rows extended through all rounds above it; ``top`` is the group's root."""
    above = tables[-1]
    for below in reversed(tables[:-1]):
        up = above.select("g", F.col("pos").alias("block"), F.col("witness").alias("more"), F.col("top").alias("apex"))
        above = below.join(up, ["g", "block"]).withColumns(
            {"witness": F.concat("witness", "more"), "top": F.col("apex")}).drop("more", "apex")
    return above


def manifest(docs: DataFrame, leaf: Column, *, key: str = "doc_id", group: str = "source",
             carry: Mapping[str, Column] | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, witness (all binary but the first) and the ``carry`` columns, one row per row of ``docs``.

    Leaves of a group ascend by key, null first; rows with equal keys go by their leaf. Groups ascend bytewise, null first. An empty
    table gives no row and no root. ``docs`` is read once; columns not named are left out.
    """
    carried = {f"c_{k}": c for k, c in (carry or {}).items()}
    leaves = cut(docs.select(F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("")).alias("g"),
                             F.col(key).cast("long").alias("doc_id"), leaf.alias("digest"),
                             *[c.alias(k) for k, c in carried.items()]))
    below = lifted(rounds(numbered(leaves, ["doc_id", "digest"]), arity, height))
    subroots = below.where("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("top").alias("digest"))
    above = lifted(rounds(numbered(subroots, ["of"]), arity, height))
    up = above.select(F.col("of").alias("g"), F.col("witness").alias("more"), F.col("top").alias("root"))
    return below.join(up, "g").select("doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root",
                                      F.concat("witness", "more").alias("witness"),
                                      *[F.col(k).alias(k.removeprefix("c_")) for k in carried])


def check(rows: DataFrame, presented: str = "leaf") -> DataFrame:
    """Adds proof (digest over the witness's siblings) and folded (the root that the ``presented`` leaf gives with it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, paths = (batch.column(c).to_pylist() for c in (presented, "witness"))
            proofs = [join_digests([siblings(w)]) for w in paths]
            folded = [refold(d, w) for d, w in zip(leaves, paths)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(proofs, pa.binary()), pa.array(folded, pa.binary())],
                                             names=[*batch.schema.names, "proof", "folded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "proof binary, folded binary"])
    return rows.mapInArrow(run, schema)


SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(v ORDER BY i) AS tab FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                              lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT range::BIGINT AS i FROM range(256)))),
t AS (
    SELECT doc_id, source, lang, n_chars, text,
           xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
                           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS tampered
    FROM documents, crc),
l AS (
    SELECT doc_id, source, tampered, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(cutdown) || ':' || cutdown, '-')) AS other,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
    FROM (SELECT *, replace(text, chr(10), '') AS cutdown,
                 coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                 || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
          FROM t)),
low(source, level, run, members) AS (
    SELECT source, 0, pos // 3, list(leaf ORDER BY pos) FROM l GROUP BY source, pos // 3
    UNION ALL
    SELECT source, level + 1, run // 3, list(sha256(array_to_string(members, '')) ORDER BY run)
    FROM (SELECT *, count(*) OVER (PARTITION BY source) AS runs FROM low) WHERE runs > 1 GROUP BY source, level, run // 3),
tops AS (SELECT source, CASE WHEN level = 0 AND len(members) = 1 THEN members[1] ELSE sha256(array_to_string(members, '')) END AS subroot
         FROM low QUALIFY row_number() OVER (PARTITION BY source ORDER BY level DESC) = 1),
s AS (SELECT source, subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos FROM tops),
high(level, run, members) AS (
    SELECT 0, spos // 3, list(subroot ORDER BY spos) FROM s GROUP BY spos // 3
    UNION ALL
    SELECT level + 1, run // 3, list(sha256(array_to_string(members, '')) ORDER BY run)
    FROM (SELECT *, count(*) OVER () AS runs FROM high) WHERE runs > 1 GROUP BY level, run // 3),
path(doc_id, pos, level, cur, proof, source, leaf) AS (
    SELECT doc_id, pos, 0, CASE WHEN tampered THEN other ELSE leaf END, '', source, leaf FROM l
    UNION ALL
    SELECT p.doc_id, p.pos // 3, p.level + 1,
           sha256(array_to_string(members[:p.pos % 3] || [p.cur] || members[p.pos % 3 + 2:], '')),
           p.proof || array_to_string(members[:p.pos % 3] || members[p.pos % 3 + 2:], ''), p.source, p.leaf
    FROM path p JOIN low ON low.source IS NOT DISTINCT FROM p.source AND low.level = p.level AND low.run = p.pos // 3
    WHERE NOT (p.level = 0 AND (SELECT count(*) FROM l WHERE l.source IS NOT DISTINCT FROM p.source) = 1)),
ends AS (SELECT * FROM path QUALIFY row_number() OVER (PARTITION BY doc_id, source, leaf ORDER BY level DESC) = 1),
climb(doc_id, leaf, subroot, pos, level, cur, proof) AS (
    SELECT doc_id, leaf, subroot, spos, 0, cur, proof FROM ends JOIN s ON s.source IS NOT DISTINCT FROM ends.source
    UNION ALL
    SELECT doc_id, leaf, subroot, pos // 3, p.level + 1,
           sha256(array_to_string(members[:pos % 3] || [cur] || members[pos % 3 + 2:], '')),
           proof || array_to_string(members[:pos % 3] || members[pos % 3 + 2:], '')
    FROM climb p JOIN high ON high.level = p.level AND high.run = pos // 3
    WHERE NOT (p.level = 0 AND (SELECT count(*) FROM s) = 1)),
root AS (SELECT CASE WHEN level = 0 AND len(members) = 1 THEN members[1] ELSE sha256(array_to_string(members, '')) END AS root
         FROM high QUALIFY row_number() OVER (ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY doc_id, subroot, leaf ORDER BY level DESC) = 1), root
"""


@query("op12_merkle_manifest", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; rows with an even checksum are checked without their line ends."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(table(spark, sf_dir, "documents"), record(*fields, F.col("text")),
                    carry={"presented": record(*fields, shown)})
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "proof", "folded")}
    return check(rows, "presented").select("doc_id", *[text[c].alias(c) for c in ("leaf", "subroot", "root")],
                                           text["proof"].alias("proof_sha256"), text["folded"].alias("folded_root"),
                                           (F.col("folded") == F.col("root")).alias("verified"))
