"""SimHash near-duplicates: a hierarchical index over fingerprints in Gray order, then connected groups.

Two fingerprints that differ in at most ``bits`` bits agree in full on one of ``bits + 1`` blocks of the bits. So the top
nodes of the index are masked bit patterns, one for each block and value, and Spark deals fingerprints to them; a node that
is too crowded for one task is split the same way on the bits that its mask leaves free. Within a node the fingerprints
stand in Gray order, in which neighbours share most bits: leaves of neighbours, and above them groups of nodes, keep the bits
that all below them share (mask and pattern). A search goes down from the top, adds up the differences on the bits that a
node's mask adds to its parent's, and leaves a whole group as soon as the sum is above ``bits``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, cut, located, query, table

WORDS = 3
BITS = 2
SEED = 42
CROWDED = 20_000  # fingerprints of a top node that one task searches
LEAF, FAN_OUT = 32, 8
AT_ONCE = 1 << 16  # shingle hashes, and searches, that are in memory at once


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """64 majority bits over the XXH64 of all word shingles; zero without a word."""
    w = (text or b"").lower().split()  # of bytes: A-Z, and ASCII white space
    if not w:
        return 0
    size = min(words, len(w))
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(w) - size + 1
    begin, end = starts[:n].tolist(), ends[size - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, AT_ONCE):
        h = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(begin[k:k + AT_ONCE], end[k:k + AT_ONCE])],
                     "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """row (identity) and fingerprint long of every document; a null text has no word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(np.array(found, "u8").view("i8"))],
                                             names=[ROW, "fingerprint"])

    rows = located(docs, key, text)
    row_type = rows.schema[ROW].dataType.simpleString()
    return rows.mapInArrow(run, f"{ROW} {row_type}, fingerprint long")


def gray_rank(code: Column) -> Column:
    """Place of a 64-bit word in the reflected Gray sequence, as a signed long."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(mask: int, parts: int) -> list[int]:
    """The free bits of a mask in ``parts`` blocks, each as a mask."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:])]


def links(codes: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) that join all codes within ``bits`` differing bits: each close pair is joined directly or through others
    that are close. ``codes`` has one column, ``fingerprint``, of distinct values."""
    masks = _blocks(0, bits + 1)
    nodes = codes.select("fingerprint", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = []
    while True:
        nodes = nodes.withColumn("pattern", F.col("fingerprint").bitwiseAND(F.col("mask")))
        crowded = cut(nodes.groupBy("mask", "pattern").count().where(F.col("count") > CROWDED).select("mask", "pattern"))
        if crowded.isEmpty() or masks[0].bit_count() > 48:  # 16 free bits hold 65,536 codes at most
            found.append(_search(nodes, bits))
            return functools.reduce(DataFrame.unionByName, found)
        found.append(_search(nodes.join(crowded, ["mask", "pattern"], "left_anti"), bits))
        finer = {m: [m | b for b in _blocks(m, bits + 1)] for m in masks}
        choice = F.create_map(*[c for m, xs in finer.items()
                                for c in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in xs]))])
        nodes = cut(nodes.join(crowded, ["mask", "pattern"], "left_semi")
                    .select("fingerprint", F.explode(choice[F.col("mask")]).alias("mask")).distinct())
        masks = [x for xs in finer.values() for x in xs]


def _search(nodes: DataFrame, bits: int) -> DataFrame:
    """Edges within each top node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, "i8")] * 3
        for batch in batches:
            new = [np.concatenate((k, c.to_numpy(zero_copy_only=False))) for k, c in zip(kept, batch.columns)]
            last = int(np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))[-1] + 1) \
                if (new[0][0], new[1][0]) != (new[0][-1], new[1][-1]) else 0
            kept = [c[last:] for c in new]  # the last node may go on in the next batch
            yield from _edges(*[c[:last] for c in new], bits)
        yield from _edges(*kept, bits)

    return (nodes.withColumn("rank", gray_rank(F.col("fingerprint")))
            .repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "rank")
            .select("mask", "pattern", "fingerprint").mapInArrow(run, "a long, b long"))


def _edges(mask: np.ndarray, pattern: np.ndarray, code: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Close pairs of each node, as edges to the smallest place of a connected group."""
    n = len(code)
    if n < 2:
        return
    code = code.view("u8")
    group = np.concatenate(([0], np.cumsum((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))))
    sizes = np.bincount(group)
    starts = np.cumsum(sizes) - sizes
    left, right = [], []
    for d in range(1, LEAF):  # small nodes: every pair of a leaf
        i = np.flatnonzero((group[d:] == group[:-d]) & (sizes[group[d:]] <= LEAF)) if d < n else np.empty(0, "i8")
        if not len(i):
            break
        i = i[np.bitwise_count(code[i] ^ code[i + d]) <= bits]
        left.append(i)
        right.append(i + d)
    for g in np.flatnonzero(sizes > LEAF):
        own = code[starts[g]:starts[g] + sizes[g]]
        for a, b in tree_pairs(own, bits):
            left.append(a + starts[g])
            right.append(b + starts[g])
    a, b = np.concatenate(left or [[]]).astype("i8"), np.concatenate(right or [[]]).astype("i8")
    low = np.arange(n)
    while True:  # smallest place that is reachable
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    i = np.flatnonzero(low != np.arange(n))
    yield pa.RecordBatch.from_arrays([pa.array(code[low[i]].view("i8")), pa.array(code[i].view("i8"))], names=["a", "b"])


def gray_tree(code: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (mask, pattern), top first, over codes in Gray order: what all codes below a node share."""
    every, some = code, code
    levels, width = [], LEAF
    while True:
        at = np.arange(0, len(every), width)
        every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
        levels.append((~(every ^ some), every))
        if len(every) <= FAN_OUT:
            return levels[::-1]
        width = FAN_OUT


def tree_pairs(code: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i < j) of all codes within ``bits`` differing bits; ``code`` is in Gray order."""
    levels = gray_tree(code)
    zero = np.uint64(0)
    for first in range(0, len(code), 1024):
        q = np.arange(first, min(first + 1024, len(code)))
        mask, pattern = levels[0]
        who, node = np.repeat(q, len(mask)), np.tile(np.arange(len(mask)), len(q))
        spent = np.zeros(len(who), np.int64)
        parent_mask = np.full(len(who), zero, "u8")
        span = LEAF * FAN_OUT ** (len(levels) - 1)
        for depth, (mask, pattern) in enumerate(levels):
            if depth:  # go down: every child of the nodes that are left
                who, spent, parent_mask = (np.repeat(x, FAN_OUT) for x in (who, spent, parent_mask))
                node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                span //= FAN_OUT
                there = node < len(mask)
                who, spent, parent_mask, node = who[there], spent[there], parent_mask[there], node[there]
            ahead = (node + 1) * span > who + 1  # holds a place after the searching one
            who, spent, parent_mask, node = who[ahead], spent[ahead], parent_mask[ahead], node[ahead]
            added = mask[node] & ~parent_mask
            spent = spent + np.bitwise_count((code[who] ^ pattern[node]) & added)
            near = spent <= bits
            who, spent, node = who[near], spent[near], node[near]
            parent_mask = mask[node]
        i = np.repeat(who, LEAF)
        j = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
        there = (j < len(code)) & (j > i)
        i, j = i[there], j[there]
        near = np.bitwise_count(code[i] ^ code[j]) <= bits
        yield i[near], j[near]


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of an edge reaches, by alternating stars until nothing changes.

    Roots are rows too. Every round combines neighbours' minima before the shuffle and writes its edges.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    stars = cut(edges.where(F.col("a") != F.col("b")).select(high.alias("u"), low.alias("v")).distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        stars = cut(small)
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    bits: int = BITS) -> DataFrame:
    """Every row with its group: row (identity), doc_id, fingerprint long, component_id, kept.

    ``component_id`` is the smallest doc_id that can be reached over links; that row is ``kept``, of rows with the same
    doc_id the first by place. Documents without a word share fingerprint zero, and link like any other. An empty table gives no row.
    """
    prints = cut(fingerprints(docs, key=key, text=text, words=words))
    groups = cut(prints.groupBy("fingerprint").agg(F.min(ROW).alias("first")))
    roots = components(links(groups.select("fingerprint"), bits)).withColumnRenamed("node", "fingerprint")
    members = groups.join(roots, "fingerprint")
    firsts = members.groupBy("root").agg(F.min("first").alias("keeper"))
    joined = cut(members.join(firsts, "root").select("fingerprint", "keeper"))
    keepers = groups.join(joined, "fingerprint", "left").select("fingerprint", F.coalesce("keeper", "first").alias("keeper"))
    return prints.join(keepers, "fingerprint").select(
        ROW, f"{ROW}.doc_id", "fingerprint", F.col("keeper.doc_id").alias("component_id"),
        (F.col(ROW) == F.col("keeper")).alias("kept"))


@query("op9_simhash_groups")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
