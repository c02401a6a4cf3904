"""Approximate nearest neighbours by cross-polytope hashing.

Largest inner product becomes nearest direction: index vectors are divided by the largest norm of their band and get one more
coordinate that makes them unit vectors, queries are made unit vectors with a zero there. A band holds norms that differ by less
than a fifth, so that coordinate stays small; in a cell a query meets vectors of all bands. A table turns vectors by a fast pseudo-rotation
(three rounds of random signs and a Hadamard transform) and assigns them to the nearest signed axis. A query looks in several
cells of every table, those of its largest turned coordinates, and what it finds there is ranked by the exact inner
product of the original vectors.

Bands of few vectors, which cells can't part, are compared with every query, and so is the whole index with queries that found
too few in their cells.

Cells are dealt in groups. A group with many vectors is split into blocks, and so are the queries, so that a task holds a bounded
number of either. Of equal vectors only the first ``k + 1`` ids can be among ``k`` nearest; the others are searched for nobody,
which is exact and takes the weight out of a vector that many rows share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, query, table

NEAREST = 20
TABLES = 8
PROBES = 36
GROUPS = 4  # groups of cells per table
BLOCK = 32_768  # index vectors, and queries, of a group that one task holds
PER_OCTAVE = 4  # bands of norms
FEW = 256  # index vectors from which on a band is hashed: as many as a table of 64 coordinates has cells
SEED = 11
_TIE = 1e-9  # relative: how far a fast product may be off the exact one


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2)
        step *= 2
    return x.reshape(n, width) / np.sqrt(width)


def rotated(x: np.ndarray, t: int, seed: int = SEED) -> np.ndarray:
    """Table ``t``'s pseudo-rotation; the width is a power of two."""
    rng = np.random.default_rng((seed, t))
    for _ in range(3):
        x = hadamard(x * rng.choice((-1.0, 1.0), x.shape[1]))
    return x


def sides(x: np.ndarray) -> np.ndarray:
    """Closeness of each row to all signed axes: axis a at a, its opposite at width + a."""
    return np.concatenate((x, -x), axis=1)


def _padded(x: np.ndarray, last: np.ndarray | float) -> np.ndarray:
    width = 1 << int(x.shape[1]).bit_length()  # room for one more coordinate
    out = np.zeros((len(x), width))
    out[:, :x.shape[1]] = x
    out[:, x.shape[1]] = last
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _vectors(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """id, v (packed doubles), norm of the usable vectors of the given width."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, width)
            top = np.abs(x).max(1, initial=0.0)  # squares of very small or large values would be 0 or infinite
            norm = np.minimum(top * np.sqrt(((x / top[:, None]) ** 2).sum(1)), np.finfo(float).max)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(norm)], names=["id", "v", "norm"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(usable("v") & (F.size("v") == width))
    return rows.mapInArrow(run, "id long, v binary, norm double")


def _index_cells(vectors: DataFrame, largest: dict[int, float], tables: int) -> DataFrame:
    """t, cell, id, v: every vector in its cell of every table; ``largest`` has the largest norm of each band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v")) / np.array([[largest[b]] for b in batch.column("band").to_pylist()])
            x = _padded(x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1))))
            for t in range(tables):
                cell = sides(rotated(x, t)).argmax(1).astype("int32")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, "int32")), pa.array(cell),
                                                  batch.column("id"), batch.column("v")], names=["t", "cell", "id", "v"])

    return vectors.mapInArrow(run, "t int, cell int, id long, v binary")


def _probes(queries: DataFrame, tables: int, probes: int, groups: int) -> DataFrame:
    """t, grp, cells, id, v: for every query and table the cells to look in, by group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            x = _padded(x / batch.column("norm").to_numpy()[:, None], 0.0)
            for t in range(tables):
                near = sides(rotated(x, t))
                cells = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype("int32")
                for g in range(groups):
                    own = [c[c % groups == g] for c in cells]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, "int32")), pa.array(np.full(len(x), g, "int32")),
                         pa.array(own, pa.list_(pa.int32())), batch.column("id"), batch.column("v")],
                        names=["t", "grp", "cells", "id", "v"])

    return queries.mapInArrow(run, "t int, grp int, cells array<int>, id long, v binary").where(F.size("cells") > 0)


def _ranked(k: int):
    """Search of one task: its queries in its cells."""
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return _found([], [], [])
        cell = index.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, ids = cell[order], index.column("id").to_numpy()[order]
        x, q = _matrix(index.column("v").combine_chunks())[order], _matrix(queries.column("v").combine_chunks())
        qid = queries.column("id").to_numpy()
        looked = queries.column("cells").combine_chunks()
        who = np.repeat(np.arange(len(qid)), np.diff(looked.offsets.to_numpy()))
        where = looked.flatten().to_numpy()
        by_cell = np.argsort(where, kind="stable")
        who, where = who[by_cell], where[by_cell]
        got: list[list] = [[] for _ in qid]
        for c in np.unique(where):
            a, b = np.searchsorted(cell, (c, c + 1))
            if a == b:
                continue
            for asked in np.array_split(who[slice(*np.searchsorted(where, (c, c + 1)))], 1 + (b - a) // 4096):
                product = q[asked] @ x[a:b].T
                for i, row in zip(asked, product):
                    row[ids[a:b] == qid[i]] = -np.inf
                    least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    near = np.flatnonzero(row >= least - _TIE * abs(least) if np.isfinite(least) else row > -np.inf)
                    got[i].append(near + a)
        out_q, out_v, out_s = [], [], []
        for i, parts in enumerate(got):
            if not parts:
                continue
            at = np.concatenate(parts)
            score = (x[at] * q[i]).sum(1)
            best = np.lexsort((ids[at], -score))[:k]
            out_q.append(np.full(len(best), qid[i]))
            out_v.append(ids[at][best])
            out_s.append(score[best])
        return _found(out_q, out_v, out_s)

    return run


def _found(q: list, v: list, s: list) -> pa.Table:
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return pa.table({"query_id": pa.array(join(q, "i8")), "vec_id": pa.array(join(v, "i8")), "score": pa.array(join(s, "f8"))})


def _all_cells(vectors: DataFrame, t: int, groups: int) -> DataFrame:
    """t, cell, id, v, grp: a table whose cells hold vectors by id; its queries look in all of them."""
    cell = F.pmod("id", F.lit(groups)).cast("int")
    return vectors.select(F.lit(t).alias("t"), cell.alias("cell"), "id", "v", cell.alias("grp"))


def _all_probes(queries: DataFrame, t: int, groups: int) -> DataFrame:
    """t, grp, cells, id, v: every query in every cell of such a table."""
    placed = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return placed.select(F.lit(t).alias("t"), "grp", F.array("grp").alias("cells"), "id", "v")


def _search(cells: DataFrame, probes: DataFrame, asked: int, k: int, groups: int, block: int) -> DataFrame:
    """query_id, vec_id, score: what is nearest in the cells that each of the ``asked`` queries looks in."""
    sizes = {(r["t"], r["grp"]): r["count"] for r in cells.groupBy("t", "grp").count().collect()}  # tables x groups rows
    blocks = F.create_map(*[F.lit(x) for (t, g), n in sorted(sizes.items()) for x in (t * groups + g, -(-n // block))])
    place = F.col("t") * groups + F.col("grp")
    parts = max(1, -(-asked // block))
    left = (cells.withColumn("blk", F.pmod(F.xxhash64("id"), blocks[place]))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    right = (probes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
             .where(blocks[place].isNotNull())
             .withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), blocks[place].cast("long") - 1))))
    on = ["t", "grp", "blk", "part"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(
        _ranked(k), "query_id long, vec_id long, score double").distinct()


def search(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST,
           tables: int = TABLES, probes: int = PROBES, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: up to ``k`` rows found nearest to each query row, itself left out.

    ``is_query`` is a condition on the key, there named ``id``. Vectors that are null, zero, or hold a null or non-finite component take no part, nor
    do those of another length than most, nor rows without a key. Ties go to the smaller id. Repeated (id, vector)
    rows count once. An empty table gives no row.
    """
    spark = vectors.sparkSession
    sizes = vectors.where(usable(vector)).groupBy(F.size(vector).alias("w")).count().orderBy(F.desc("count"), "w").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    known = cut(_vectors(vectors.where(F.col(key).isNotNull()), key, vector, sizes["w"]).dropDuplicates(["id", "v"]))
    top = known.agg(F.max("norm")).first()[0]
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = W.partitionBy("v").orderBy("id")
    index = known.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n")
    index = cut(index.withColumn("band", F.floor((F.log2(F.lit(top)) - F.log2("norm")) * PER_OCTAVE)))
    asked = known.where(is_query)
    bands = index.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()  # 8,392 at most
    largest = {r["band"]: r["top"] for r in bands if r["n"] >= FEW}
    hashed = F.col("band").isin(*largest)
    cells = _all_cells(index.where(~hashed), tables, groups)
    looked = _all_probes(asked, tables, groups)
    if largest:
        own = _index_cells(index.where(hashed), largest, tables).withColumn("grp", F.col("cell") % groups)
        cells, looked = own.unionByName(cells), _probes(asked, tables, probes, groups).unionByName(looked)
    found = _search(cut(cells), looked, asked.count(), k, groups, block)
    if largest:
        found = cut(found)
        enough = found.groupBy("query_id").count().where(F.col("count") >= k)
        short = cut(asked.join(enough, asked["id"] == enough["query_id"], "left_anti"))
        n = short.count()
        if n:
            more = _search(cut(_all_cells(index, 0, groups)), _all_probes(short, 0, groups), n, k, groups, block)
            found = found.unionByName(more).distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op4_cross_polytope_search")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
