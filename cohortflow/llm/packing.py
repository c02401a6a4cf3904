"""Best-fit packing of token sequences into rows of fixed capacity, in residual rounds.

Every partition packs its own items by best fit, longest first, and emits the bins that are nearly full. The underfull
bins of several partitions then meet in one, where each is an item as long as its content, and are packed again; the
rounds end in one partition. Two bins that are more than half full can't become one, so such a bin is opened and its parts
go on one by one. A bin carries its pieces, at most ``capacity`` of them, so a round shuffles underfull bins only.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, query, table
from .encoding import encoder, tokenizer_path

CAPACITY = 4096
SLACK = 8  # a bin with at most this much room is nearly full: it is emitted in the round that made it
FAN_IN = 16  # partitions whose underfull bins meet in the next round
BUFFER = 200_000  # items that a task packs at a time
MOST = 2_000_000  # underfull bins that one task takes in the last rounds

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_BIN = pa.schema([("part", pa.int64()), ("bin", pa.int64()), ("fill", pa.int64()), ("items", pa.list_(_PIECE))])
_BIN_DDL = ("part long, bin long, fill long, items array<struct<doc_id: long, piece: int, start: long, length: long, "
            "ids_crc32: long, offset: long>>")


def best_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Items by index in bins: longest first, each into the bin that it leaves the least room in."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}  # bins by the room they have
    rooms: list[int] = []  # the keys of room, sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = bisect.bisect_left(rooms, lengths[i])
        if k < len(rooms):
            left, same = rooms[k], room[rooms[k]]
            b = same.pop()
            if not same:
                del room[left], rooms[k]
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        if left := left - lengths[i]:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append(b)
    return bins


def _packed(lengths: list[int], items: list, capacity: int, part: int, first: int, last: bool) -> pa.RecordBatch:
    """The bins of one best fit; ``items`` are lists of pieces. Unless it is the last round, bins that are neither nearly
    full nor at most half full are opened."""
    fills, members = [], []
    for chosen in best_fit(lengths, capacity):
        if not last and capacity // 2 < sum(lengths[i] for i in chosen) < capacity - SLACK:
            fills += [lengths[i] for i in chosen]
            members += [items[i] for i in chosen]
            continue
        at, own = 0, []
        for i in chosen:
            own += [{**x, "offset": x["offset"] + at} for x in items[i]] if at else items[i]
            at += lengths[i]
        fills.append(at)
        members.append(own)
    n = len(fills)
    return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()),
                                       pa.array(fills, pa.int64()), pa.array(members, _BIN.field("items").type)], schema=_BIN)


def first_round(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str, text: str) -> DataFrame:
    """Bins of each partition's pieces: a document's ids and the end id, cut only if longer than a bin."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, first, last = encoder(tokenizer), TaskContext.get().partitionId(), 0, False
        end = enc.pack([end_id])
        lengths, items = [], []
        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).cast(pa.binary()).to_pylist())):
                ids = enc.unpack(packed + end).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start:start + capacity]
                    lengths.append(len(own))
                    items.append([{"doc_id": doc_id, "piece": piece, "start": start, "length": len(own),
                                   "ids_crc32": zlib.crc32(own.tobytes()), "offset": 0}])
            if len(items) >= BUFFER:
                yield (out := _packed(lengths, items, capacity, part, first, last))
                first += out.num_rows
                lengths, items = [], []
        yield _packed(lengths, items, capacity, part, first, last)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(pack, _BIN_DDL)


def next_round(bins: DataFrame, capacity: int, last: bool) -> DataFrame:
    """Best fit over underfull bins as items."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        lengths, items = [], []
        for batch in batches:
            lengths += batch.column("fill").to_pylist()
            items += batch.column("items").to_pylist()
            if len(items) >= BUFFER:
                yield (out := _packed(lengths, items, capacity, part, first, last))
                first += out.num_rows
                lengths, items = [], []
        yield _packed(lengths, items, capacity, part, first, last)

    return bins.select("fill", "items").mapInArrow(pack, _BIN_DDL)


def pack(docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = CAPACITY, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Every piece and its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and hold the end id alone. Repeated rows are packed each. Every piece is in one sequence,
    gapless from offset 0. An empty table gives no row. Of other columns none is read.
    """
    spark = docs.sparkSession
    bins = cut(first_round(docs, tokenizer, end_id, capacity, key, text))
    width, done, level, last = bins.select("part").distinct().count(), [], 1, False
    full = F.col("fill") >= capacity - SLACK
    while not last:
        done.append(_placed(bins.where(full), level))
        rest = bins.where(~full)
        narrower = max(1, -(-width // FAN_IN), -(-rest.count() // MOST))
        last = narrower == 1 or narrower >= width  # one partition, or as narrow as the bound lets it be
        bins, width, level = cut(next_round(rest.repartition(narrower), capacity, last)), narrower, level + 1
    done.append(_placed(bins, level))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _placed(bins: DataFrame, level: int) -> DataFrame:
    """Pieces of finished bins. A sequence's number holds its round, partition and place there."""
    number = F.lit(level << 56) + F.shiftleft(F.col("part"), 32) + F.col("bin")
    return bins.select(number.alias("sequence_id"), F.explode("items").alias("x")).select(
        "x.doc_id", "x.piece", "x.start", "x.length", "x.ids_crc32", "sequence_id", "x.offset")


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
