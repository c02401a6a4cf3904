"""Token sequences as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A shard ``shard-NNNNN.rec`` is a run of frames:

    length of the payload  u64 | masked crc32 of these 8 bytes  u32 | payload | masked crc32 of the payload  u32

A payload is a header (doc_id i64, doc_id known u8, bytes per id u8) and the ids; all numbers are little-endian. A mask
rotates a checksum by 15 bits and adds a constant, so that the checksum of data that holds checksums stays sound. Next to
it ``shard-NNNNN.idx`` holds one u64 per record: where its frame begins, and at the end the shard's size.

Shards are cut by ranges of doc_id, so their order and the order inside them is ascending doc_id. A task writes its
files under a name of its own and renames them when they are whole: a task that runs again gives the same files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, query, scratch, table
from .encoding import encoder, tokenizer_path

DOCS_PER_SHARD = 8192

_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_DOC = struct.Struct("<qBB")
_ROTATE, _ADD = 15, 0xA282EAD8  # fixed values of the file format


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> _ROTATE | crc << (32 - _ROTATE)) + _ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _TAIL.pack(masked(length)), payload, _TAIL.pack(masked(payload))))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame that begins at ``at``, and where the next one begins; an error if a checksum is off."""
    size, crc = _HEAD.unpack_from(data, at)
    if crc != masked(bytes(data[at:at + 8])):
        raise ValueError(f"length checksum at byte {at}")
    begin = at + _HEAD.size
    payload = bytes(data[begin:begin + size])
    if len(payload) != size or _TAIL.unpack_from(data, begin + size)[0] != masked(payload):
        raise ValueError(f"payload checksum at byte {at}")
    return payload, begin + size + _TAIL.size


def payload_of(doc_id: int | None, packed: bytes, width: int) -> bytes:
    return _DOC.pack(doc_id or 0, doc_id is not None, width) + packed


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids)"""
    doc_id, known, width = _DOC.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=_DOC.size)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, key: str = "doc_id", text: str = "text",
                  docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Encode whole texts, append ``end_id`` and write the shards; returns their manifest, one row per shard.

    Manifest: shard int, n_records, n_tokens, n_bytes long. Null texts count as empty. Rows with equal keys stand side
    by side, ordered by text; null keys come first. An empty table writes no shard. Only ``key`` and ``text`` are read.
    """
    shards = max(1, -(-docs.count() // docs_per_shard))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        end, width = enc.pack([end_id]), enc.dtype.itemsize
        fs, base = pafs.FileSystem.from_uri(folder)
        own = f"{base}/{uuid.uuid4().hex}"
        out, starts, tokens, at = None, [], 0, 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, packed in zip(ids, enc.encode(batch.column("text").cast(pa.binary()).to_pylist())):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(own + ".rec")
                data = frame(payload_of(doc_id, packed + end, width))
                starts.append(at)
                at += out.write(data) or len(data)
                tokens += len(packed) // width + 1
        if out is None:
            return
        out.close()
        with fs.open_output_stream(own + ".idx") as index:
            index.write(np.array([*starts, at], "<u8").tobytes())
        for kind in ("idx", "rec"):  # the records last: where they are, the index is
            fs.move(f"{own}.{kind}", f"{base}/{name(shard)}.{kind}")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n_records": len(starts), "n_tokens": tokens, "n_bytes": at}],
                                         schema=_MANIFEST)

    ranged = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ranged.mapInArrow(write, "shard int, n_records long, n_tokens long, n_bytes long"))


_MANIFEST = pa.schema([("shard", pa.int32()), ("n_records", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def name(shard: int) -> str:
    return f"shard-{shard:05d}"


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the shards: shard, record, doc_id, start (ids of all records before it), n_tokens, ids_crc32.

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers. Checksums are verified.
    """
    base = manifest.withColumn("base", F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)))
    per_task = base.select("shard", F.coalesce("base", F.lit(0)).alias("base")).repartition(max(1, manifest.count()), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                fs, root = pafs.FileSystem.from_uri(folder)
                with fs.open_input_stream(f"{root}/{name(shard)}.rec") as f:
                    rows = []
                    for record, payload in enumerate(_stream(f)):
                        doc_id, ids = parse(payload)
                        rows.append((shard, record, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 8192:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    return per_task.mapInArrow(read, _READ_DDL)


_READ_DDL = "shard int, record long, doc_id long, start long, n_tokens long, ids_crc32 long"
_READ = pa.schema([("shard", pa.int32()), *[(c, pa.int64()) for c in ("record", "doc_id", "start", "n_tokens", "ids_crc32")]])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_READ)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ)], schema=_READ)


def _stream(f: pa.NativeFile) -> Iterator[bytes]:
    """Payloads of a shard, one in memory at a time."""
    at = 0
    while head := f.read(_HEAD.size):
        size, crc = _HEAD.unpack(head)
        if crc != masked(head[:8]):
            raise ValueError(f"length checksum at byte {at}")
        payload = f.read(size)
        if _TAIL.unpack(f.read(_TAIL.size))[0] != masked(payload):
            raise ValueError(f"payload checksum at byte {at}")
        at += _HEAD.size + size + _TAIL.size
        yield payload


def read_index(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record: shard, record, offset, n_bytes (of its frame). Sort these as you like, then `read_at`."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                fs, root = pafs.FileSystem.from_uri(folder)
                with fs.open_input_stream(f"{root}/{name(shard)}.idx") as f:
                    at = np.frombuffer(f.read(), "<u8").astype("int64")
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, "int32")), pa.array(np.arange(n)),
                                                  pa.array(at[:-1]), pa.array(np.diff(at))],
                                                 names=["shard", "record", "offset", "n_bytes"])

    return manifest.select("shard").repartition(max(1, manifest.count()), "shard").mapInArrow(
        read, "shard int, record long, offset long, n_bytes long")


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The index in a repeatable random order over all shards: one pass of training."""
    return index.withColumn("place", F.xxhash64("shard", "record", F.lit(seed))).repartitionByRange(F.col("place")) \
        .sortWithinPartitions("place", "shard", "record").drop("place")


def read_at(entries: DataFrame, folder: str) -> DataFrame:
    """The records that index rows point at, in their order: doc_id, ids."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            docs, ids, files = [], [], {}
            for e in batch.to_pylist():
                if e["shard"] not in files:
                    if len(files) == 64:
                        files.pop(next(iter(files))).close()
                    files[e["shard"]] = fs.open_input_file(f"{root}/{name(e['shard'])}.rec")
                doc_id, x = parse(unframe(files[e["shard"]].read_at(e["n_bytes"], e["offset"]))[0])
                docs.append(doc_id)
                ids.append(x.astype("int32"))
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["doc_id", "ids"])

    return entries.mapInArrow(read, "doc_id long, ids array<int>")


@query("op8_binary_records")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as records, read the files back, digest what they hold."""
    folder = scratch(spark, "records")
    manifest = write_records(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_records(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
