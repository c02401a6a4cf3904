"""Substring deduplication: windows of words that occur earlier are cut out, found behind a count-min prefilter.

1. Every task counts the windows of its documents in a count-min sketch; the tasks' sketches are added cell by cell. A window isn't
   counted under its own hash but under the least hash of the word grams in it, which neighbours mostly share: one count
   stands for a run of windows. A cell's count is never below the number of documents that hold the window, so what
   the sketch calls single is single.
2. Windows whose cells all reach two are grouped exactly, by 128 bits of hash over their words: the first document and start
   of each. A task keeps one row per window before the shuffle, so copies in any number reach a group as one row per task.
3. Those starts return to their documents. A window is a repeat if the sketch let it through and it isn't first.

Repeats inside one document: two equal windows either belong to different runs or to one run longer than a gram's reach, both of
which count twice, or they are closer than that reach, and then are compared directly.

The sketch grows with the bytes of text up to ``MOST_BITS``, which bounds what a worker loads. Beyond that it lets ever more
windows through, and results stay the same.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, scratch, table

WINDOW = 20
GRAM = 8  # words of the grams whose least hash stands for a window
ROWS = 2  # rows of the sketch; its merged form is one bit a cell
MOST_BITS = 30  # a row has at most this power of two of cells, so that the merged sketch is 256 MB at most
BYTES_PER_CELL = 8  # of text; a run of windows takes some 45 bytes
SHARD = 16  # cells of a shard, as a power of two: partial sketches meet shard by shard
FLUSH = 1_500_000  # counts, or windows, that a task holds before it passes them on
MEMO = 150_000  # words that a worker remembers hashes of
SLICE = 1 << 20  # bytes of text worked on at once, or one text

SIGN_BITS = 16  # of a window's hash return with its start, should two texts of one id share their hash
SIGN = (1 << SIGN_BITS) - 1

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd multipliers
_S32 = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _M2
    return (x ^ (x >> _S32)) * _M1


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring sequences from theirs; the order counts."""
    return mix(left * _M1 + right)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words, put together from powers of two."""
    out, size, part, span = None, 0, words, 1
    while n:
        if n & 1:
            k = max(0, len(words) - size - span + 1)
            out = part[:k] if out is None else chain(out[:k], part[size:size + k])
            size += span
        n >>= 1
        if n:
            part = chain(part[:max(0, len(part) - span)], part[span:])
            span *= 2
    return out


def least(values: np.ndarray, n: int) -> np.ndarray:
    """Least of every ``n`` consecutive values."""
    reach = 1
    while reach < n:
        step = min(reach, n - reach)
        values = np.minimum(values[:max(0, len(values) - step)], values[step:])
        reach += step
    return values


class Words(dict):
    """word -> place in a table of hashes; starts again when it is full."""

    def __init__(self, limit: int = MEMO) -> None:
        super().__init__()
        self.limit, self.fresh = limit, []
        self.table = np.zeros((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.fresh.append(xxhash.xxh3_128_digest(word))
        return k

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Two 64-bit hashes of each word."""
        if len(self) > self.limit:
            self.clear()
            self.table = np.zeros((0, 2), np.uint64)
        at = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.fresh:
            self.table = np.concatenate([self.table, np.frombuffer(b"".join(self.fresh), "<u8").reshape(-1, 2)])
            self.fresh.clear()
        return self.table[at]


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """The rows of a batch with their texts, about ``SLICE`` bytes at a time."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(), dtype=np.int64)
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE, "right")))
        rows = batch.slice(begin, end - begin)
        yield rows, rows.column("text").cast(pa.binary()).to_pylist()
        begin = end


class Part:
    """Words and windows of some whole documents, one after the other."""

    def __init__(self, texts: Sequence[bytes | None], memo: Words, window: int, gram: int, both: bool = True) -> None:
        self.words = [t.split() if t else [] for t in texts]  # bytes split at exactly the six blanks
        flat = list(itertools.chain.from_iterable(self.words))
        self.ends = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        hashes = memo.hashes(flat)
        doc = np.repeat(np.arange(len(self.words)), self.ends - self.begins)
        places = np.arange(max(0, len(flat) - window + 1))
        self.at = places[places + window <= self.ends[doc[:len(places)]]]  # windows that stay inside their document
        self.doc = doc[self.at]
        short = grams(hashes[:, 0], gram)
        self.reach = window - gram + 1
        self.anchor = least(short, self.reach)[self.at]
        if both:
            self.keys = [grams(hashes[:, lane], window)[self.at] for lane in (0, 1)]
        fresh = np.ones(len(self.at), bool)
        fresh[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.runs = np.flatnonzero(fresh)

    def run_lengths(self) -> np.ndarray:
        return np.diff(np.append(self.runs, len(self.at)))


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    seed = np.uint64((row + 1) * int(_M2) % (1 << 64))
    return (mix(values + seed) >> np.uint64(64 - bits)).astype(np.uint32)


def partial_sketch(window: int, gram: int, bits: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (shard, counts): places of counts inside the shard, as often as counted but at most twice."""
    shards = 1 << max(0, bits - SHARD)

    def passed_on(values: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(rows):
            found = np.sort(cells(values, row, bits))
            third = np.zeros(len(found), bool)
            third[2:] = found[2:] == found[:-2]
            found = found[~third]
            cut = np.searchsorted(found, np.arange(shards + 1, dtype=np.uint64) << np.uint64(SHARD))
            place = (found & np.uint32((1 << SHARD) - 1)).astype("<u2")
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(some + row * shards, pa.int32()), pa.array(
                [place[cut[s]:cut[s + 1]].tobytes() for s in some], pa.binary())], names=["shard", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, n = Words(), [], 0
        for batch in batches:
            for _, texts in slices(batch):
                part = Part(texts, memo, window, gram, both=False)
                twice = part.run_lengths() > part.reach
                held.append(np.concatenate([part.anchor[part.runs], part.anchor[part.runs[twice]]]))
                n += len(held[-1])
                if n > FLUSH:
                    yield from passed_on(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield from passed_on(np.concatenate(held))

    return run


def merged_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of each shard, whose rows stand together: a bit per cell that was counted twice or more."""
    cell, current, total, waiting = 1 << SHARD, None, np.zeros(1 << SHARD, np.int64), []

    def add() -> None:
        nonlocal waiting
        if waiting:
            np.minimum(total + np.bincount(np.frombuffer(b"".join(waiting), "<u2"), minlength=cell), 2, out=total)
        waiting = []

    def done() -> pa.RecordBatch:
        add()
        out = np.packbits(total >= 2, bitorder="little").tobytes()
        total[:] = 0
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([out], pa.binary())], names=["shard", "bits"])

    for batch in batches:
        for shard, counts in zip(batch.column("shard").to_pylist(), batch.column("counts").to_pylist()):
            if shard != current:
                if current is not None:
                    yield done()
                current = shard
            waiting.append(counts)
            if len(waiting) >= 1000:
                add()
    if current is not None:
        yield done()


def sketch(texts: DataFrame, *, bits: int, window: int = WINDOW, gram: int = GRAM, rows: int = ROWS) -> str:
    """Counts all windows; returns the folder of the merged sketch, a table of at most ``rows << (bits - 16)`` bit maps."""
    counted = texts.select("text").mapInArrow(partial_sketch(window, gram, bits, rows), "shard int, counts binary")
    folder = scratch(texts.sparkSession, "sketch")
    counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(merged_shards, "shard int, bits binary") \
        .write.parquet(folder)
    return folder


@functools.lru_cache(maxsize=1)
def load(folder: str, bits: int, rows: int) -> np.ndarray:
    """The merged sketch, one per Python worker."""
    shards, size = 1 << max(0, bits - SHARD), 1 << (SHARD - 3)
    out = np.zeros((rows, shards * size), np.uint8)
    fs, path = pafs.FileSystem.from_uri(folder)
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.is_file and info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(256):
                    for shard, data in zip(batch.column("shard").to_pylist(), batch.column("bits").to_pylist()):
                        row, s = divmod(shard, shards)
                        out[row, s * size:(s + 1) * size] = np.frombuffer(data, np.uint8)
    return out


def flagged(part: Part, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Windows that the sketch doesn't call single."""
    heads = part.anchor[part.runs]
    ok = np.ones(len(heads), bool)
    for row in range(len(bitmap)):
        at = cells(heads, row, bits)
        ok &= (bitmap[row][at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
    return np.repeat(ok, part.run_lengths())


def first_starts(folder: str, window: int, gram: int, bits: int, rows: int):
    """Rows (k1, k2, doc, place): of the windows let through, the first of each that a task holds at once.

    ``doc`` is the id and ``place`` the text's hash and the start, both inverted: the greatest is the first, null after all.
    """
    def passed_on(held: list[tuple]) -> pa.RecordBatch:
        k1, k2, missing, doc_id, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((place, doc_id, missing, k2, k1))
        k1, k2 = k1[order], k2[order]
        head = np.ones(len(order), bool)
        head[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        take = order[head]
        return pa.RecordBatch.from_arrays(
            [pa.array(k1[head].view(np.int64)), pa.array(k2[head].view(np.int64)), pa.array(~doc_id[take], mask=missing[take]),
             pa.array(~place[take])], names=["k1", "k2", "doc", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, memo, held, n = load(folder, bits, rows), Words(), [], 0
        for batch in batches:
            for some, texts in slices(batch):
                part = Part(texts, memo, window, gram)
                ids, version = some.column("doc_id"), some.column("version")
                use = flagged(part, bitmap, bits)
                doc = part.doc[use]
                held.append((part.keys[0][use], part.keys[1][use], ids.is_null().to_numpy(zero_copy_only=False)[doc],
                             ids.fill_null(0).to_numpy()[doc],
                             version.to_numpy().astype(np.int64)[doc] << 32 | part.at[use] - part.begins[doc]))
                n += len(doc)
                if n > FLUSH:
                    yield passed_on(held)
                    held, n = [], 0
        if n:
            yield passed_on(held)

    return run


def cleaned(folder: str, window: int, gram: int, bits: int, rows: int):
    """Rows (doc_id, n_words, n_removed, kept) from rows (doc_id, text, firsts)."""
    def repeats(part: Part, use: np.ndarray, doc: np.ndarray, start: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Marks the words that repeated windows cover; ``doc``, ``start``, ``sign`` are the windows that are first."""
        k = len(part.ends)
        total = int(part.ends[-1]) if k else 0
        index = np.full(total + 1, -1, np.int64)  # window that begins at a word
        index[part.at] = np.arange(len(part.at))
        place = part.begins[doc] + start
        inside = place < part.ends[doc]
        window_no = index[np.where(inside, place, total)]
        hit = window_no >= 0
        hit[hit] = (part.keys[0][window_no[hit]] & np.uint64(SIGN)) == sign[hit].astype(np.uint64)
        first = np.zeros(len(part.at), bool)
        first[window_no[hit]] = True
        repeated = use & ~first
        for d in range(1, part.reach):  # equal windows of one run that counted once
            same = (part.keys[0][d:] == part.keys[0][:-d]) & (part.keys[1][d:] == part.keys[1][:-d]) & (part.doc[d:] == part.doc[:-d])
            repeated[d:] |= same
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, part.at[repeated], 1)
        np.add.at(edge, part.at[repeated] + window, -1)
        return np.cumsum(edge[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, memo = load(folder, bits, rows), Words()
        for batch in batches:
            for some, texts in slices(batch):
                part = Part(texts, memo, window, gram)
                lists = some.column("firsts")
                sizes = lists.value_lengths().fill_null(0).to_numpy()
                inner = lists.flatten().to_numpy()
                doc = np.repeat(np.arange(len(texts)), sizes)
                gone = repeats(part, flagged(part, bitmap, bits), doc,
                               inner >> SIGN_BITS, inner & SIGN)
                kept, removed = [], []
                for words, begin, end in zip(part.words, part.begins.tolist(), part.ends.tolist()):
                    mask = gone[begin:end]
                    n = int(mask.sum())
                    removed.append(n)
                    kept.append(b" ".join(itertools.compress(words, (~mask).tolist()) if n else words))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array((part.ends - part.begins)), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def cut_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                bits: int | None = None, rows: int = ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words of each document without those that an earlier window covers.

    A window is ``window`` consecutive words of one row; it is earlier at a smaller id or, in the same document, at a smaller start.
    Rows with the same id and different texts are documents in the order of a hash of their texts; rows equal in both are one
    document, and take no words from each other. A missing id comes after all others. Words are what stands between runs of the
    six ASCII blanks; null texts have none. An empty table gives no row. Columns not named are left out. A task holds the words of
    the longest text.
    """
    gram = min(gram, window)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.hash(F.col(text)).alias("version"))
    if bits is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(SHARD, (size // BYTES_PER_CELL).bit_length()))
    settings = (window, gram, bits, rows)
    folder = sketch(texts, window=window, gram=gram, bits=bits, rows=rows)
    through = texts.mapInArrow(first_starts(folder, *settings),
                               "k1 long, k2 long, doc long, place long")
    first = through.groupBy("k1", "k2").agg(F.max(F.struct("doc", "place")).alias("f"))
    place = F.bitwise_not("f.place")
    start = F.shiftleft(place.bitwiseAND(0x7FFFFFFF), SIGN_BITS).bitwiseOR(F.col("k1").bitwiseAND(SIGN))
    back = first.groupBy(F.bitwise_not("f.doc").alias("of"), F.shiftright(place, 32).cast("int").alias("at")).agg(
        F.collect_list(start).alias("firsts"))  # at most one per window of a document
    own = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("at"))
    joined = texts.join(back, own, "left").select("doc_id", "text", "firsts")
    return joined.mapInArrow(cleaned(folder, *settings), "doc_id long, n_words long, n_removed long, kept string")


SQL = r"""
WITH t AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS win FROM t, unnest(range(1, len(words) - 18)) u(s)),
r AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, s) > 1),
g AS (SELECT DISTINCT doc_id, s + k AS p FROM r, range(0, 20) o(k)),
p AS (SELECT t.doc_id, u.p, words[u.p] AS word FROM t, unnest(range(1, len(words) + 1)) u(p)),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p ANTI JOIN g ON g.doc_id = p.doc_id AND g.p = p.p
      GROUP BY p.doc_id)
SELECT t.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""


@query("op11_substring_dedup", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
