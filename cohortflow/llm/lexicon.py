"""BPE encoding and decoding over a lexicon: frequent words in a minimal acyclic transducer, others merged exactly.

Spark counts the words of all texts; the most frequent are compiled into an automaton whose states are shared between equal
suffixes. An arc adds to an output, and the sum over a word's arcs is its number in sorted order, under which its token ids
stand in a flat table. The automaton is one file of arrays in the shared folder, which tasks map into memory; where that
folder isn't a file system's, they read it. Words that it doesn't hold are merged pair by pair in order of rank, many words
at a time.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, query, scratch, table
from .encoding import _LATIN, _PLAIN, _RUN, Encoder, _slices, encoder, tokenizer_path

FREQUENT = 50_000  # words of the lexicon; about 3 MB
MEMO = 400_000  # stretches that a worker remembers, next to the library's tokenizer and the vocabulary
TALLY = 200_000  # stretches that a task counts before it passes their words on
LONG = 400  # bytes of a word from which it is merged by itself, in time n log n
_NO_RANK = np.int64(1) << 40


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Vocabulary:
    """Bytes of each id, and merges as (left id, right id) -> (rank, id), of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: b for b, c in byte_symbols().items()}
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token)
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.added = added
        self.single = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], np.int64)
        self.size = len(self.bytes)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the merges, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), at, -1)

    def merge(self, words: Sequence[bytes], dtype: np.dtype = np.dtype("<u4")) -> list[bytes]:
        """Packed ids of each word: the pair of the lowest rank is joined, leftmost first, until none is left."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        while order and len(words[order[-1]]) > LONG:
            k = order.pop()
            out[k] = np.array(self._merge_long(words[k]), dtype).tobytes()
        for part in _runs(order, words):
            for k, ids in zip(part, self._merge([words[k] for k in part], dtype)):
                out[k] = ids
        return out

    @functools.cached_property
    def _ranks(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist()))

    @functools.cached_property
    def _made(self) -> list[int]:
        return self.made[np.argsort(self.ranks)].tolist()

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for one long word: neighbours in a linked list, open pairs in a heap of (rank, place)."""
        first = self.single[np.frombuffer(word, np.uint8)]
        at = self.look_up(first[:-1], first[1:])
        sym, n, size = first.tolist(), len(word), self.size
        rank = [*np.where(at >= 0, self.ranks[at], -1).tolist(), -1]  # of the pair that begins here; -1 if it can't be joined
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | p for p, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        ranks, made, pop, push, mask = self._ranks.get, self._made, heapq.heappop, heapq.heappush, (1 << 40) - 1
        while heap:
            e = pop(heap)
            r, p = e >> 40, e & mask
            if rank[p] != r:  # one of the two has been joined to another
                continue
            q = after[p]
            sym[p], sym[q], rank[q] = made[r], -1, -1
            after[p] = q = after[q]
            rank[p] = -1
            if q < n:
                before[q] = p
                rank[p] = r = ranks(sym[p] * size + sym[q], -1)
                if r >= 0:
                    push(heap, r << 40 | p)
            q = before[p]
            if q >= 0:
                rank[q] = r = ranks(sym[q] * size + sym[p], -1)
                if r >= 0:
                    push(heap, r << 40 | q)
        return [x for x in sym if x >= 0]

    def _merge(self, words: list[bytes], dtype: np.dtype) -> list[bytes]:
        n, width = len(words), max(map(len, words)) + 1
        sym = np.full((n, width), -1, np.int64)
        size = np.fromiter(map(len, words), np.int64, n)
        sym[np.arange(width) < size[:, None]] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        out: list[bytes] = [b""] * n
        alive = np.arange(n)
        at = self.look_up(sym[:, :-1], sym[:, 1:])
        rank = np.where(at >= 0, self.ranks[at], _NO_RANK)
        places = np.arange(width - 1)
        while len(alive):
            best = rank.argmin(1)
            row = np.arange(len(alive))
            done = rank[row, best] == _NO_RANK
            if done.any():
                left = sym[done]
                used = left >= 0
                flat, ends = left[used].astype(dtype).tobytes(), (used.sum(1).cumsum() * dtype.itemsize).tolist()
                for k, begin, end in zip(alive[done].tolist(), [0, *ends], ends):
                    out[k] = flat[begin:end]
                go = ~done
                alive, sym, rank, best = alive[go], sym[go], rank[go], best[go]
                row = np.arange(len(alive))
                if not len(alive):
                    break
            new = self.made[self.look_up(sym[row, best], sym[row, best + 1])]
            moved = places[None, :] > best[:, None]
            sym[:, :-1] = np.where(moved, sym[:, 1:], sym[:, :-1])
            sym[:, -1] = -1
            sym[row, best] = new
            rank[:, :-1] = np.where(moved[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NO_RANK
            for p, use in ((best - 1, best > 0), (best, np.full(len(row), True))):
                r, p = row[use], p[use]
                at = self.look_up(sym[r, p], sym[r, p + 1])
                rank[r, p] = np.where(at >= 0, self.ranks[at], _NO_RANK)
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker."""
    return Vocabulary(path)


def _runs(order: list[int], words: Sequence[bytes], cells: int = 1 << 19) -> Iterator[list[int]]:
    """Words of like length together, in blocks of bounded size; ``order`` is by length."""
    part: list[int] = []
    for k in order:
        if part and (len(part) + 1) * (len(words[k]) + 1) > cells:
            yield part
            part = []
        part.append(k)
    if part:
        yield part


def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The automaton of distinct, non-empty words with their ids, as one block of arrays.

    Words are added in sorted order; when a word ends, the states behind its last shared letter are final for good, and each
    becomes the equal state that is there already, if there is one.
    """
    entries = sorted(entries)
    states: dict[tuple, int] = {}  # (final, arcs) -> number of the state
    arcs_of: list[tuple] = []
    counts: list[int] = []  # words that end in or behind a state
    path: list[list] = [[False, []]]  # open states of the current word: final, arcs [(label, target)]
    labels = bytearray()

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in states:
                states[key] = len(arcs_of)
                arcs_of.append(key)
                counts.append(final + sum(counts[t] for _, t in arcs))
            path[-1][1].append((labels.pop(), states[key]))

    before = b""
    for word, _ in entries:
        shared = next((k for k, (a, b) in enumerate(zip(word, before)) if a != b), min(len(word), len(before)))
        close(shared)
        for b in word[shared:]:
            path.append([False, []])
            labels.append(b)
        path[-1][0] = True
        before = word
    close(0)
    arcs_of.append((path[0][0], tuple(path[0][1])))
    keys, targets, adds = [], [], []
    for s, (final, arcs) in enumerate(arcs_of):
        passed = int(final)
        for label, t in arcs:
            keys.append(s << 8 | label)
            targets.append(t)
            adds.append(passed)
            passed += counts[t]
    ids = [x for _, xs in entries for x in xs]
    ends = np.cumsum([0, *(len(xs) for _, xs in entries)])
    final = [f for f, _ in arcs_of]
    arrays = [np.array(x, "<u4") for x in (keys, targets, adds, final, ends, ids)]
    return b"".join([np.array([len(a) for a in arrays], "<u8").tobytes(), *(a.tobytes() for a in arrays)])


class Lexicon:
    """A compiled automaton over a buffer that may be mapped memory."""

    def __init__(self, data) -> None:
        sizes = np.frombuffer(data, "<u8", 6).astype(int)
        at, arrays = 48, []
        for n in sizes:
            arrays.append(np.frombuffer(data, "<u4", n, at))
            at += 4 * n
        self.keys, self.targets, self.adds, self.final, self.ends, self.ids = arrays

    @property
    def words(self) -> int:
        return len(self.ends) - 1

    @property
    def states(self) -> int:
        return len(self.final)

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """Number of each word, or -1; all words take a step at a time."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return found
        length = np.fromiter(map(len, words), np.int64, n)
        letters = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        live = np.flatnonzero(length > 0)
        state, total = np.full(len(live), self.states - 1, np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 8 | letters[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key.astype("<u4")), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at, total = live[ok], at[ok], total[ok] + self.adds[at[ok]]
            state = self.targets[at].astype(np.int64)
            step += 1
            over = length[live] == step
            ends = over & (self.final[state] == 1)
            found[live[ends]] = total[ends]
            live, state, total = live[~over], state[~over], total[~over]
        return found


class LexiconEncoder(Encoder):
    """The library's result, without the library's merges: automaton first, exact merges for other words."""

    def __init__(self, path: str, lexicon: Lexicon) -> None:
        super().__init__(path, MEMO)
        if self.kind != "spaces":
            raise ValueError("a byte-level BPE file is needed")
        self.vocabulary, self.lexicon = vocabulary(path), lexicon
        self.ids, self.ends = lexicon.ids.astype(self.dtype).tobytes(), lexicon.ends.tolist()
        self.known = self.unseen = 0

    def _words(self, words: list[bytes]) -> list[bytes]:
        return self._look_up(words)

    def _library(self, texts: list[str]) -> list[bytes]:
        split = [words_of(self, t) for t in texts]
        words = list({w for ws in split for w in ws if not isinstance(w, int)})
        packed = dict(zip(words, self._look_up(words)))
        return [b"".join(self.pack([w]) if isinstance(w, int) else packed[w] for w in ws) for ws in split]

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens: from the automaton, else merged."""
        number = self.lexicon.numbers(words).tolist()
        ends, size = self.ends, self.dtype.itemsize
        rest = [w for w, k in zip(words, number) if k < 0]
        merged = iter(self.vocabulary.merge(rest, self.dtype))
        self.known, self.unseen = self.known + len(words) - len(rest), self.unseen + len(rest)
        return [self.ids[ends[k] * size:ends[k + 1] * size] if k >= 0 else next(merged) for k in number]


def words_of(enc: Encoder, text: str) -> list[bytes | int]:
    """Pre-tokens of a stretch as bytes, and ids of added tokens in it: leftmost first, the longest of those at one place."""
    if _PLAIN.fullmatch(text) and not enc.special(text):
        return [w.encode() for w in _RUN.findall(text)]
    out, at = [], 0
    for m in enc.specials.finditer(text):
        out += _pre_tokens(enc, text[at:m.start()])
        out.append(enc.tokenizer.token_to_id(m.group()))
        at = m.end()
    return out + _pre_tokens(enc, text[at:])


def _pre_tokens(enc: Encoder, text: str) -> list[bytes]:
    of = _symbol_bytes()
    return [bytes(of[c] for c in w) for w, _ in enc.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if text else []


@functools.lru_cache(maxsize=1)
def _symbol_bytes() -> dict[str, int]:
    return {c: b for b, c in byte_symbols().items()}


def word_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """word (binary), n: every pre-token of all texts; each task adds up its own first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stretches = encoder(tokenizer, MEMO), Counter()
        for batch in batches:
            for part in _slices(batch.column(0).cast(pa.binary()).to_pylist()):
                for s, n in enc.stretches(part):
                    stretches[s] += n
                if len(stretches) > TALLY:
                    yield _counted(enc, stretches)
                    stretches = Counter()
        yield _counted(enc, stretches)

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(enc: Encoder, stretches: Counter) -> pa.RecordBatch:
    total: Counter = Counter()
    for s, n in stretches.items():
        if s.isalpha() or _LATIN.fullmatch(s):
            total[s] += n
        else:
            for w in words_of(enc, s.decode()):
                if not isinstance(w, int):
                    total[w] += n
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                                      names=["word", "n"])


def build(docs: DataFrame, tokenizer: str, *, text: str = "text", frequent: int = FREQUENT) -> str:
    """Count all words, compile the most frequent, at most ``frequent``, write the automaton; returns the file's URI.

    Words of equal count are taken all or none, so that no more than these words reach the driver.
    """
    counts = cut(word_counts(docs.select(F.col(text)), tokenizer))
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))  # one row per count that occurs
    upto = sizes.withColumn("upto", F.sum("words").over(W.orderBy(F.desc("n"))))
    least = upto.where(F.col("upto") <= frequent).agg(F.min("n")).first()[0]
    top = [] if least is None else counts.where(F.col("n") >= least).select("word").collect()
    words = [bytes(r["word"]) for r in top]
    data = compile_lexicon(zip(words, (np.frombuffer(x, "<u4").tolist() for x in vocabulary(tokenizer).merge(words))))
    folder = scratch(docs.sparkSession, "lexicon")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/words.fst") as f:
        f.write(data)
    return f"{folder}/words.fst"


@functools.lru_cache(maxsize=2)
def load(uri: str) -> Lexicon:
    """The automaton of a file, mapped where it lies in a file system."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return Lexicon(pa.memory_map(path).read_buffer())
    with fs.open_input_file(path) as f:
        return Lexicon(f.read_buffer())


@functools.lru_cache(maxsize=2)
def lexicon_encoder(tokenizer: str, uri: str) -> LexiconEncoder:
    return LexiconEncoder(tokenizer, load(uri))


def encode(docs: DataFrame, tokenizer: str, lexicon: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (packed little-endian, two bytes each if the vocabulary allows it, else four). Null texts have no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = lexicon_encoder(tokenizer, lexicon)
        for batch in batches:
            packed = enc.encode(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, ids binary")


class Decoder:
    """Ids to text: the bytes of all ids, joined; what isn't UTF-8 becomes the replacement character."""

    def __init__(self, path: str) -> None:
        self.bytes = vocabulary(path).bytes

    def decode(self, ids: Sequence[int]) -> bytes:
        data = b"".join(map(self.bytes.__getitem__, ids))
        if not data.isascii():
            data = data.decode("utf-8", "replace").encode()
        return data


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_DIGESTS_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Digester:
    """Digests of ids in decimal, joined by commas, and of the text they stand for."""

    def __init__(self, path: str) -> None:
        self.decoder = decoder(path)
        self.dtype = "<u2" if len(self.decoder.bytes) <= 1 << 16 else "<u4"
        self.decimal = [str(k).encode() for k in range(len(self.decoder.bytes))]

    def rows(self, packed: Iterable[bytes]) -> tuple[list[int], list[str], list[str]]:
        n, of_ids, of_text = [], [], []
        for p in packed:
            ids = np.frombuffer(p, self.dtype).tolist()
            n.append(len(ids))
            of_ids.append(hashlib.sha256(b",".join(map(self.decimal.__getitem__, ids))).hexdigest())
            of_text.append(hashlib.sha256(self.decoder.decode(ids)).hexdigest())
        return n, of_ids, of_text


@functools.lru_cache(maxsize=2)
def digester(path: str) -> Digester:
    return Digester(path)


def digests(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of (doc_id, ids) as `encode` gives them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = digester(tokenizer).rows(batch.column("ids").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(found, list(_DIGESTS)[1:]))], schema=_DIGESTS)

    return encoded.mapInArrow(run, _DIGESTS_DDL)


def round_trip(docs: DataFrame, tokenizer: str, lexicon: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The digests of `encode` and then of decoding again, in one worker, which holds one tokenizer and one vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dig = lexicon_encoder(tokenizer, lexicon), digester(tokenizer)
        for batch in batches:
            found = [], [], []
            for some in _slices(batch.column(1).cast(pa.binary()).to_pylist()):
                for column, part in zip(found, dig.rows(enc.encode(some))):
                    column += part
            columns = [pa.array(c, f.type) for c, f in zip(found, list(_DIGESTS)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=_DIGESTS)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, _DIGESTS_DDL)


@query("op7_bpe_lexicon")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn the lexicon from all documents, encode them, decode the ids, digest both."""
    docs, path = table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")
    return round_trip(docs, path, build(docs, path))
