"""Whole texts to token ids with the tokenizers library, one library call per distinct stretch of text.

A tokenizer never merges across some places, so a text can be cut there and each distinct stretch encoded once:

* byte-level BPE with its standard split: before a single space that stands between two characters that aren't white
  space (the space opens the next word), and around a line end between two letters or marks;
* BPE whose split drops white space: at any ASCII white space;
* both: between a letter of Latin-1 and an ASCII mark that follows it, but for the apostrophe.

The stretches of many texts are found, told apart and looked up as arrays; only what is new becomes Python objects. Other tokenizers get whole texts. Ids come packed, two bytes each where the vocabulary allows it, else four, in
the machine's order (little-endian on all that Spark supports here).
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np

MEMO = 800_000  # stretches remembered by one Python worker: about 60 bytes each
LONGEST = 23  # bytes of a stretch that is looked up as an array of three numbers; longer ones are remembered in a dictionary

RUN = 1_000  # words that are encoded as one text

# Letters of Latin-1, ASCII digits and ASCII marks without the apostrophe: runs of each are encoded apart from each other
# and from a line end between them, whatever stands around.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf" ?[{_LETTERS}{_MARKS}0-9]+(?:\n[{_LETTERS}{_MARKS}0-9]+)*")
_RUN = re.compile(rf" ?(?:[{_LETTERS}]+|[{_MARKS}]+|[0-9]+)|\n")


_LATIN = re.compile(rb" ?(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++")  # a word of these letters, as UTF-8

_ASCII = np.arange(256)
_IS_LETTER = np.isin(_ASCII, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_IS_MARK = np.array([bool(re.fullmatch(f"[{_MARKS}]", chr(c))) and c < 128 for c in range(256)])
_IS_TAIL = (_ASCII >= 0x80) & (_ASCII < 0xC0) & (_ASCII != 0x97) & (_ASCII != 0xB7)  # behind 0xC3: a letter of Latin-1
_IS_BLANK = np.isin(_ASCII, list(b" \t\n\r\v\f"))
_IS_SPACE = _IS_BLANK | np.isin(_ASCII, [0x1C, 0x1D, 0x1E, 0x1F])
_LOWER = np.arange(256, dtype=np.uint8) + 32 * ((_ASCII >= 65) & (_ASCII <= 90)).astype(np.uint8)
# white space beyond ASCII, as numbers of three bytes; those of two bytes with a zero before them
_WIDE = np.array(sorted(int.from_bytes(c.encode()) for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
                        + "".join(map(chr, range(0x2000, 0x200B)))))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Encoder:
    """Encodes texts given as UTF-8; remembers what it has encoded, within a bound."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        self.tokenizer, self.kind, self.added, self.borders = _loaded(path)
        self.marked = [t.lower().encode() if self.kind == "words" else t.encode() for t in self.added]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.limit = memo
        longest_first = sorted(self.added, key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, longest_first)) or "(?!)")
        self.special = self.specials.search
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.memo = Memo(memo, self.dtype)
        self.long: dict[bytes, bytes] = {}

    def pack(self, ids: Sequence[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def unpack(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.dtype)

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Packed ids of each text; texts that are null count as empty."""
        if self.kind == "whole":
            return self._library([(t or b"").decode() for t in texts])
        return [x for part in _slices(texts) for x in self._part(part)]

    def _part(self, texts: Sequence[bytes]) -> list[bytes]:
        data, begin, end, start, size = self._cut(texts)
        key, same, short = _distinct(data, start, size)
        memo = self.memo
        at, count = memo.find(key)
        new = np.flatnonzero(at < 0)
        fresh = [data[a:a + n] for a, n in zip(start[key.row[new]].tolist(), size[key.row[new]].tolist())]
        at[new], count[new] = memo.put(key, new, self._learn(fresh))
        where, many = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        where[short], many[short] = at[same], count[same]
        if not short.all():
            rest = np.flatnonzero(~short)
            stretches = [data[a:a + n] for a, n in zip(start[rest].tolist(), size[rest].tolist())]
            where[rest], many[rest] = memo.borrow(self._long(stretches))
        upto = np.cumsum(many)
        ids = memo.ids[np.repeat(where - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)]
        upto = np.concatenate([[0], upto])
        first, last = upto[np.searchsorted(start, begin)].tolist(), upto[np.searchsorted(start, end)].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(first, last)]
        if memo.full and 4 * len(new) > len(start):  # what it remembers rarely helps here
            memo.clear()
        return [self._apart(t) if self._holds_added(t) else x for t, x in zip(texts, out)]

    def _cut(self, texts: Sequence[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts in one, where each begins and ends there, and where their stretches begin and how long they are."""
        texts = [t or b"" for t in texts]
        data = b"\n".join([*texts, bytes(32)])
        buf = np.frombuffer(data, np.uint8)
        if self.kind == "words":
            buf = _LOWER[buf]
            data = buf.tobytes()
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(length + 1) - 1
        begin, n = end - length, len(buf) - 32
        letter, mark = _IS_LETTER[buf], _IS_MARK[buf]
        accent = np.flatnonzero(buf[:-1] == 0xC3)
        accent = accent[_IS_TAIL[buf[accent + 1]]]
        opens, closes = letter.copy(), letter  # a letter begins, ends here
        opens[accent], closes[accent + 1] = True, True
        cut = np.zeros(len(buf), bool)
        cut[1:] = closes[:-1] & mark[1:]
        if self.kind == "words":
            blank = _IS_BLANK[buf]
            cut |= blank
            cut[1:] |= blank[:-1]
        else:
            opens |= mark
            closes |= mark
            line = np.flatnonzero(buf[1:-1] == 10) + 1
            line = line[closes[line - 1] & opens[line + 1]]
            cut[line], cut[line + 1] = True, True
            blank = np.flatnonzero(buf[1:-1] == 32) + 1
            cut[blank[~_white_before(buf, blank) & ~_white_from(buf, blank + 1)]] = True
            blank = np.zeros(len(buf), bool)
        cut[begin], cut[end] = True, True
        blank[end] = True  # what stands between texts
        start = np.flatnonzero(cut[:n])
        size = np.diff(start, append=n)
        keep = ~blank[start]
        return data, begin, end, start[keep], size[keep]

    def stretches(self, texts: Sequence[bytes]) -> Iterator[tuple[bytes, int]]:
        """Each distinct stretch of the texts with how often it stands there, but for some that are long and come apart."""
        for part in _slices(texts):
            data, _, _, start, size = self._cut(part)
            key, same, short = _distinct(data, start, size)
            row = np.concatenate([key.row, np.flatnonzero(~short)])
            count = np.concatenate([np.bincount(same, minlength=len(key.row)), np.ones(len(row) - len(key.row), np.int64)])
            for a, n, k in zip(start[row].tolist(), size[row].tolist(), count.tolist()):
                yield data[a:a + n], k

    def _holds_added(self, text: bytes | None) -> bool:
        """Whether a text holds an added token, or might once it is in lower case."""
        if not text or not self.added:
            return False
        if self.kind == "words":
            text = text.lower()
        return any(t in text for t in self.marked)

    def _apart(self, text: bytes) -> bytes:
        """A text that holds added tokens: the library cuts it at them first."""
        return self._library([text.decode()])[0]

    def _long(self, stretches: list[bytes]) -> list[bytes]:
        new = [s for s in set(stretches) if s not in self.long]
        found = dict(zip(new, self._learn(new)))
        out = [found[s] if s in found else self.long[s] for s in stretches]
        room = max(0, self.memo.limit // 16 - len(self.long))
        self.long.update(x for x in itertools.islice(found.items(), room) if len(x[0]) <= 200)
        return out

    def _learn(self, fresh: list[bytes]) -> list[bytes]:
        """What new stretches are encoded as: words apart, others by the library."""
        words = [s for s in fresh if s.isalpha() or _LATIN.fullmatch(s)]
        found = dict(zip(words, self._words(words)))
        others = [s for s in fresh if s not in found]
        found.update(zip(others, self._library([s.decode() for s in others])))
        return [found[s] for s in fresh]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words that are pre-tokens as they stand, encoded in runs. Where they open with a space, no other token
        of a run does, and where a token tells the end of a word, no other one ends it, so words can be told apart again."""
        if self.borders is None:
            return self._library([w.decode() for w in words])
        runs = words if self.kind == "words" else [w for w in words if w[0] == 32]
        of = dict(zip(runs, itertools.chain.from_iterable(map(self._run, itertools.batched(runs, RUN)))))
        others = [w for w in words if w not in of]
        of.update(zip(others, self._library([w.decode() for w in others])))
        return [of[w] for w in words]

    def _run(self, words: Sequence[bytes]) -> list[bytes]:
        text = (b" " if self.kind == "words" else b"").join(words).decode()
        ids = array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        at = np.flatnonzero(self.borders[np.frombuffer(ids, self.dtype)])
        if len(at) != len(words):  # bytes that the vocabulary lacks
            return self._library([w.decode() for w in words])
        flat, size = ids.tobytes(), self.dtype.itemsize
        ends = [*(at[1:] * size).tolist(), len(flat)] if self.kind == "spaces" else ((at + 1) * size).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _library(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = array(self.code, itertools.chain.from_iterable(ids)).tobytes()
        ends = list(itertools.accumulate(len(x) * self.dtype.itemsize for x in ids))
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


@functools.lru_cache(maxsize=4)
def _loaded(path: str) -> tuple:
    """(tokenizer, kind, added tokens, borders) of a file; all encoders of a worker share them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = _kind(spec)
    added = [t["content"] for t in spec.get("added_tokens") or []]
    return tokenizer, kind, added, _borders(tokenizer.get_vocab(), kind, spec["model"].get("end_of_word_suffix"))


def _borders(vocab: dict[str, int], kind: str, suffix: str | None) -> np.ndarray | None:
    """Which ids of a vocabulary stand for bytes that open with a space, or for the end of a word; None if it doesn't tell."""
    if kind == "whole" or kind == "words" and not suffix:
        return None
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if (t.startswith("Ġ") if kind == "spaces" else t.endswith(suffix))]] = True
    return out


def _kind(spec: dict) -> str:
    """spaces, words or whole: where the tokenizer of this file lets a text be cut."""
    pre = spec.get("pre_tokenizer") or {}
    tokens = [t for t in spec.get("added_tokens") or [] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")
              or re.search(r"\s", t["content"])]
    if tokens or spec["model"].get("type") != "BPE":
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") \
            and not spec.get("normalizer"):
        return "spaces"
    steps = pre.get("pretokenizers") or []
    norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0].get("behavior") == "Removed" \
            and steps[0].get("invert") and norm == ["NFC", "Replace", "Lowercase"] and not steps[1].get("use_regex"):
        return "words"
    return "whole"


def _slices(texts: Sequence[bytes], size: int = 1 << 21) -> Iterator[list[bytes]]:
    """Runs of texts of about ``size`` bytes, so that the stretches of few texts are in memory at once."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t) if t else 0
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def _white_before(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space ends right before each place, or the data begins there."""
    out = _IS_SPACE[buf[at - 1]] | (at == 0)
    wide = np.flatnonzero((buf[at - 1] >= 0x80) & (at > 2))
    out[wide] = _is_wide(buf, at[wide] - 3, at[wide] - 2)
    return out | ((buf[at - 1] >= 0x80) & (at <= 2))


def _white_from(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space begins at each place."""
    out = _IS_SPACE[buf[at]]
    wide = np.flatnonzero(buf[at] >= 0x80)
    out[wide] = _is_wide(buf, at[wide], at[wide])
    return out


def _is_wide(buf: np.ndarray, three: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the three bytes from one place or the two from another are white space beyond ASCII."""
    x = buf[three].astype(np.int64) << 16 | buf[three + 1].astype(np.int64) << 8 | buf[three + 2]
    y = buf[two].astype(np.int64) << 8 | buf[two + 1]
    return np.isin(x, _WIDE) | np.isin(y, _WIDE)


class _Keys:
    """Distinct short stretches, by ascending hash: the hash, the three numbers that hold bytes and length, the row of one."""

    def __init__(self, hashes: np.ndarray, words: list[np.ndarray], row: np.ndarray) -> None:
        self.hashes, self.words, self.row = hashes, words, row


def _distinct(data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[_Keys, np.ndarray, np.ndarray]:
    """The distinct short stretches, which of them each short one is, and which are short.

    Stretches are told apart by all their bytes: one whose hash is another's counts as long.
    """
    short = size <= LONGEST
    rows = np.flatnonzero(short)
    at, n = start[rows], size[rows]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    words = [eight[at + 8 * k] & _MASK[np.clip(n - 8 * k, 0, 8)] for k in range(3)]
    words[2] |= n.astype("<u8") << np.uint64(56)
    h = np.zeros(len(rows), "<u8")
    for w, by in zip(words, _MIX):
        h = (h ^ w) * by
        h ^= h >> np.uint64(31)
    order = np.argsort(h)
    ordered = h[order]
    first = np.ones(len(h), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    same = np.empty(len(h), np.int64)
    same[order] = np.cumsum(first) - 1
    one = order[first]
    off = np.zeros(len(h), bool)
    for w in words:
        off |= w != w[one][same]
    if off.any():
        short[rows[off]] = False
        same = same[~off]
    return _Keys(ordered[first], [w[one] for w in words], rows[one]), same, short


class Memo:
    """Packed ids of short stretches, in arrays: hashes in order, and what belongs to them in order of arrival. The first ones
    seen stay: they are the frequent ones."""

    def __init__(self, limit: int, dtype: np.dtype) -> None:
        self.limit, self.dtype = limit, dtype
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.empty(0, "<u8"), np.empty(0, np.int32)
        self.words = [np.empty(self.limit, "<u8") for _ in range(3)]
        self.at, self.count = np.empty(self.limit, np.int64), np.empty(self.limit, np.int32)
        self.ids, self.used, self.lent, self.full = np.empty(1 << 16, self.dtype), 0, 0, False

    def find(self, key: _Keys) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each key begin and how many there are; -1 for a key that isn't known."""
        at, count = np.full(len(key.hashes), -1, np.int64), np.zeros(len(key.hashes), np.int64)
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, key.hashes), len(self.hashes) - 1)
            slot = self.slots[place]
            ok = self.hashes[place] == key.hashes
            for mine, theirs in zip(self.words, key.words):
                ok &= mine[slot] == theirs
            at[ok], count[ok] = self.at[slot[ok]], self.count[slot[ok]]
        return at, count

    def put(self, key: _Keys, new: np.ndarray, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for new keys, which are remembered as far as there is room."""
        self.lent = self.used
        at, count = self.borrow(packed)
        known = len(self.hashes)
        self.full = known >= self.limit
        n = min(len(new), self.limit - known)
        if n:
            new, rows = new[:n], slice(known, known + n)
            for mine, theirs in zip(self.words, key.words):
                mine[rows] = theirs[new]
            self.at[rows], self.count[rows] = at[:n], count[:n]
            place = np.searchsorted(self.hashes, key.hashes[new])
            self.hashes = np.insert(self.hashes, place, key.hashes[new])
            self.slots = np.insert(self.slots, place, np.arange(known, known + n, dtype=np.int32))
        self.used = int(at[n - 1] + count[n - 1]) if n else self.used
        self.lent = int(at[-1] + count[-1]) if len(at) else self.used
        return at, count

    def borrow(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lay ids down behind those that are remembered, until the next call of `put`."""
        flat = np.frombuffer(b"".join(packed), self.dtype)
        count = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize
        begin = self.lent
        if begin + len(flat) > len(self.ids):
            more = np.empty(begin + len(flat) + len(self.ids) // 4, self.dtype)
            more[:begin] = self.ids[:begin]
            self.ids = more
        self.ids[begin:begin + len(flat)] = flat
        return begin + np.cumsum(count) - count, count


@functools.lru_cache(maxsize=4)
def encoder(path: str, memo: int = MEMO) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path, memo)


def tokenizer_path(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
