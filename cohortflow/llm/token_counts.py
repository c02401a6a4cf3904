"""Token counts that follow edits.

A document is cut into leaves at places that no token crosses: before a single space between two characters that aren't white
space. A segment tree over the leaves keeps, per node, the characters and the tokens below it. An edit goes down
the tree to the leaves it touches; where it has changed what stands at a leaf's border, so that the border is no longer such a place,
the neighbouring leaf joins in. Only these leaves are encoded again; sums change on the paths above them.

A tree is stored as two arrays in heap order: node 1 is the root, node k has the children 2k and 2k + 1, leaves are the last
half, filled up with zeros to a power of two.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .encoding import Encoder, encoder, tokenizer_path

MEMO = 400_000  # stretches that a worker remembers; building and editing have workers of their own
LEAF = 512  # characters that a leaf has at least, but for the last one
Edit = tuple[int, int, str]  # place in the text before any edit, characters removed, text put there


def _safe(before: str, after: str) -> bool:
    """No token crosses between the two texts, whatever else is in them."""
    return bool(before) and not before[-1].isspace() and len(after) > 1 and after[0] == " " and not after[1].isspace()


def leaves_of(text: str, kind: str, size: int = LEAF) -> list[str]:
    """The text in leaves; in one, if the tokenizer tells no places to cut at."""
    if kind == "whole" or len(text) <= size:
        return [text] if text else []
    out, begin, at = [], 0, size
    while (at := text.find(" ", at)) >= 0:
        if _safe(text[at - 1], text[at:at + 2]):
            out.append(text[begin:at])
            begin, at = at, at + size
        else:
            at += 1
    out.append(text[begin:])
    return out


def count(enc: Encoder, texts: Sequence[str]) -> list[int]:
    return [len(x) // enc.dtype.itemsize for x in enc.encode([t.encode() for t in texts])]


def tree_over(values: Sequence[int]) -> np.ndarray:
    """Sums in heap order."""
    width = 1 << max(0, len(values) - 1).bit_length()
    heap = np.zeros(2 * width, np.int64)
    heap[width:width + len(values)] = values
    level = width
    while level > 1:
        level //= 2
        heap[level:2 * level] = heap[2 * level:4 * level:2] + heap[2 * level + 1:4 * level:2]
    return heap


def leaf_at(chars: np.ndarray, place: int) -> tuple[int, int]:
    """The leaf that holds a place, by going down from the root, and where that leaf begins."""
    node, begin, width = 1, 0, len(chars) // 2
    while node < width:
        node *= 2
        if place - begin >= chars[node]:
            begin += int(chars[node])
            node += 1
    return node - width, begin


class Tree:
    """Leaves of one document with their sums."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray, n: int) -> None:
        self.chars, self.tokens, self.n = chars, tokens, n

    @property
    def total(self) -> int:
        return int(self.tokens[1]) if len(self.tokens) > 1 else 0

    def put(self, changes: Sequence[tuple[int, int, Sequence[int], Sequence[int]]]) -> None:
        """New values for runs of leaves (first, last, chars, tokens), in order: added on the paths above where every run
        keeps its number of leaves, else one new tree over the values of all leaves."""
        width = len(self.chars) // 2
        if all(len(chars) == last - first + 1 for first, last, chars, _ in changes):
            for first, _, *values in changes:
                for heap, new in zip((self.chars, self.tokens), values):
                    for node, v in enumerate(new, width + first):
                        more = v - int(heap[node])
                        while node and more:
                            heap[node] += more
                            node //= 2
            return
        for which, name in ((2, "chars"), (3, "tokens")):
            old, out, at = getattr(self, name)[width:width + self.n].tolist(), [], 0
            for change in changes:
                out += [*old[at:change[0]], *change[which]]
                at = change[1] + 1
            out += old[at:]
            setattr(self, name, tree_over(out))
        self.n = len(out)


def regions(tree: Tree, text: str, edits: Sequence[Edit]) -> list[tuple[int, int, int, int, str]]:
    """(first leaf, last leaf, begin, end, new text) of what the edits touch, with the leaves their borders need.

    Edits are in order and don't overlap.
    """
    if not tree.n:
        return [(0, -1, 0, 0, "".join(e[2] for e in edits))] if edits else []
    width = len(tree.chars) // 2

    def end_of(leaf: int, begin: int) -> int:
        return begin + int(tree.chars[width + leaf])

    found: list[list] = []  # first, last, begin, end, edits
    for edit in edits:
        at, removed, _ = edit
        first, begin = leaf_at(tree.chars, min(at, len(text) - 1))
        last, last_begin = leaf_at(tree.chars, min(max(at, at + removed - 1), len(text) - 1))
        if found and found[-1][1] >= first:  # edits are in order, so only the last region can overlap
            cur = found[-1]
            if last > cur[1]:
                cur[1], cur[3] = last, end_of(last, last_begin)
            cur[4].append(edit)
        else:
            found.append([first, last, begin, end_of(last, last_begin), [edit]])

    def content(r: list) -> str:
        out, at = [], r[2]
        for place, removed, put in r[4]:
            out += [text[at:place], put]
            at = place + removed
        return "".join([*out, text[at:r[3]]])

    done: list[_Region] = []
    for first, last, begin, end, own in found:
        new = content([first, last, begin, end, own])
        if done:
            cur = done[-1]
            while cur.last < first - 1 and not _safe(cur.tail, text[cur.end:cur.end + 2]):
                cur.last += 1
                cur.put(text[cur.end:end_of(cur.last, cur.end)])
                cur.end = end_of(cur.last, cur.end)
            if cur.last == first - 1:
                if _safe(cur.tail, new[:2]):
                    done.append(_Region(first, last, begin, end, new))
                else:
                    cur.put(new)
                    cur.last, cur.end = last, end
                continue
        lowest = done[-1].last + 1 if done else 0  # a region that ends there ends at a safe place
        parts, head = [new], new[:2]
        while first > lowest and not _safe(text[begin - 1:begin], head):
            first -= 1
            size = int(tree.chars[width + first])
            parts.append(text[begin - size:begin])
            begin -= size
            head = (parts[-1] + head)[:2]
        done.append(_Region(first, last, begin, end, *reversed(parts)))
    for cur in done[-1:]:
        while cur.last < tree.n - 1 and not _safe(cur.tail, text[cur.end:cur.end + 2]):
            cur.last += 1
            cur.put(text[cur.end:end_of(cur.last, cur.end)])
            cur.end = end_of(cur.last, cur.end)
    return [(r.first, r.last, r.begin, r.end, "".join(r.parts)) for r in done]


class _Region:
    """Leaves first..last, the place they take in the old text, and what stands there now, in parts."""

    def __init__(self, first: int, last: int, begin: int, end: int, *parts: str) -> None:
        self.first, self.last, self.begin, self.end, self.parts, self.tail = first, last, begin, end, [], ""
        for p in parts:
            self.put(p)

    def put(self, part: str) -> None:
        self.parts.append(part)
        self.tail = part[-1:] or self.tail


def edited(text: str, edits: Sequence[Edit]) -> str:
    out, at = [], 0
    for place, removed, put in edits:
        out += [text[at:place], put]
        at = place + removed
    return "".join([*out, text[at:]])


def ordered(edits: Sequence[Edit], size: int) -> list[Edit]:
    """Edits by place, kept to the text; one that begins inside an earlier one's removed part begins behind it."""
    out, at = [], 0
    for place, removed, put in sorted(edits, key=lambda e: e[:2]):
        begin = min(max(place, at), size)
        end = min(max(place + max(0, removed), begin), size)
        out.append((begin, end - begin, put or ""))
        at = end
    return out


_TREE = [("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("leaves", pa.int32())]
_TREE_DDL = "chars array<long>, tokens array<long>, leaves int"


def build(docs: DataFrame, tokenizer: str, *, text: str = "text") -> DataFrame:
    """``docs`` with the tree of each text: chars, tokens (heaps), leaves. Columns of these names are replaced.

    Null texts count as empty: a tree without leaves. Texts are never cut short.
    """
    base = docs.drop("chars", "tokens", "leaves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, MEMO)
        for batch in batches:
            split = [leaves_of(t or "", enc.kind) for t in batch.column(text).to_pylist()]
            counts = iter(count(enc, [x for s in split for x in s]))
            chars = [tree_over([len(x) for x in s]).tolist() for s in split]
            tokens = [tree_over([next(counts) for _ in s]).tolist() for s in split]
            new = [pa.array(x, kind) for x, (_, kind) in zip((chars, tokens, list(map(len, split))), _TREE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(c for c, _ in _TREE)])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{ddl}, {_TREE_DDL}")


def with_edits(trees: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Joins a table of edits (key, at, removed, inserted) to its documents as the column ``edits``."""
    lists = edits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "removed", "inserted"))).alias("edits"))
    return trees.drop("edits").join(lists, key, "left")


def apply_edits(trees: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id",
                find: Callable[[str], list[Edit]] | None = None) -> DataFrame:
    """Counts after each document's ``edits`` (array of at, removed, inserted; null: none), or after those that ``find``
    makes of its text.

    key, n_edits, tokens_before, tokens_after, encoded_chars (characters encoded again), new text, chars, tokens, leaves.
    Edits are taken in order of place; see `ordered` for such as overlap or lie outside.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, MEMO)
        for batch in batches:
            work, again = [], []
            for r in zip(*[batch.column(c).to_pylist() for c in batch.schema.names]):
                t = r[1] or ""
                edits = ordered(find(t) if find else [(e["at"], e["removed"], e["inserted"]) for e in r[5] or []], len(t))
                tree = Tree(np.array(r[2], np.int64), np.array(r[3], np.int64), r[4])
                parts = []
                for first, last, _, _, new in regions(tree, t, edits):
                    pieces = leaves_of(new, enc.kind)
                    parts.append((first, last, pieces))
                    again += pieces
                work.append((r[0], t, edits, tree, parts))
            counts = iter(count(enc, again))
            rows = []
            for doc, t, edits, tree, parts in work:
                before, encoded = tree.total, 0
                new = [(f, x, [len(p) for p in ps], [next(counts) for _ in ps]) for f, x, ps in parts]
                tree.put(new)
                encoded += sum(sum(chars) for _, _, chars, _ in new)
                rows.append((doc, len(edits), before, tree.total, encoded, edited(t, edits), tree.chars.tolist(),
                             tree.tokens.tolist(), tree.n))
            columns = list(zip(*rows)) or [[]] * len(_EDITED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITED)], schema=_EDITED)

    return trees.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), "chars", "tokens", "leaves",
                        *([] if find else ["edits"])).mapInArrow(run, _EDITED_DDL).withColumnRenamed("key", key)


_EDITED = pa.schema([("key", pa.int64()), ("n_edits", pa.int32()), ("tokens_before", pa.int64()), ("tokens_after", pa.int64()),
                     ("encoded_chars", pa.int64()), ("text", pa.string()), *_TREE])
_EDITED_DDL = ("key long, n_edits int, tokens_before long, tokens_after long, encoded_chars long, text string, " + _TREE_DDL)

_MAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_NUMBER = re.compile(r"\d(?:[ -]?\d){6,}")


def cleaning_edits(text: str) -> list[Edit]:
    """Edits a cleaning step makes: private data gives way to a mark, later copies of a line within a document go."""
    found, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line and line in seen:
            found.append((at, min(len(line) + 1, len(text) - at), ""))
        else:
            seen.add(line)
            mails = [m.span() for m in _MAIL.finditer(line)] if "@" in line else []
            spans, k = list(mails), 0
            for m in _NUMBER.finditer(line):  # both ascend and don't overlap among themselves
                while k < len(mails) and mails[k][1] <= m.start():
                    k += 1
                if k == len(mails) or mails[k][0] >= m.end():
                    spans.append(m.span())
            found += [(at + a, b - a, "[removed]") for a, b in spans]
        at += len(line) + 1
    return found


@query("op2_edit_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after cleaning, and how much of it was encoded again."""
    path = tokenizer_path("byte_bpe_50k.json")
    trees = build(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    done = apply_edits(trees, path, find=cleaning_edits)
    return done.select("doc_id", "n_edits", "tokens_before", "tokens_after", "encoded_chars")
