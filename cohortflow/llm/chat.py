"""Chat formatting by incremental rendering of a black-box template.

A template is a function from a list of (role, text) to one string; nothing else is known of it. Turn prefixes are rendered one
after the other, and what an output adds to the one before it is the new turn's span. Where an output doesn't begin with the
one before it, the template has rewritten history: the common part is measured, and the conversation is flagged.

A template whose output for two lists joined is the two outputs joined may be rendered in blocks of a conversation, each by its own
prefixes; so a conversation of any length is spread over tasks. No trial can show that of a black box, so the caller declares it;
`probe`, which tries a template on small conversations, can only refute it. Any other template gets whole conversations.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

BLOCK = 16  # turns rendered by one run of prefixes, where a template allows blocks
LOSS_ROLE = "assistant"

# Control strings of the template, and what stands for them inside a text. Fixed values.
HEAD, END = "### ", "\n</turn>\n"
_ESCAPED = (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>"))
_BACK = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left in it, and `unescape` gives the text back."""
    for plain, safe in _ESCAPED:
        text = text.replace(plain, safe)
    return text


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def turn_template(turns: Sequence[Turn]) -> str:
    """``### role:``, a line end, the text, and ``</turn>`` on a line of its own."""
    return "".join(f"{HEAD}{escape(role).replace(chr(10), chr(92) + chr(10))}:\n{escape(text)}{END}" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns of a `turn_template` output."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        head = re.match(r"### ((?:[^\\\n]|\\.)*):\n", piece, re.DOTALL)
        turns.append((unescape(head[1]), unescape(piece[head.end():])))
    return turns


@dataclass(frozen=True)
class Rendering:
    """An output, the span of each turn in it, and the first turn whose rendering changed earlier output, or None."""

    text: str
    spans: tuple[tuple[int, int], ...]
    rewritten_at: int | None


def render(template: Template, turns: Sequence[Turn]) -> Rendering:
    """Render successive prefixes; a turn's span is from the end of what its output shares with the one before."""
    before, spans, rewritten = template([]) if turns else "", [], None
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if now.startswith(before):
            begin = len(before)
        else:
            begin = len(os.path.commonprefix((before, now)))
            rewritten = k - 1 if rewritten is None else rewritten
            spans = [(min(a, begin), min(b, begin)) for a, b in spans]
        spans.append((begin, len(now)))
        before = now
    return Rendering(before, tuple(spans), rewritten)


_PROBES: tuple[tuple[Turn, ...], ...] = (
    (("system", "Be brief."), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")),
    (("user", ""), ("assistant", " x\n"), ("user", "</s> [INST] \\"), ("assistant", "")),
    (("assistant", "<think>p</think>q"), ("assistant", "r"), ("user", "s"), ("user", "t"), ("assistant", "<think>u</think>v")),
    (("tool", "1"), ("user", "2"), ("system", "3"), ("assistant", "4"), ("user", "5")),
)


def probe(template: Template) -> str:
    """"blocks": outputs of parts join to the output of the whole. "appends": only prefixes do. "rewrites": they don't.

    This holds for the tried conversations, all short; what a template does elsewhere isn't known.
    """
    if any(render(template, p).rewritten_at is not None for p in _PROBES):
        return "rewrites"
    cuts = ((p, k) for p in _PROBES for k in range(len(p) + 1))
    return "blocks" if all(template(p[:k]) + template(p[k:]) == template(p) for p, k in cuts) else "appends"


def format_conversations(rows: DataFrame, template: Template = turn_template, *, joins: bool = False, conv: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per conversation, or per block of one where the template ``joins``: conv_id, block, part,
    n_turns, formatted, spans (role, begin, end of each turn in ``formatted``), rewritten_at.

    ``joins`` declares that the template's outputs of parts always join to its output of the whole; a template that is seen not to
    do so is an error.

    A conversation's blocks in order of (block, part) make up its output. Turns are in order of ``turn``, a missing one first, ties by
    role and text; repeated rows are turns of their own. Null roles and texts count as empty; rows without a
    conversation id make up one conversation, whose id is null. An empty table gives no row.
    """
    if joins and probe(template) != "blocks":
        raise ValueError("the template's outputs of parts don't join to its output of the whole")
    whole = not joins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = (t for b in batches for t in zip(*[b.column(c).to_pylist() for c in ("conv_id", "block", "role", "text")]))
        for (conv_id, blk), group in itertools.groupby(turns, key=lambda t: t[:2]):
            group = ((r, x) for _, _, r, x in group)
            for part in itertools.count():
                own = list(group if whole else itertools.islice(group, block))
                if not own:
                    break
                done = render(template, own)
                yield pa.RecordBatch.from_pylist([{
                    "conv_id": conv_id, "block": blk, "part": part, "n_turns": len(own), "formatted": done.text,
                    "spans": [{"role": r, "begin": a, "end": b} for (r, _), (a, b) in zip(own, done.spans)],
                    "rewritten_at": done.rewritten_at}], schema=_BLOCK)

    clean = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    number = F.lit(0).cast("long") if whole else F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62)))
    dealt = clean.withColumn("block", number).repartition("conv_id", "block")
    return dealt.sortWithinPartitions("conv_id", "block", "turn", "role", "text").mapInArrow(run, _BLOCK_DDL)


_BLOCK_DDL = ("conv_id long, block long, part int, n_turns long, formatted string, "
              "spans array<struct<role: string, begin: long, end: long>>, rewritten_at long")
_BLOCK = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("spans", pa.list_(pa.struct([("role", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))),
    ("rewritten_at", pa.int64())])


def loss_ranges(formatted: str, spans: Sequence[dict], role: str = LOSS_ROLE) -> list[tuple[int, int]]:
    """The loss mask over a block: where, in the spans of ``role``, the text stands, without head and end."""
    found = []
    for s in spans:
        if s["role"] == role:
            begin = formatted.index(":\n", s["begin"]) + 2
            found.append((begin, s["end"] - len(END)))
    return found


def digests(blocks: DataFrame) -> DataFrame:
    """Per conversation, read back from the output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation's blocks come to one task in order, which holds one of them at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for conv_id, group in itertools.groupby(rows, key=lambda r: r["conv_id"]):
            n = loss_chars = chars = 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for b in group:
                chars += len(b["formatted"])
                for role, text in read_back(b["formatted"]):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for begin, end in loss_ranges(b["formatted"], b["spans"]):
                    text = unescape(b["formatted"][begin:end])
                    loss_chars += len(text)
                    loss.update(text.encode())
            yield pa.RecordBatch.from_pylist([{
                "conv_id": conv_id, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars,
                "loss_sha256": loss.hexdigest(), "formatted_chars": chars}], schema=_DIGEST)

    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return ordered.select("conv_id", "formatted", "spans").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

TRICKY = r"\### Assistant: </turn> ok"

SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')) AS safe FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + safe + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op1_chat_formatting", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts look like the template's own marks."""
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
                                   F.lit(TRICKY).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return digests(format_conversations(rows, joins=True))
