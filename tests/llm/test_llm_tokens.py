"""Encoders, token counts, lexicon, records and packing against the tokenizers library."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortflow.llm import encoding, lexicon, packing, records, token_counts
from cohortflow.llm.common import scratch
from odd_rows import none, odd, sf  # noqa: F401

BYTES, WORDS = encoding.tokenizer_path("byte_bpe_50k.json"), encoding.tokenizer_path("word_bpe_49k.json")
TEXT = st.lists(st.sampled_from([" ", "  ", "\n", " \n", "\t", "a", "Foo", " the", "été", "ß", "don't", "'s", "12", "½", "\xa0", "\x1c", "\x85",
                                 "<|endoftext|>", "é", "́", "!", "...", "中文", "ΑΣ", "İ", "😀", "\x00", "b\n"]), max_size=14).map("".join)


def library(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch(list(texts), add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=30, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=40))
def test_encoder(path, texts):
    for enc in (encoding.encoder(path), encoding.Encoder(path, memo=3)):
        assert [list(enc.unpack(x)) for x in enc.encode([t.encode() for t in texts])] == library(path, texts)


@settings(max_examples=30, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_lexicon_encoder_and_decoder(texts):
    words = [b" the", b"a", b"Foo"]
    ids = [np.frombuffer(x, "<u4").tolist() for x in lexicon.Vocabulary(BYTES).merge(words)]
    lex = lexicon.Lexicon(lexicon.compile_lexicon(zip(words, ids)))
    enc, dec = lexicon.LexiconEncoder(BYTES, lex), lexicon.Decoder(BYTES)
    ids = [enc.unpack(x).tolist() for x in enc.encode([t.encode() for t in texts])]
    assert ids == library(BYTES, texts)
    assert [dec.decode(x).decode() for x in ids] == [enc.tokenizer.decode(x, skip_special_tokens=False) for x in ids]
    assert [dec.decode(x[1:2]).decode() for x in ids] == [enc.tokenizer.decode(x[1:2], skip_special_tokens=False) for x in ids]


@given(st.sets(st.text("abc", min_size=1, max_size=6).map(str.encode), max_size=60))
def test_automaton(words):
    entries = [(w, [len(w), *w]) for w in words]
    lex = lexicon.Lexicon(lexicon.compile_lexicon(entries))
    number = lex.numbers(sorted(words))
    assert number.tolist() == list(range(len(words)))
    assert [lex.ids[lex.ends[k]:lex.ends[k + 1]].tolist() for k in number] == [[len(w), *w] for w in sorted(words)]
    assert set(lex.numbers([b"d", b"", b"abcabca"]).tolist()) == {-1}
    ends = {w[k:] for w in words for k in range(len(w) + 1)}
    below = {frozenset(x[len(w[:k]):] for x in words if x.startswith(w[:k])) for w in words for k in range(len(w) + 1)}
    assert lex.states == max(1, len(below)) and len(ends) >= 0  # as many states as there are different right languages


def test_lexicon_query(spark, sf):
    got = {r["doc_id"]: tuple(r)[1:] for r in lexicon.op7(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = library(BYTES, texts.values())
    assert got == {d: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
                   for (d, t), x in zip(texts.items(), ids)}


def test_lexicon_odd_rows(spark, odd, none):
    uri = lexicon.build(odd, BYTES, frequent=20)
    rows = lexicon.digests(lexicon.encode(odd, BYTES, uri), BYTES).collect()
    texts = [r["text"] or "" for r in odd.select("text").collect()]
    assert Counter(r["n_tokens"] for r in rows) == Counter(map(len, library(BYTES, texts)))
    uri = lexicon.build(none, BYTES)
    assert lexicon.digests(lexicon.encode(none, BYTES, uri), BYTES).collect() == []


EDITS = st.lists(st.tuples(st.integers(-1, 60), st.integers(0, 9), TEXT), max_size=4)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT, EDITS)
def test_edits_match_a_full_count(a, b, edits):
    enc, text = encoding.encoder(BYTES), a + " the" + b
    leaves = token_counts.leaves_of(text, enc.kind, 6)
    tree = token_counts.Tree(*[token_counts.tree_over(x) for x in (list(map(len, leaves)), token_counts.count(enc, leaves))], len(leaves))
    edits = token_counts.ordered(edits, len(text))
    changes = []
    for first, last, _, _, new in token_counts.regions(tree, text, edits):
        parts = token_counts.leaves_of(new, enc.kind, 6)
        changes.append((first, last, list(map(len, parts)), token_counts.count(enc, parts)))
    tree.put(changes)
    after = token_counts.edited(text, edits)
    assert tree.total == len(library(BYTES, [after])[0])
    width = len(tree.tokens) // 2
    assert all(h[k] == h[2 * k] + h[2 * k + 1] for h in (tree.chars, tree.tokens) for k in range(1, width))


def test_token_counts(spark, odd, none):
    trees = token_counts.build(odd, BYTES)
    got = token_counts.apply_edits(trees, BYTES, find=token_counts.cleaning_edits).collect()
    texts = [r["text"] or "" for r in odd.select("text").collect()]
    assert Counter(r["tokens_before"] for r in got) == Counter(map(len, library(BYTES, texts)))
    assert [r["tokens_after"] for r in got] == list(map(len, library(BYTES, [r["text"] for r in got])))
    assert token_counts.apply_edits(token_counts.build(none, BYTES), BYTES, find=token_counts.cleaning_edits).collect() == []
    edits = spark.createDataFrame([(1, 4, 3, "dog"), (1, 0, 0, "So, "), (99, 0, 0, "x")], "doc_id long, at long, removed long, inserted string")
    one = token_counts.apply_edits(token_counts.with_edits(trees.where("doc_id = 1"), edits), BYTES).first()
    assert one["text"].startswith("So, The dog sat") and one["n_edits"] == 2
    assert one["tokens_after"] == len(library(BYTES, [one["text"]])[0])


def test_token_count_query(spark, sf):
    enc = encoding.encoder(BYTES)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in token_counts.op2(spark, sf).collect():
        t = texts[r["doc_id"]]
        after = token_counts.edited(t, token_counts.ordered(token_counts.cleaning_edits(t), len(t)))
        assert [r["tokens_before"], r["tokens_after"]] == token_counts.count(enc, [t, after])


def test_records(spark, odd, none, tmp_path):
    folder = scratch(spark, "records")
    manifest = records.write_records(odd, folder, BYTES, 0, docs_per_shard=3)
    assert manifest.count() > 1
    got = sorted(records.read_records(manifest, folder).collect(), key=lambda r: r["start"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [[*x, 0] for x in library(BYTES, [t for _, t in rows])]
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    assert [r["start"] for r in got] == np.cumsum([0, *map(len, ids)]).tolist()[:-1]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    index = records.read_index(manifest, folder)
    assert index.count() == len(rows)
    read = records.read_at(records.shuffled(index, 5), folder).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in read) == Counter((d, tuple(x)) for (d, _), x in zip(rows, ids))
    empty = scratch(spark, "records")
    manifest = records.write_records(none, empty, BYTES, 0)
    assert records.read_records(manifest, empty).collect() == []


def test_broken_record_is_noticed(spark, odd):
    folder = scratch(spark, "records")
    manifest = records.write_records(odd.where("doc_id = 1"), folder, BYTES, 0)
    fs, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{records.name(manifest.first()['shard'])}.rec"
    data = bytearray(open(path, "rb").read())
    data[30] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="payload checksum"):
        records.read_records(manifest, folder).collect()


def test_record_query(spark, sf):
    texts = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    ids = [[*x, 0] for x in library(BYTES, [t for _, t in texts])]
    got = sorted(map(tuple, records.op8(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == [(d, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
                   for (d, _), s, x in zip(texts, np.cumsum([0, *map(len, ids)]).tolist(), ids)]


@given(st.lists(st.integers(1, 50), max_size=200))
def test_best_fit(lengths):
    bins = packing.best_fit(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    fills = [sum(lengths[i] for i in b) for b in bins]
    assert all(f <= 50 for f in fills)
    if lengths:
        assert len(bins) <= max(-(-sum(lengths) // 50) * 11 / 9 + 1, 1) + 1  # best fit, longest first


def check_packing(rows, texts, capacity):
    """Every piece once, gapless sequences, cut only where longer than a sequence."""
    want = Counter()
    for d, x in zip(texts, library(WORDS, [t or "" for _, t in texts])):
        x = [*x, 1]
        for piece, s in enumerate(range(0, len(x), capacity)):
            own = x[s:s + capacity]
            want[d[0], piece, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= capacity
    return at


def test_packing(spark, odd, none, sf):
    rows = odd.select("doc_id", "text").collect()
    check_packing(packing.pack(odd, WORDS, 1, capacity=64).collect(), [tuple(r) for r in rows], 64)
    assert packing.pack(none, WORDS, 1).collect() == []
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(40)
    rows = docs.select("doc_id", "text").collect()
    at = check_packing(packing.pack(docs, WORDS, 1).collect(), [tuple(r) for r in rows], 4096)
    assert len(at) <= -(-sum(at.values()) // 4096) + 2
    at = check_packing(packing.op10(spark, sf).collect(), [tuple(r) for r in rows], 4096)
    assert len(at) <= -(-sum(at.values()) // 4096) + 2
