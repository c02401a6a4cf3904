"""Stretches found and looked up as arrays: the library's ids for whole texts, and no new call for what is known."""

import itertools
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortflow.llm import encoding
from cohortflow.llm.encoding import LONGEST, RUN, Encoder, tokenizer_path
from test_llm_runs import Watched, rare_words

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
PIECE = st.sampled_from([" ", "  ", "\n", "\t", "\x1c", "\x00", "\x85", "\xa0", " ", " ", " ", "　", " ", " ", ",", ".", "!?", "'", "'s", "’", "“", "…",
                         "–", "a", "B", "the", " The", "é", "É", "×", "÷", "ß", "Ã", "é", "̸", "<", "=", "中", "Σ", "İ", "😀", "7", "½", "<|endoftext|>",
                         "<|ENDOFTEXT|>", "<|startoftext|>", "x" * LONGEST, "y" * (LONGEST + 1), ".\nNext", "\r\n"])


def ids_of(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch(list(texts), add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(PIECE, max_size=12).map("".join), min_size=1, max_size=12))
def test_cuts_change_no_token(path, texts):
    for enc in (encoding.encoder(path), Encoder(path, memo=2)):
        for _ in range(2):
            assert [enc.unpack(x).tolist() for x in enc.encode([t.encode() for t in texts])] == ids_of(path, texts)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_new_words_go_to_the_library_in_runs(path):
    words = rare_words(4 * RUN)
    text = " ".join(f"{w}{mark}" for w, mark in zip(words, itertools.cycle(["", ",", ".\nNext", "!"])))
    enc = Encoder(path)
    enc.tokenizer = Watched(enc.tokenizer)
    assert enc.unpack(enc.encode([text.encode()])[0]).tolist() == ids_of(path, [text])[0]
    assert enc.tokenizer.texts < 50
    seen = enc.tokenizer.texts
    again = " ".join(f"{w};" for w in words[1:])  # known words with another mark behind them
    assert enc.unpack(enc.encode([b"x " + again.encode()])[0]).tolist() == ids_of(path, ["x " + again])[0]
    assert enc.tokenizer.texts <= seen + 2


def test_a_full_memo_keeps_the_first_words():
    first, rare = [" ".join(x) for x in (rare_words(300)[:100], rare_words(2000)[1000:])]
    enc = Encoder(BYTES, memo=150)
    texts = [f"{first} ".encode() * 40, rare.encode(), first.encode()]
    for t in texts:
        assert enc.unpack(enc.encode([t])[0]).tolist() == ids_of(BYTES, [t.decode()])[0]
    at, _ = enc.memo.find(encoding._distinct(*[enc._cut([first.encode()])[k] for k in (0, 3, 4)])[0])
    assert len(enc.memo.hashes) <= 150 and (at >= 0).mean() > 0.9


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(encoding, "_MIX", [encoding.np.uint64(0)] * 3)
    text = "one two three two one, four. two"
    enc = Encoder(BYTES)
    for _ in range(2):
        assert enc.unpack(enc.encode([text.encode()])[0]).tolist() == ids_of(BYTES, [text])[0]


def test_stretches_are_counted():
    enc, total = Encoder(BYTES), Counter()
    for s, n in enc.stretches([b"a b, a b", None, b" a " + b"z" * 40]):
        total[s] += n
    assert total == {b"a": 1, b" b": 2, b",": 1, b" a": 2, b" " + b"z" * 40: 1}
