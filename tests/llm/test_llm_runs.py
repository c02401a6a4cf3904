"""Words encoded in runs: the same ids as the library's for whole texts, in fewer calls."""

import itertools

import numpy as np

from cohortflow.llm.encoding import RUN, Encoder, tokenizer_path
from cohortflow.llm.lexicon import _counted, words_of

PATH = tokenizer_path("byte_bpe_50k.json")
LETTERS = "abcdeéöß"


def rare_words(n):
    return ["".join(w) for w in itertools.islice(itertools.product(LETTERS, repeat=6), n)]


class Watched:
    """The tokenizer; notes how many texts it gets."""

    def __init__(self, tokenizer):
        self.inner, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.inner, name)


def test_words_in_runs_have_the_ids_of_the_whole_text():
    text = "first " + " ".join(f"{w}{mark}" for w, mark in zip(rare_words(3 * RUN), itertools.cycle(["", ",", ".\nNext", " 12"])))
    enc = Encoder(PATH)
    enc.tokenizer = Watched(enc.tokenizer)
    got = enc.encode([text.encode(), None, b" ", text.encode()])
    want = enc.tokenizer.inner.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(got[0], enc.dtype).tolist() == want and got[3] == got[0] and got[1] == b""
    assert enc.tokenizer.texts < RUN  # not one for each word


def test_words_are_counted_as_they_are_split():
    enc = Encoder(PATH)
    stretches = {s: k + 1 for k, s in enumerate([b" abc", b"abc", b" a", b" abc,", " é".encode(), b" a1", b" it's", b" <|endoftext|>x"])}
    want = {}
    for s, n in stretches.items():
        for w in words_of(enc, s.decode()):
            if not isinstance(w, int):
                want[w] = want.get(w, 0) + n
    got = _counted(enc, stretches)
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist())) == want
