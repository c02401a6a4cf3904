"""Work that must follow the length of a text, texts of odd characters, and the language model against a plain one."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortflow.llm import encoding, language, lexicon, token_counts
from cohortflow.llm.common import fold, table
from odd_rows import sf  # noqa: F401

BYTES = encoding.tokenizer_path("byte_bpe_50k.json")


def lexicon_encoder():
    return lexicon.LexiconEncoder(BYTES, lexicon.Lexicon(lexicon.compile_lexicon([])))


def library(texts):
    return [e.ids for e in encoding.encoder(BYTES).tokenizer.encode_batch(list(texts), add_special_tokens=False)]


def test_many_added_tokens_in_a_row():
    texts = ["<|endoftext|>" * 5000, "a<|endoftext|>b" * 100, "<|endoftext|" * 50]
    enc = lexicon_encoder()
    assert [enc.unpack(x).tolist() for x in enc.encode([t.encode() for t in texts])] == library(texts)


@pytest.mark.parametrize("n", [399, 400, 401, 3000])
def test_long_words(n):
    rng = random.Random(n)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(n)), "ab" * n, "x" * n, "".join(rng.choice("éa中😀") for _ in range(n))]
    enc = lexicon_encoder()
    assert [enc.unpack(x).tolist() for x in enc.encode([t.encode() for t in texts])] == library(texts)


def test_a_very_long_word_takes_time_in_proportion():
    rng = random.Random(0)
    voc, took = lexicon.vocabulary(BYTES), {}
    word = bytes(rng.choice(b"abcdefghijklmnop") for _ in range(200_000))
    voc.merge([word[:1000]])
    for n in (20_000, 200_000):
        begin = time.process_time()
        voc.merge([word[:n]])
        took[n] = time.process_time() - begin
    assert took[200_000] < 30 * took[20_000] + 0.5  # ten times the work; the square would be a hundred times


def test_a_line_of_many_hits():
    rng = random.Random(0)
    parts = [rng.choice(["a.b@c.de", "123 456 789 0", "x7", "12345678@d.ef"]) for _ in range(40_000)]
    begin = time.process_time()
    edits = token_counts.cleaning_edits(" ; ".join(parts))
    assert time.process_time() - begin < 5
    assert len(edits) == sum(p != "x7" for p in parts)
    assert token_counts.edited("mail 1234567@a.de, 7654321", token_counts.ordered(token_counts.cleaning_edits("mail 1234567@a.de, 7654321"), 26)) \
        == "mail [removed], [removed]"


def test_numbers_that_are_not_letters():
    model = language.model_of([("en", "the", 50), ("de", "der", 50)])
    texts = ["½", "²", "①", "Ⅷ", "½²①Ⅷ 7 _", "é", "ª"]
    got = language.Predictor(model).predict([t.encode() for t in texts])[0]
    assert [g == "und" for g in got] == [not any(c.isalpha() for c in t) for t in texts]


def test_score_does_not_depend_on_the_batch():
    docs = table_texts()
    model = language.model_of([(lang, w, n) for lang in docs for w, n in Counter(" ".join(docs[lang]).lower().split()).items()
                               if w.isalpha()])
    texts = [t.encode() for ts in docs.values() for t in ts]
    whole = language.Predictor(model).predict(texts)
    single = [language.Predictor(model).predict([t]) for t in texts]
    assert whole == ([s[0][0] for s in single], [s[1][0] for s in single])


def table_texts():
    rng = random.Random(2)
    words = {"en": ["the", "house", "garden", "walking"], "de": ["der", "haus", "garten", "gehend", "straße"]}
    return {lang: [" ".join(rng.choice(ws) + rng.choice(["", "", "xq", "y"]) for _ in range(30)) for _ in range(20)] for lang, ws in words.items()}


def plain_model(rows, words):
    """{lang: {word: n}} of the known words and its tables, as the module's text says, without arrays."""
    import regex

    tally = {}
    for lang, text in rows:
        tally.setdefault(lang, Counter()).update(regex.findall(r"\p{L}+", text.lower()))
    known = {}
    for lang, c in tally.items():
        upto, by_count = 0, sorted(Counter(c.values()).items(), reverse=True)
        least = None
        for n, k in by_count:
            upto += k
            if upto <= words:
                least = n
        known[lang] = {w: n for w, n in c.items() if least is not None and n >= least}
    tables = [{lang: Counter(ws) for lang, ws in known.items()}]
    for order in language.ORDERS:
        t = {lang: Counter() for lang in known}
        for lang, ws in known.items():
            for w, n in ws.items():
                m = f"<{w}>"
                for k in range(len(m) - order + 1):
                    t[lang][m[k:k + order]] += n
        tables.append(t)
    return tables


def plain_scores(tables, text):
    import regex

    langs = sorted(tables[0])
    logs = []
    for k, t in enumerate(tables):
        names = set().union(*t.values())
        size = {x: sum(t[x].values()) for x in langs}
        weight = 1.0 if not k else language.STEP_DOWN ** (language.ORDERS[0] - language.ORDERS[k - 1]) / language.ORDERS[k - 1]
        logs.append((names, lambda g, t=t, size=size, names=names, weight=weight: [
            weight * (math.log(t[x][g] + language.SMOOTH) - math.log(size[x] + language.SMOOTH * len(names))) for x in langs]))
    total = [0.0] * len(langs)
    words = regex.findall(r"\p{L}+", text.lower())

    def add(row):
        mean = sum(row) / len(row)
        for k, v in enumerate(row):
            total[k] += v - mean

    for w in words:
        if w in logs[0][0]:
            add(logs[0][1](w))
            continue
        m = f"<{w}>"
        for k in range(len(m)):
            for level, order in enumerate(language.ORDERS, 1):
                if m[k:k + order] in logs[level][0]:
                    add(logs[level][1](m[k:k + order]))
                    break
    if not words:
        return "und", 0.0
    top = max(total)
    e = [math.exp(v - top) for v in total]
    k = e.index(max(e))
    return langs[k], e[k] / sum(e)


def test_fit_and_score_equal_a_plain_model(spark, sf):  # noqa: F811
    docs = table(spark, sf, "documents")
    learn = docs.where(fold("doc_id", 4) != 2)
    model = language.fit(learn, words=300)
    tables = plain_model([(r["lang"], r["text"]) for r in learn.where("lang IS NOT NULL AND text IS NOT NULL").collect()], 300)
    assert model.words.keys() == set().union(*tables[0].values())
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        lang, score = plain_scores(tables, r["text"])
        assert got[r["doc_id"]][1] == pytest.approx(score, abs=1e-6)
        assert got[r["doc_id"]][0] == lang or score < 0.5 + 1e-6
