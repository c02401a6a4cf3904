"""Substring deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import substrings
from cohortflow.llm.substrings import cut_repeats
from odd_rows import none, odd, sf  # noqa: F401


def brute(rows, window):
    """{(id, text): (n_words, n_removed, kept)}; rows of equal ids must have equal texts."""
    docs = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    seen, out = set(), {}
    for d in sorted(docs, key=lambda d: (d is None, d)):
        words = docs[d]
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s:s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        out[d] = (len(words), len(gone), " ".join(x for k, x in enumerate(words) if k not in gone))
    return [(d, *out[d]) for d, _ in rows]


def got(df, **options):
    return sorted([tuple(r) for r in cut_repeats(df, **options).select("doc_id", "n_words", "n_removed", "kept").collect()], key=repr)


def make(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("bits,rows_", [(20, 2), (17, 1), (16, 3)])
@pytest.mark.parametrize("window", [3, 8, 20])
def test_equals_brute_force(spark, window, bits, rows_):
    """Few words make many repeats, near ones and overlapping ones; a full sketch changes nothing."""
    rng = random.Random(window)
    line = " ".join(rng.choice("abcdefgh") * 2 for _ in range(40))
    rows = []
    for d in range(120):
        words = [rng.choice(["a", "b", "c"] if d % 3 else [f"w{k}" for k in range(200)]) for _ in range(rng.randrange(90))]
        if d % 4 == 0:
            words.insert(rng.randrange(len(words) + 1), line)
        if d % 7 == 0:
            words += ["x"] * rng.randrange(60)  # one word over and over
        if d % 11 == 0:
            words += (["p", "q", "r", "s", "t"] * 20)[:rng.randrange(100)]  # a short period
        rows.append((d, "\n ".join(words) if d % 2 else " ".join(words)))
    rows += [(200 + k, rows[k][1]) for k in range(10)]  # whole copies
    assert got(make(spark, rows), window=window, bits=bits, rows=rows_) == sorted(brute(rows, window), key=repr)


def test_periodic_texts_in_one_document(spark):
    rows = [(k, " ".join((["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", "m", "n"][:k + 1]) * 40)[:900]) for k in range(14)]
    rows += [(50, " ".join(["z"] * 21)), (51, " ".join(["y"] * 20)), (52, " ".join(f"{k % 13}" for k in range(60)))]
    assert got(make(spark, rows)) == sorted(brute(rows, 20), key=repr)


def test_hot_copies(spark):
    """A third of all rows is one text."""
    rng = random.Random(5)
    text = " ".join(str(rng.randrange(9)) for _ in range(70))
    rows = [(k, text if k % 3 == 0 else " ".join(str(rng.randrange(4)) for _ in range(rng.randrange(60)))) for k in range(300)]
    assert got(make(spark, rows, 9)) == sorted(brute(rows, 20), key=repr)


def test_odd_rows(spark, odd, none):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == sorted(brute(rows, 20), key=repr)
    assert cut_repeats(none).collect() == []
    nameless = [(None, "a " * 30), (None, "a " * 30), (None, None), (3, "a " * 25)]
    assert got(make(spark, nameless)) == sorted([(None, 30, 30, ""), (None, 30, 30, ""), (None, 0, 0, ""), (3, 25, 24, "a")], key=repr)


def test_sketch_never_counts_too_little(spark):
    """Every window that two documents share, or one document holds in two runs, passes the sketch."""
    rng = random.Random(1)
    lines = [" ".join(rng.choice("abcd") for _ in range(30)) for _ in range(20)]
    texts = [" ".join([*(rng.choice("abcd") for _ in range(rng.randrange(120))), rng.choice(lines)]) for _ in range(80)]
    folder = substrings.sketch(make(spark, list(enumerate(texts))), bits=18, rows=2)
    part = substrings.Part([t.encode() for t in texts], substrings.Words(), 20, 8)
    use = substrings.flagged(part, substrings.load(folder, 18, 2), 18)
    seen = {}
    for k, (a, b, doc) in enumerate(zip(*part.keys, part.doc)):
        seen.setdefault((a, b), []).append((k, doc))
    shared = [k for found in seen.values() if len({d for _, d in found}) > 1 for k, _ in found]
    assert len(shared) > 100 and use[shared].all()


def test_grams_and_least():
    words = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    for n in range(1, 8):
        found = substrings.grams(words, n)
        assert len(found) == 8 - n
        assert (found[0] == found[3]) == (n < 4) if n < 5 else True
        assert substrings.least(words, n).tolist() == [min(words[k:k + n]) for k in range(8 - n)]
    assert len(substrings.grams(words[:2], 5)) == 0
    memo = substrings.Words(limit=2)
    a = memo.hashes([b"x", b"y", b"z", b"x"])
    assert (a[0] == a[3]).all() and (memo.hashes([b"x"])[0] == a[0]).all()


def test_query(spark, sf):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in brute([tuple(x) for x in docs], 20)}
    assert {tuple(r) for r in substrings.op11(spark, sf).collect()} == want
    assert sum(x[2] for x in want) > 1000
    text = cut_repeats(spark.read.parquet(f"{sf}/documents.parquet")).where("n_removed = 0").select(F.sum("n_words")).first()[0]
    assert text > 0
