"""Filter interaction audit against applying every order of the filters."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortflow.llm import audit
from odd_rows import none, odd, sf  # noqa: F401


def failing(rows):
    """Sets of failed filters; rows are (id, part, text)."""
    least = {}
    for d, _, t in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, _, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({c for c, bad in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", bool(re.search("[#$%&*|]", t))),
            ("E", d is not None and least[t] < d)) if bad})
    return out


def brute(rows, labels, letters="ABCDE", sets=None):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    sets = sets or failing(rows)
    out = {}
    for part in {p or "" for _, p, _ in rows}:
        mine = [(d, s) for (d, p, _), s in zip(rows, sets) if (p or "") == part]
        total = dict.fromkeys(letters, 0)
        for order in itertools.permutations(letters):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [d for d, s in left if c in s]
                left = [(d, s) for d, s in left if c not in s]
                total[c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(c in s for _, s in mine) - len(gone),
                                                   sum(s == {c} for _, s in mine), sum(d in good for d in gone),
                                                   sum(d in toxic for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def got(docs, labels, **options):
    found = audit.audit(docs, labels, **options)
    return {tuple(r) for r in found.select("part", "filter_order", "step", "kept", "removed", "failing_later", "only", "good",
                                           "toxic", "shapley").collect()}


LABELS = "doc_id long, quality int, toxic int"


def test_intervals_cover_each_order_once():
    """Every order removes a mask at exactly the step of its first failing filter."""
    letters = "ABCD"
    orders = list(itertools.permutations(letters))
    spans = list(audit.removal_intervals(letters))
    for mask in range(1, 16):
        fails = {c for k, c in enumerate(letters) if mask >> k & 1}
        want = [next(k for k, c in enumerate(o, 1) if c in fails) for o in orders]
        found = [[s for m, s, lo, hi in spans if m == mask and lo <= rank < hi] for rank in range(24)]
        assert found == [[w] for w in want]
    assert [audit.lehmer_rank("".join(o), letters) for o in orders] == list(range(24))


def test_equals_all_orders(spark):
    """Masks of every kind, copies across parts, a text of a third of all rows, several labels of a document."""
    rng = random.Random(3)
    rows = []
    for d in range(400):
        words = [rng.choice(["a", "b"] if d % 2 else [f"w{k}" for k in range(999)]) for _ in range(rng.choice([3, 199, 200, 260]))]
        text = " ".join(words)
        text = text.upper() if d % 5 == 0 else text
        text += rng.choice(["", "#", " | "])
        rows.append((d, rng.choice(["en", "de", None, ""]), "Hot TEXT" if d % 3 == 0 else text if d % 7 else None))
    rows += [(None, "en", "Hot TEXT"), (None, None, None), (4, "en", rows[4][2]), (4, "de", rows[4][2])]
    labels = [(d, d % 2, d % 3 == 0 or None) for d in range(0, 400, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (999, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    assert got(docs, spark.createDataFrame(labels, LABELS)) == brute(rows, labels)
    assert len({frozenset(s) for s in failing(rows)}) > 15


def test_other_filters(spark):
    rows = [(1, "p", "a"), (2, "p", "b"), (3, "q", "ab"), (4, "q", "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    filters = {"A": F.col("text").contains("a"), "B": F.col("text").contains("b")}
    sets = [{"A"}, {"B"}, {"A", "B"}, {"A", "B", "E"}]
    assert got(docs, spark.createDataFrame([], LABELS), filters=filters) == brute(rows, [], "ABE", sets)
    with pytest.raises(ValueError):
        audit.audit(docs, docs, filters={"B": F.lit(True), "A": F.lit(True)})


def test_odd_rows(spark, odd, none):  # noqa: F811
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in odd.collect()]
    labels = spark.createDataFrame([(7, 1, 0), (2, 0, 1)], LABELS)
    assert got(odd, labels) == brute(rows, [tuple(r) for r in labels.collect()])
    assert got(none, labels) == set()
    assert got(odd, labels.limit(0)) == brute(rows, [])


def test_query(spark, sf):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()
    want = brute([tuple(r) for r in docs], [tuple(r) for r in labels])
    assert {tuple(r) for r in audit.op13(spark, sf).collect()} == want
