"""Exact copies and SimHash groups against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortflow.llm import exact, simhash
from cohortflow.llm.common import ROW, table, without
from odd_rows import none, odd, sf  # noqa: F401


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for ds in groups.values():
        ids = sorted((d is None, d or 0) for d in ds)
        keep = None if ids[0][0] else ids[0][1]
        out += [(d, keep, len(ds)) for d in ds]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.substring(exact.sha256(c), 1, 1), lambda c: F.lit(b"one")])
def test_exact_odd_rows(odd, digest):
    got = exact.duplicates(odd, digest=digest).collect()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=repr) == brute_exact(rows)
    assert sum(r["kept"] for r in got) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows})


def test_exact_empty(none):
    assert exact.duplicates(none).collect() == []


def test_state_takes_later_arrivals(spark, odd):
    from cohortflow.llm.common import located, scratch

    folder = scratch(spark, "later")
    keys = located(odd, "doc_id", "text").select(exact.sha256(exact.normalised("text")).alias("digest"), ROW)
    keys.where(f"{ROW}.doc_id > 6").write.parquet(f"{folder}/arrivals")
    first = exact.absorb(spark, f"{folder}/arrivals", f"{folder}/state", keys.schema)
    assert first.agg(F.sum("n")).first()[0] == keys.where(f"{ROW}.doc_id > 6").count()
    keys.where(f"{ROW}.doc_id <= 6").write.mode("append").parquet(f"{folder}/arrivals")
    then = exact.absorb(spark, f"{folder}/arrivals", f"{folder}/state", keys.schema)
    threes = then.where("n = 3").select("keeper.doc_id").collect()
    assert sorted(r["doc_id"] for r in threes) == [1, 2]  # the cat's, and the empty ones


def test_exact_plan_is_native(spark, sf):
    plan = exact.op6(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_print(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(codes, bits=2):
    codes = np.array(codes, "u8")
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes[i + 1:]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def crowd(seed, n, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 12, dtype="u8")
    codes = base[rng.integers(0, 12, n)]
    for _ in range(flips):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n, dtype="u8"))
    return np.unique(codes)


@pytest.mark.parametrize("flips", [1, 2, 3])
def test_tree_finds_every_pair(flips):
    codes = crowd(flips, 1500, flips)
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    got = [(int(a), int(b)) for i, j in simhash.tree_pairs(codes, 2) for a, b in zip(i, j)]
    a, b = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None]) <= 2, 1))
    assert sorted(got) == sorted(zip(a.tolist(), b.tolist()))


def test_gray_rank(spark):
    n = spark.range(300).select(F.col("id"), simhash.gray_rank(F.col("id").bitwiseXOR(F.shiftrightunsigned("id", 1))).alias("r"))
    assert all(r["id"] == r["r"] for r in n.collect())


@pytest.mark.parametrize("crowded", [20_000, 5])
def test_links_and_components(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    codes = crowd(9, 700, 2)
    frame = spark.createDataFrame([(int(c),) for c in codes.view("i8")], "fingerprint long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    roots = brute_roots(codes)
    sizes = np.bincount(roots, minlength=len(codes))
    assert set(got) == {int(c) for c, r in zip(codes.view("i8"), roots) if sizes[r] > 1}
    want, have = {}, {}
    for c, r in zip(codes.view("i8").tolist(), roots):
        if sizes[r] > 1:
            want.setdefault(r, set()).add(c)
            have.setdefault(got[c], set()).add(c)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_chain_of_links(spark):
    """A long chain needs many rounds."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_simhash_odd_rows(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(odd).collect()
    prints = [brute_print(t) for _, t in rows]
    assert sorted(r["fingerprint"] % (1 << 64) for r in got) == sorted(prints)
    roots = brute_roots(prints)
    label = {r: min((d for (d, _), x in zip(rows, roots) if x == r and d is not None), default=None) for r in roots}
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == sorted(
        ((d, label[r]) for (d, _), r in zip(rows, roots)), key=repr)
    assert sum(r["kept"] for r in got) == len(set(roots))
    assert simhash.near_duplicates(none).collect() == []


def test_simhash_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op9(spark, sf).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect())
    prints = [brute_print(t) if k < 150 else int(got[d][0], 16) for k, (d, t) in enumerate(rows)]
    roots = brute_roots(prints)
    assert got == {d: (f"{p:016x}", rows[r][0]) for (d, _), p, r in zip(rows, prints, roots)}


def test_without_keeps_all_columns(spark, odd):
    from cohortflow.llm.common import cut

    docs = cut(odd)
    left = without(docs, exact.duplicates(docs).where("NOT kept"))
    assert left.columns == docs.columns
    assert left.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in docs.collect()})
