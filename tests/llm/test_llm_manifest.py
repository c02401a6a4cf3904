"""Merkle manifest against a tree built level by level."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cohortflow.llm import manifest
from cohortflow.llm.manifest import Appender, check, record, refold, siblings
from odd_rows import none, odd, sf  # noqa: F401


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes, arity):
    """(root, proofs): per node the siblings' digests as one hex text."""
    proofs, at = [""] * len(nodes), list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            run = range(a - a % arity, min(len(nodes), a - a % arity + arity))
            proofs[k] += "".join(nodes[j] for j in run if j != a)
        nodes = [h("".join(nodes[k:k + arity])) for k in range(0, len(nodes), arity)]
        at = [a // arity for a in at]
    return nodes[0], proofs


def brute(rows, arity=3):
    """{leaf of (group, id, leaf) -> (subroot, root, proof digest)}; rows are (group, id, leaf)."""
    groups = {}
    for g, d, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(g, []).append((d, leaf))
    subs = {g: tree([leaf for _, leaf in ls], arity) for g, ls in groups.items()}
    root, tops = tree([s for s, _ in subs.values()], arity)
    out = []
    for (g, ls), top in zip(groups.items(), tops):
        out += [(g, d, leaf, subs[g][0], root, h(p + top)) for (d, leaf), p in zip(ls, subs[g][1])]
    return out


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_appender(arity):
    for n in range(1, 70):
        leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
        grown = Appender(arity)
        for d in leaves:
            grown.append(d)
        top = grown.finish()
        root, proofs = tree([d.hex() for d in leaves], arity)
        assert top.hex() == root
        assert [siblings(w).hex() for w in grown.witness] == proofs
        assert all(refold(d, w) == top for d, w in zip(leaves, grown.witness))
        assert n == 1 or refold(bytes(32), grown.witness[n // 2]) != top


def test_partial_witnesses_grow_with_their_subtree():
    """A leaf's witness is as long as the complete subtree around it, before the tree is finished."""
    grown = Appender(3)
    for k in range(9):
        grown.append(bytes([k]) * 32)
        assert [len(siblings(w)) // 64 for w in grown.witness] == [
            2 if k == 8 else 1 if i < (k + 1) // 3 * 3 else 0 for i in range(k + 1)]


@pytest.mark.parametrize("height", [1, 2, 7])
@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, "b": 2, None: 3}, {"a": 82, "b": 9, "c": 27, "d": 28, None: 1},
                                   {f"s{k}": k % 3 + 1 for k in range(31)}])
def test_blocks_and_rounds(spark, height, sizes):
    """Groups of a third and more of all rows over blocks of 3, 9 and 2,187 leaves."""
    rows = [(g, k * 7 % (n + 3) if k else None, f"text {g} {k}") for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(3)
    out = check(manifest.manifest(df, record(F.col("text")), carry={"source": F.col("source")}, height=height))
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "proof", "folded")]
    got = [tuple(r) for r in out.select("source", "doc_id", *hexed).collect()]
    want = [(*w, w[4]) for w in brute([(g, d, h(f"{len(t)}:{t}")) for g, d, t in rows])]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_record(spark):
    df = spark.createDataFrame([(-5, "é", None), (None, "", "a:b")], "a long, b string, c string")
    got = [r[0] for r in df.select(F.lower(F.hex(record(F.col("a"), F.col("b"), F.col("c"))))).collect()]
    assert got == [h("2:-52:é-"), h("-0:3:a:b")]


def test_odd_rows(spark, odd, none):  # noqa: F811
    out = manifest.manifest(odd, record(F.col("doc_id"), F.col("text")), group="lang")
    rows = odd.select("lang", "doc_id", F.lower(F.hex(record(F.col("doc_id"), F.col("text"))))).collect()
    got = check(out).select("doc_id", *[F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "proof")]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((w[1:] for w in brute([tuple(r) for r in rows])), key=repr)
    assert manifest.manifest(none, record(F.col("text"))).collect() == []


def test_query(spark, sf):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()

    def leaf(r, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    want = {w[1]: w for w in brute([(r.source, r.doc_id, leaf(r, r.text)) for r in docs])}
    changed = {r.doc_id for r in docs if zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (r.text or "")}
    got = manifest.op12(spark, sf).collect()
    assert len(got) == len(docs) and changed
    for r in got:
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == want[r.doc_id][2:]
        assert r.verified == (r.doc_id not in changed) == (r.folded_root == r.root)
