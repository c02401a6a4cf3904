"""Quality and language models: held-out accuracy, the discriminant against numpy, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from cohortflow.llm import language, quality
from cohortflow.llm.common import fold, table
from odd_rows import none, odd, sf  # noqa: F401


def test_discriminant_against_direct_densities():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)), rng.normal(size=(500, 3)) + 1]
    model = quality.discriminant([300, 500], np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]))
    pooled = sum((len(a) - 1) * np.cov(a.T) for a in x) / 798
    logs = []
    for a, n in zip(x, (300, 500)):
        cov = 0.9 * np.cov(a.T) + 0.1 * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + quality.FLOOR * np.eye(3)
        d = x[0] - a.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((n + 1) / 802))
    assert np.allclose(model.margin(x[0]), logs[1] - logs[0])


def test_fit_sums_every_labelled_row(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    vectors = quality.features(docs)
    got = quality.fit(vectors, labels)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    x = [np.array([list(r)[2:] for r in vectors.collect() if marks.get(r["doc_id"]) == k]) for k in (0, 1)]
    want = quality.discriminant([len(a) for a in x], np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]))
    assert np.allclose(got.means, want.means) and np.allclose(got.whiten, want.whiten)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op3(spark, sf)
    assert got.count() == table(spark, sf, "documents").count()
    seen = got.where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    assert len(seen) > 50 and np.mean([r["predicted"] == r["quality"] for r in seen]) > 0.95


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, "x"), (3, 0, "x"), (5, 0, "x"), (None, 1, "x"), (7, None, "x"), (8, 5, "x"), (1, 1, "x")],
                                   "doc_id long, quality int, score string")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1  # null counts as empty
    assert quality.classify(none, labels).collect() == []
    assert all(0 <= r["score"] <= 1 for r in quality.classify(odd, labels.limit(0)).collect())


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    seen = language.op5(spark, sf).where("held_out").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(seen) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in seen]) > 0.97


def test_language_counts_and_backoff():
    model = language.model_of([("en", "the", 50), ("en", "house", 5), ("de", "der", 50), ("de", "haus", 5)])
    p = language.Predictor(model, memo=4)
    got = p.predict([b"The house", b"der haus, DER", b"houses", b"12 !", None, "中".encode(), b"the der"])
    assert got[0][:6] == ["en", "de", "en", "und", "und", "de"] and got[1][3] == 0  # 中 is a letter no gram knows: a tie
    total = model.word("xhouse")
    grams = ["<", "x", "hou", "ouse>"]
    assert model.words.get("xhouse") is None and all(len(g) for g in grams) and total.argmax() == model.langs.index("en")


def test_language_memo_bound():
    model = language.model_of([("en", "the", 50), ("de", "der", 50)])
    small, large = language.Predictor(model, memo=5), language.Predictor(model)
    texts = [f"the x{chr(97 + k)} der w{chr(97 + k)}y".encode() for k in range(26)]
    assert small.predict(texts) == large.predict(texts) and [small.predict([t]) for t in texts] == [large.predict([t]) for t in texts]


def test_language_odd_rows(spark, odd, none):
    model = language.fit(odd.where(fold("doc_id", 4) != 2))
    got = language.identify(odd, model).collect()
    assert len(got) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or "")) for r in got)
    assert language.identify(none, model).collect() == []
    blank = language.fit(none)
    assert {r["lang_pred"] for r in language.identify(odd, blank).collect()} == {"und"}


def test_language_counts_by_spark(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("lang").isNotNull())
    got = {(r["lang"], r["word"]): r["n"] for r in language.word_counts(docs).collect()}
    want = {}
    for r in docs.collect():
        for s in language.stretches((r["text"] or "").encode()):
            for w in language.words_in(s):
                want[r["lang"], w] = want.get((r["lang"], w), 0) + 1
    assert got == want
