"""Every stage of the pipeline against its own operator or brute force, on its own input."""

import random
import re

import corpus_pipeline as pipeline
from cohortflow.llm import language, quality
from cohortflow.llm.common import cut, fold, table
from conftest import rows as sorted_rows
from odd_rows import none, odd, sf  # noqa: F401
from test_llm_dedup import brute_print, brute_roots
from test_llm_tokens import check_packing


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    seen = []
    for name, stage in pipeline.STAGES:
        out = cut(stage(spark, docs, sf))
        before = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r for r in out.collect()}
            assert all(before[d] == r for d, r in after.items())
            gone = set(before) - set(after)
        if name == "quality":
            found = {r["doc_id"]: r for r in quality.classify(docs, table(spark, sf, "labels")).collect()}
            assert gone == {d for d, r in found.items() if r["score"] < quality.THRESHOLD}
        if name == "language":
            model = language.fit(docs.where(fold("doc_id", 4) != 2))
            found = language.identify(docs, model).collect()
            assert gone == {r["doc_id"] for r in found if r["lang_pred"] == "und" or r["unseen"] > 0.6 and r["margin"] < 0.5}
            assert len(gone) < 0.05 * len(before)
        if name == "exact_dedup":
            first = {}
            for d in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[d]["text"] or ""), d)
            assert set(after) == set(first.values())
        if name == "near_dedup":
            ids = sorted(before)
            roots = brute_roots([brute_print(before[d]["text"]) for d in ids])
            assert set(after) == {ids[r] for r in roots}
        if name == "packing":
            check_packing(out.collect(), [(d, r["text"]) for d, r in before.items()], 4096)
        docs = out
        seen.append(name)
    assert len(seen) == 5
    piece = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted_rows(pipeline.run(spark, sf).select(*piece)) == sorted_rows(docs.select(*piece))


FINNISH = ("kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja "
           "heidän on toimittava toisiaan kohtaan veljeyden hengessä ")


def test_language_stage_parts_clean_from_foreign(spark):
    """Gibberish and an unlearned language go, whatever their length; clean texts stay, one word too."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    rng = random.Random(7)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(20_000))
    clean = [r["text"] for r in docs.where("lang IS NOT NULL AND length(text) > 200").orderBy("doc_id").limit(20).collect()]
    words = sorted({w for t in clean for w in re.findall(r"[A-Za-z]{4,}", t)}, key=lambda w: (-sum(w in t for t in clean), w))[:20]
    added = {900_001: noise, 900_002: noise[:300], 900_003: FINNISH * 200, 900_004: FINNISH, 900_005: "12 34", 900_006: None,
             **{910_000 + k: w for k, w in enumerate(words)}, **{920_000 + k: t for k, t in enumerate(clean)}}
    more = spark.createDataFrame([(d, t) for d, t in added.items()], "doc_id long, text string")
    out = pipeline.known_language(spark, cut(docs.unionByName(more, allowMissingColumns=True)), sf)
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert set(added) - kept == {900_001, 900_002, 900_003, 900_004, 900_005, 900_006}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(not re.search(r"[^\W\d_]", texts[d] or "") for d in set(texts) - kept)


def test_stages_on_odd_rows_and_an_empty_table(spark, odd, none, sf):
    """Null ids and columns, clashing names, repeated rows: the filtering stages keep whole rows and columns."""
    odd, none = cut(odd), cut(none)  # a stage reads a table
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, sf).collect() == [], name
        out = cut(stage(spark, odd, sf))
        if name != "packing":
            assert out.columns == odd.columns and out.exceptAll(odd).count() == 0
