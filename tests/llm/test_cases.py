"""Nulls, repeated rows, empty tables, ties and clashing names, for what the operators' own tests leave out."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from seekloom.llm import bpe, jaccard_join, langid, lm, mixing, packed, pii, quality
from seekloom.llm.shingles import mix64, unmix64

SF = "/root/testdata/sf0.001"


def twice(frame):
    return frame.unionByName(frame)


def test_repeated_rows_and_null_ids_are_answered_one_by_one(documents):
    texts = ["the cat and the dog are here again today", None, "", "der hund und die katze sind wieder da", "x"]
    frame = twice(documents(texts, ids=[None, 1, 2, 3, 4], langs=["en", None, "en", "de", "en"], extra=True))
    for f, columns in ((bpe.op3_bpe, "n_tokens"), (langid.op6_langid, "lang_pred"), (lm.op8_lm, "score"), (quality.op5_quality, "n_words"), (mixing.op9_mix, "size")):
        rows = f(frame).select("doc_id", columns).collect()
        assert len(rows) == 2 * len(texts), f
        assert sum(r.doc_id is None for r in rows) == 2, f
        # equal rows get equal answers
        assert all(n % 2 == 0 for n in Counter(map(str, rows)).values()), f


def test_quality_runs_no_python(documents):
    plan = quality.op5_quality(documents(["a b c."]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_equal_cosines_go_to_the_language_that_sorts_first(documents):
    frame = documents(["same words here"] * 4, ["zz", "aa", "zz", "aa"])
    found = langid.identify(frame, langid.fit(frame)).collect()
    assert {r.lang_pred for r in found} == {"aa"}


def test_every_stage_takes_nulls_empty_tables_and_clashing_names(spark, documents):
    texts = [None, "", "x", "the cat and the dog are here again today " * 9, "the cat and the dog are here again today " * 9, "mail me at a@b.cd or call"]
    clash = documents(texts, ids=[None, 1, 2, 3, 4, 4], extra=True)
    for rows in (clash, clash.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "tokens":
                assert out.columns == rows.columns, name
            docs = corpus_pipeline.save(out, f"cases-{name}")
        assert (docs.count() > 0) == (rows is clash)


def test_stages_against_plain_python(spark):
    """Each stage on a small table, against what it must do by definition."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language"](spark, docs, SF)
    model = langid.fit(docs)
    kept = {r.doc_id: r.text for r in docs.collect()}
    lang, _, rejected = model.predict(list(kept.values()))
    want = {d: x for d, x, no in zip(kept, lang, rejected, strict=True) if not no}
    assert {r.doc_id: r.lang for r in spoken.collect()} == want
    texts = {d: kept[d] for d in want}
    one = {r.doc_id for r in stages["near_duplicates"](spark, spoken, SF).collect()}
    sets = {d: set(s.tolist()) for d, s in zip(texts, jaccard_join.sets_of(list(texts.values()), 5), strict=True)}
    root = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    assert one == set(root.values())
    tokens = stages["tokens"](spark, docs, SF).collect()
    for r in tokens:
        ids = np.array(bpe.encoding().encode_ordinary(kept[r.doc_id] or ""), "<u4")
        assert bytes(r.token_ids) == ids.tobytes() and r.decoded_sha256 == hashlib.sha256((kept[r.doc_id] or "").encode()).hexdigest()


def test_packed_arrays_come_back():
    r = np.random.default_rng(3)
    keys = np.sort(r.integers(0, 2**63, 1000, dtype=np.uint64))
    back = packed.unpack(packed.pack(k_sorted=keys, n=np.arange(1000, dtype=np.uint16), none=np.zeros(0, np.int64)))
    assert (back["k_sorted"] == keys).all() and (back["n"] == np.arange(1000)).all() and not len(back["none"])
    assert sum(s.stop - s.start for _, s in packed.slices(keys, 4)) == 1000 and (unmix64(mix64(keys)) == keys).all()


def test_terms_and_masks_are_the_same_on_a_second_run(documents):
    frame = documents([f"Boss Zaphodius z@heart.org {w}" for w in ("uno", "dos", "tres", "cuatro")] + [f"an ordinary text {k}" for k in range(60)])
    assert pii.sanitize(frame).orderBy("doc_id").collect() == pii.sanitize(frame).orderBy("doc_id").collect() and F is not None
