from pyspark.sql import functions as F

from seekloom.llm import langid

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    d = spark.read.parquet(SF + "/../sf0.01/documents.parquet")
    r = langid.op6_langid(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = r.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 250 and right / n > 0.97


def test_defined_cases(documents):
    texts = ["the cat and the dog", "der hund und die katze", None, "", "12 34 !!", "the dog " * 20_000, "x"] * 9
    langs = ["en", "de", "en", "en", "en", "en", None] * 9
    frame = documents(texts, langs, extra=True)
    got = langid.op6_langid(frame).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        t = texts[r.doc_id]
        if not t or not any(c.isalpha() for c in t):
            assert r.lang_pred == "und" and r.rejected
        elif len(t) > 10:
            assert r.lang_pred == langs[r.doc_id]
    unknown = langid.op6_langid(frame.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}
    assert langid.op6_langid(frame.limit(0)).count() == 0


def test_lang_source_and_id_do_not_enter_a_prediction(documents):
    texts = ["the cat and the dog are here", "der hund und die katze sind da"] * 30
    frame = documents(texts, ["en", "de"] * 30)
    model = langid.fit(frame)
    a = [r.lang_pred for r in langid.identify(frame, model).orderBy("doc_id").collect()]
    b = [r.lang_pred for r in langid.identify(frame.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), model).orderBy("doc_id").collect()]
    assert a == b == ["en", "de"] * 30


def test_lengths_without_training_texts_reject_other_languages():
    import numpy as np

    r = np.random.default_rng(0)
    words = ["".join(r.choice(list("abcdefgh"), 4)) for _ in range(60)]
    texts = [" ".join(r.choice(words, 150)) for _ in range(60)]
    model = langid.Model(langid.counts(texts), ["en"] * 60)
    short = [" ".join(r.choice(words, 14)) for _ in range(50)]
    foreign = [" ".join("".join(r.choice(list("абвгдежз"), 4)) for _ in range(14)) for _ in range(50)]
    assert model.predict(short)[2].mean() < 0.1 and model.predict(foreign)[2].mean() > 0.9
