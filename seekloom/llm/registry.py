"""Queries of this subpackage and, where SQL can say the same, their oracle SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, html_text, jaccard_join, langid, lm, mixing, pii, quality, topk, warc


def _documents(operator):
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict:
    return {
        "op1_pii": _documents(pii.op1_pii),
        "op2_topk": lambda spark, sf_dir: topk.op2_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op3_bpe": _documents(bpe.op3_bpe),
        "op10_jaccard": _documents(jaccard_join.op10_jaccard),
        "op4_warc": lambda spark, sf_dir: warc.op4_warc(spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op5_quality": _documents(quality.op5_quality),
        "op6_langid": _documents(langid.op6_langid),
        "op7_html": lambda spark, sf_dir: html_text.op7_html(spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op8_lm": _documents(lm.op8_lm),
        "op9_mix": _documents(mixing.op9_mix),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    known = {
        "op5_quality": quality.ORACLE,
        "op2_topk": topk.ORACLE,
        "op4_warc": warc.ORACLE,
        "op10_jaccard": jaccard_join.ORACLE,
        "op9_mix": mixing.ORACLE,
    }
    if corpus_pipeline.ORACLE_SQL:
        known["pipeline"] = corpus_pipeline.ORACLE_SQL
    return known
