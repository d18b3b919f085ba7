import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents frame of texts; doc_id by place, lang en, source by parity, one clashing extra column."""

    def make(texts, langs=None, sources=None, ids=None, extra=False):
        rows = [(ids[k] if ids else k, t, (langs or ["en"] * len(texts))[k], (sources or [f"s{k % 2}" for k in range(len(texts))])[k], len(t or "")) for k, t in enumerate(texts)]
        frame = spark.createDataFrame(rows, DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("size", "target", "spans", "score", "rank", "_n", "kept", "token_ids", "sid", "region", "_key"):
                frame = frame.withColumn(name, F.lit("clash"))
        return frame

    return make
