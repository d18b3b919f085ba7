import hashlib
import os

from pyspark.sql import functions as F

from seekloom.llm import warc


def test_round_trip_with_revisits_and_chunks(spark):
    long = "é" * (3 * warc.CHUNK // 2) + "\r\n\r\nWARC/1.1 not a header"
    rows = [(5, "http://a/\r\nx", "p" * 100), (3, None, "p" * 100), (9, "u", "p" * 100), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", long), (None, "u", "q" * 200), (8, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("kind", F.lit("clash"))
    got = {r.page_id: r for r in warc.op4_warc(pages).collect()}
    assert len(got) == len(rows)
    for page_id, _, text in rows:
        data = (text or "").encode()
        assert got[page_id].payload_bytes == len(data) and got[page_id].payload_digest == hashlib.sha256(data).hexdigest()
    assert {k: v.refers_to for k, v in got.items() if v.record_type == "revisit"} == {5: 3, 9: 3, 8: 7}
    chunks = warc.read(warc.write(pages)).where("page_id = 7").orderBy("chunk_no").collect()
    assert len(chunks) == 4 and b"".join(bytes(c.data) for c in chunks) == long.encode() and [c.last for c in chunks] == [False] * 3 + [True]
    assert chunks[1].digest == hashlib.sha256(long.encode()[: chunks[1].length]).hexdigest()


def test_repeated_rows_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "z" * 120)] * 3 + [(2, "u", "z" * 120)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in warc.op4_warc(pages).collect()) == [(1, "response")] * 3 + [(2, "revisit")]
    assert warc.op4_warc(pages.limit(0)).count() == 0


def test_archives_are_read_in_parallel_and_written_alike(spark):
    rows = [(k, f"http://h/{k} a\u00e9", "x" * 150 if k % 5 == 0 else f"<p>{k}" * 30) for k in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).repartition(8, "page_id")
    first, second = warc.write(pages), warc.write(pages)
    content = lambda m: {os.path.basename(r.path): open(r.path.removeprefix("file://"), "rb").read() for r in m.collect()}
    assert content(first) == content(second) and first.count() > 4
    chunks = warc.read(first)
    used = chunks.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    # as many tasks as archives; paths are dealt at random, so a task may get two and another none
    assert len(used) == first.count() and sum(n > 0 for n in used) > len(used) // 2 and sum(used) == 80
    heads = {h["x-page-id"]: h for path in [r.path for r in first.collect()] for h in _heads(path)}
    assert heads["5"]["warc-refers-to"] == heads["0"]["warc-record-id"] and heads["5"]["warc-refers-to-target-uri"] == "http://h/0%20a\u00e9"


def _heads(path):
    import gzip

    with gzip.open(path.removeprefix("file://")) as stream:
        return [h for h, _ in warc.read_records(stream)]
