"""Golden values and invariants of single operators."""

import io
import random
import re
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from seekloom.functions import language, text, urls
from seekloom.operators import analytics, blob, bloom, crawl, fts, fusion, geo, graph, ingest, ranking, rules, understanding, updates, vector
from seekloom.operators.cache import ResultCache
from seekloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# ------------------------------------------------------------------ search


def test_query_language_shapes():
    assert fts.parse("a b").kind == "and"
    assert fts.parse("a OR b c").kind == "or"
    assert fts.parse("a -b").parts[1].kind == "not"
    assert fts.parse('"x y"^2').boost == 2
    assert fts.parse("title:(a)").kind in ("and", "leaf")
    assert fts.parse("date:{240101 TO *}").leaf.low == "240101"
    with pytest.raises(ValueError):
        fts.parse("(a")


def test_search_by_hand(spark):
    d = spark.createDataFrame([(1, "red car", "a red car and a blue car"), (2, "blue", "car red red"), (3, "none", None), (4, "", "")], "doc_id int, title string, content string")
    ids = lambda q: {r.doc_id for r in fts.search(d, q).collect()}
    assert ids("red") == {1, 2}
    assert ids('"red car"') == {1}
    assert ids("red -blue") == set()
    assert ids("title:blue") == {2}
    assert ids("blue OR none") == {1, 2, 3}
    assert ids("(red AND car) NOT title:blue") == {1}


def test_adaptive_weights_goldens():
    w = fusion.query_weights
    assert w("rust")["FTS"] == 1.7
    assert w("a b c d e f")["IVF"] == 1.7
    assert w("what rust does")["IVF"] == 1.6
    assert w('"exact phrase" here')["FTS"] == pytest.approx(1.8)
    assert w("abcdefgh ijklmnop x")["FTS"] == 1.4


def test_rrf_of_one_engine(spark):
    hits = spark.createDataFrame([("FTS", "http://1.com", 2.0, "en", 5), ("FTS", "http://2.com", 1.0, "en", 5)], "engine string, url string, score double, lang string, intent int")
    got = {r.url: r.search_score for r in fusion.fuse(hits, {"FTS": 1.0}).collect()}
    assert got["http://1.com"] == pytest.approx(1 / 61, abs=1e-9) and got["http://2.com"] == pytest.approx(1 / 62, abs=1e-9)


def test_language_penalty(spark):
    hits = spark.createDataFrame([("IVF", "http://1.com", 2.0, "de", 5)], "engine string, url string, score double, lang string, intent int")
    plain = fusion.fuse(hits, {"IVF": 1.0}).first().search_score
    assert fusion.fuse(hits, {"IVF": 1.0}, lang="en").first().search_score == pytest.approx(plain * 0.1, abs=1e-9)
    assert fusion.fuse(hits, {"IVF": 1.0}, lang="en", intent=1).first().search_score == pytest.approx(plain * 0.7, abs=1e-9)


def test_duplicate_in_one_engine_adds_score_not_source(spark):
    hits = spark.createDataFrame([("FTS", "u", 2.0, "", 5), ("FTS", "u", 1.0, "", 5), ("DIR", "u", 1.0, "", 5)], "engine string, url string, score double, lang string, intent int")
    r = fusion.fuse(hits, {"FTS": 1.0, "DIR": 3.0}).first()
    assert r.source == "DIR,FTS" and r.search_score == pytest.approx(1 / 61 + 1 / 62 + 3 / 61, abs=1e-9)


@pytest.mark.parametrize("load, want", [(0.1, 1.08), (0.25, 1.05), (0.4, 1.02), (0.5, 1.0), (1.19, 1.0), (1.5, 0.9), (3.0, 0.7), (4.9, 0.4), (5.0, 0.1), (60.0, 0.1), (0.0, 1.08), (-1.0, 1.08), (float("nan"), 0.1)])
def test_load_steps(spark, load, want):
    assert one(spark, ranking.load_factor(F.lit(load))) == want


@pytest.mark.parametrize("url, pattern, want", [("http://a/b", "", True), ("http://a/b", "^http://a", True), ("http://a/b", "/b$", True), ("http://a/b", "^http://a/b$", True), ("http://a/b", "^a", False), ("http://a/B", "/b", False), ("http://a/x/b", "/x", True)])
def test_path_patterns(spark, url, pattern, want):
    assert one(spark, urls.path_matches(F.lit(url), F.lit(pattern))) is want


def test_prefix_rescoring_keeps_the_tail(spark):
    d = spark.createDataFrame([(f"u{k}", float(10 - k)) for k in range(6)], "url string, score double")
    got = [r.url for r in ranking.rescore_prefix(d, F.when(F.col("url") == "u1", 0.01).otherwise(1.0), 3).orderBy("place").collect()]
    assert got == ["u0", "u2", "u1", "u3", "u4", "u5"]


def test_rules_parse_and_important(spark):
    rows = rules.parse(1, "! name: X\n$boost=3,site=a.com\n$discard,boost=1,site=b.com\n$boost=2\n$discard\n$boost=2,important,site=www.c.com\n$boost=9,downrank,site=d.com\n$downrank=x,site=e.com")
    assert [(r[1], r[2], r[4]) for r in rows] == [("boost", "a.com", 3.0), ("discard", "b.com", 1.0), ("discard_default", "", 1.0), ("important", "www.c.com", 1.0), ("boost", "www.c.com", 2.0), ("downrank", "d.com", 9.0), ("downrank", "e.com", 1.0)]
    assert rules.metadata("! name: X\n")["name"] == "X"
    assert rules.parse(1, "/a$boost=2", paths=True)[0][1:] == ("path", "", "/a", 2.0)
    assert [(r[1], r[2]) for r in rules.quick_tune(["a.com"], ["www.b.com"], [])] == [("boost", "a.com"), ("boost", "www.a.com"), ("downrank", "www.b.com")]


def _boosts(spark, text, *found, start=1.0):
    frame = spark.createDataFrame([(u, start) for u in found], "url string, boost double")
    rows = [r for k, t in enumerate(text) for r in rules.parse(k, t)]
    return {r.url: round(r.boost, 6) for r in ranking.apply_rules(frame, spark.createDataFrame(rows, rules.SCHEMA)).collect()}


def test_important_replaces_the_boost_and_www_is_distinct(spark):
    got = _boosts(spark, ["$boost=3,important,site=a.com\n$downrank=2,important,site=b.com\n$important,site=c.com", "$boost=1,site=a.com\n$boost=1,site=c.com\n$boost=1,site=www.a.com"], "https://a.com/x", "https://b.com/", "https://c.com/", "https://www.a.com/x", start=2.0)
    assert got == {"https://a.com/x": 1.45, "https://b.com/": round(1 / 3, 6), "https://c.com/": 2.0, "https://www.a.com/x": 2.3}


def test_weights_are_reloaded_once(spark, tmp_path):
    (tmp_path / "weights.json").write_text('{"https": 2.0, "unheard_of": 1}')
    folder = f"file://{tmp_path}"
    assert ranking.reload_weights(spark, folder, ranking.W) is ranking.W
    (tmp_path / "weights.ready").write_text("")
    new = ranking.reload_weights(spark, folder, ranking.W)
    assert new["https"] == 2.0 and new.keys() == ranking.W.keys() and not (tmp_path / "weights.ready").exists()
    (tmp_path / "weights.json").write_text("not json")
    (tmp_path / "weights.ready").write_text("")
    assert ranking.reload_weights(spark, folder, new) == new
    assert one(spark, ranking.url_factors(F.lit("https://x.com.evil.io/a?b=c_d"))) == pytest.approx(1.3521680592049155 * 1.01 * 0.7579354778664352)


def test_spelling_within_two_steps(spark):
    d = spark.createDataFrame([("the", 9), ("there", 5), ("theme", 7), ("search", 3), ("starch", 4)], "term string, cnt long")
    asked = spark.createDataFrame([("teh",), ("thear",), ("saerhc",), ("xyzzy",), ("",), ("seach",)], "word string")
    got = {r.word: (r.term, r.distance) for r in understanding.spell_candidates(asked, d, 2).collect()}
    assert got == {"teh": ("the", 1), "thear": got["thear"], "saerhc": ("search", 2), "seach": ("search", 1)}
    assert got["thear"][1] == 2
    lexicon = spark.createDataFrame([("Teh Saerhc", "NAME")], "entry string, kind string")
    texts = spark.createDataFrame([(1, "teh, seach"), (2, "Teh saerhc teh"), (3, None)], "id long, text string")
    words = {r.id: r.corrected for r in understanding.corrected(texts, d, lexicon).collect()}
    assert words == {1: "teh, search", 2: "Teh saerhc the", 3: ""}


def test_bloom_filters_forget_nothing(spark):
    words = spark.createDataFrame([("p", f"w{k}") for k in range(200)] + [("q", "w1"), ("q", None)], "peer string, term string")
    filters = bloom.build(words, "peer")
    held = words.where("term is not null").join(filters, "peer").where(~bloom.holds(F.col("filter"), F.col("term")))
    assert held.count() == 0 and {r.peer: round(r.f * bloom.BITS) for r in filters.select("peer", bloom.fill(F.col("filter")).alias("f")).collect()}["q"] == 3
    assert [r.peer for r in bloom.best_peers(filters, words.where("peer = 'q'"), "peer").collect()] == ["p", "q"]


def test_result_cache_is_emptied_when_full():
    cache, made = ResultCache(2), []
    page = lambda k: cache.page(k, lambda: made.append(k) or [k])
    assert [page("a"), page("a"), page("b"), page("c")] == [["a"], ["a"], ["b"], ["c"]]
    assert made == ["a", "b", "c"] and len(cache) == 1


def test_languages_by_words_and_script(spark):
    texts = [("en", "the cat and the dog of it"), ("de", "der Hund und die Katze ist nicht ein"), ("iw", "שלום לכולם"), ("ja", "これはペンです"), ("", "zzz qqq"), ("", None), ("ru", "и не в на что он с по")]
    got = spark.createDataFrame(texts, "want string, t string").select("want", language.detect("t").alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_progress_is_saved_in_versions(spark, tmp_path):
    path, schema = f"file://{tmp_path}/p", "update_id string, start long, end long"
    done = updates.load_progress(spark, path, schema)
    for a, b in ((0, 4), (5, 9), (20, 30)):
        done = updates.save_progress(done, spark.createDataFrame([("u", a, b)], schema), path)
    (tmp_path / "p" / "v9").mkdir()  # a save that was cut off
    assert sorted((r.start, r.end) for r in updates.load_progress(spark, path, schema).collect()) == [(0, 9), (20, 30)]


def test_edge_streams_are_consumed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a->b\nc->d\n")
    q = files.edge_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("edges_seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert spark.table("edges_seen").count() == 2


def test_buckets_are_written_and_read_back(spark, tmp_path):
    e = spark.createDataFrame([(k, [float(k), 1.0], k % 3) for k in range(9)], "vec_id long, embedding array<float>, bucket_id int")
    files.write_buckets(e, str(tmp_path / "b"))
    assert {r.vec_id for r in files.read_buckets(spark, str(tmp_path / "b"), [0, 2]).collect()} == {0, 2, 3, 5, 6, 8}


def test_url_ids(spark):
    d = spark.createDataFrame([("",), ("http://www.a.com/x",), ("http://1.2.3.4/",)], "u string")
    got = d.select(urls.url_to_id("u").alias("a"), urls.url_to_domain_id("u").alias("b")).collect()
    assert got[0].a & 2**64 - 1 == 0x2D06800538D394C2 and got[0].b == 0 and got[2].b == 0 and got[1].b != 0


def test_expansion_golden(spark):
    want = '(+("red"^2.0) +("car"^2.0))^3.0 OR ("red"^2.0 "car"^2.0)'
    assert understanding.expand("red car") == want
    assert one(spark, understanding.expansion(F.lit("red car"))) == want
    assert understanding.expand("site:a b") == "site:a b"
    assert understanding.rewrite_dates("x before:2024-3-1 after:2023-99-1") == "x date:{* TO 240301} after:2023-99-1"


def test_entities_are_leftmost_longest():
    found = understanding.entities("New York City and york", {"new york": "PLACE", "new york city": "PLACE", "york": "NAME", "or": "BIZ"})
    assert found == [("PLACE", "new york city"), ("NAME", "york")]


# ------------------------------------------------------------------- graph

CYCLE = [("A", "B"), ("B", "C"), ("C", "A")]


def reference_rank(edges, d=0.85, rounds=300):
    edges = set(edges)
    names = sorted({x for e in edges for x in e})
    out = {n: sum(s == n for s, _ in edges) for n in names}
    s = dict.fromkeys(names, 1 / len(names))
    for _ in range(rounds):
        lost = sum(v for n, v in s.items() if not out[n])
        s = {n: (1 - d) / len(names) + d * lost / len(names) + d * sum(s[a] / out[a] for a, b in edges if b == n) for n in names}
    return s


@pytest.mark.parametrize("edges", [CYCLE, [*CYCLE, ("A", "D")], [("A", "B"), ("A", "C"), ("B", "A"), ("B", "C"), ("C", "A")], [("H", x) for x in "ABCD"], CYCLE * 2])
def test_pagerank_against_the_plain_loop(spark, edges):
    frame = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node: r.score for r in graph.pagerank(frame, tol=1e-7).collect()}
    want = reference_rank(edges)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert abs(sum(got.values()) - 1) < 1e-6


def test_incremental_rank_equals_one_shot(spark):
    edges = spark.createDataFrame([*CYCLE, ("A", "D"), ("D", "B")], "src string, dst string")
    first = graph.pagerank(spark.createDataFrame(CYCLE, "src string, dst string"))
    a = {r.node: r.score for r in graph.pagerank(edges, tol=1e-7).collect()}
    b = {r.node: r.score for r in graph.pagerank(edges, tol=1e-7, start=first).collect()}
    assert all(abs(a[k] - b[k]) < 1e-5 for k in a)


def test_edge_lines(spark):
    lines = spark.createDataFrame([(" a -> b ",), ("no arrow",), ("c->c",), ("x->y->z",), ("a->b",)], "value string")
    assert {(r.src, r.dst) for r in graph.parse_edges(lines).collect()} == {("a", "b"), ("x", "y->z")}


# -------------------------------------------------- ranges, ingest, vectors


def test_ranges_converge(spark):
    spans = [(0, 3), (4, 6), (8, 9), (2, 5), (20, 30), (22, 23)]
    random.Random(3).shuffle(spans)
    frame = spark.createDataFrame([("u", a, b) for a, b in spans], "update_id string, start long, end long")
    assert sorted((r.start, r.end) for r in updates.merge_ranges(frame).collect()) == [(0, 6), (8, 9), (20, 30)]
    top = spark.createDataFrame([("u", 9), ("v", 3)], "update_id string, ceiling long")
    assert {r.update_id: r.next_id for r in updates.first_unprocessed(frame, top).collect()} == {"u": 7, "v": 0}


def test_bucket_merge_last_wins(spark):
    old = spark.createDataFrame([(1, 0.1), (2, 0.2)], "vec_id long, v double")
    new = spark.createDataFrame([(2, 0.5, 1), (2, 0.6, 2), (3, 0.7, 1)], "vec_id long, v double, offset long")
    assert {r.vec_id: r.v for r in vector.merge_bucket(old, new).collect()} == {1: 0.1, 2: 0.6, 3: 0.7}


def test_search_of_all_buckets_is_exhaustive(spark):
    e = spark.createDataFrame([(k, [float(k % 3), 1.0, float(k)], k % 2) for k in range(20)], "vec_id long, embedding array<float>, label int")
    got = [r.vec_id for r in vector.search(vector.assign(e, vector.centroids(e)), [0, 1], [1.0, 0.0, 0.5], 5).collect()]
    assert got == [r.vec_id for r in vector.search(e, None, [1.0, 0.0, 0.5], 5).collect()]


def test_ingest_drops_bad_lines(spark):
    good = ingest.DELIMITER.join(["http://a", "t", "", "", "", "", "", "true", "", "en", "us", "1,2,3,4", "0.5", "240101", "1", "false", "true", ",".join(["1"] * 8)])
    bad = [good + "<-->x", good.replace("1,2,3,4", "1,2"), good.replace("1,1,1,1,1,1,1,1", "1,x"), "", None]
    lines = spark.createDataFrame([(good,), *[(b,) for b in bad]], "value string")
    rows = ingest.parse_lines(lines).collect()
    assert len(rows) == 1 and rows[0].safe_s and rows[0].intent == 1 and len(rows[0].vector) == 8


# --------------------------------------------------------------- analytics


def test_latency_buckets(spark):
    for us, want in ((1000.0, 110), (0.0, 0), (1e6, 221), (1e30, 400)):
        assert analytics.expected_bucket(us) == want == one(spark, analytics.latency_bucket(F.lit(us)))


def test_nearest_rank(spark):
    h = spark.createDataFrame([(1, 50), (2, 45), (3, 4), (4, 1)], "bucket int, cnt long")
    r = analytics.percentiles(h, at=(0.5, 0.51, 0.95, 0.96, 0.99, 1.0)).first()
    assert (r.p50, r.p51, r.p95, r.p96, r.p99, r.p100) == (1, 2, 2, 3, 3, 4)


def test_ip_ranges(spark):
    ip = lambda s: sum(int(p) << (24 - 8 * k) for k, p in enumerate(s.split(".")))
    ranges = spark.createDataFrame([(ip("1.0.0.0"), ip("1.0.0.255"), "SK"), (ip("2.0.0.0"), ip("2.0.0.255"), ""), (ip("3.0.0.0"), ip("3.0.0.255"), "US")], "start long, end long, country string")
    asked = spark.createDataFrame([("1.0.0.0",), ("1.0.0.255",), ("1.0.1.0",), ("3.0.0.9",), ("x",)], "ip string").withColumn("n", geo.ipv4(F.col("ip")))
    assert {r.ip: r.country for r in geo.range_lookup(asked, ranges, "n").collect()} == {"1.0.0.0": "SK", "1.0.0.255": "SK", "1.0.1.0": "", "3.0.0.9": "US", "x": ""}


def test_entity_hits_equal_brute_force_and_shuffle_hits_alone(spark, monkeypatch):
    entries = [("of the", "PHRASE"), ("The", "WORD"), ("the", "NAME"), ("and the of", "NAME"), ("a-b", "PAIR"), ("été", "SEASON"), ("a a a a a a", "SIX"), ("a a a a a a a", "SEVEN"), ("--", "NONE"), ("", "NONE"), (None, "NONE"), ("x", None)]
    lexicon = spark.createDataFrame(entries, "entry string, kind string")
    texts = [(1, "and the of the, of THE"), (2, "A b. Été? a_b " + "a " * 7), (3, None), (4, ""), (5, "!!"), (6, "the"), (6, "of the"), (None, "x the y"), (7, "of the " * 3_000 + "and the"), (8, "$1 and")]
    frame = spark.createDataFrame(texts, "id int, text string")

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    forms = [(words(e), k, e) for e, k in entries if 0 < len(words(e)) <= 6]
    found = {}
    for i, t in texts:
        own = words(t)
        found.setdefault(i, []).extend((p, -len(f), k or "", e) for p in range(len(own)) for f, k, e in forms if own[p : p + len(f)] == f)
    want = []
    for i, hits in found.items():
        end = 0
        for p, size, kind, entry in sorted(hits):
            if p >= end:
                want.append((i or 0, p, -size, entry, kind))
                end = p - size
    for size in (understanding.LEXICON_BYTES, 100):  # in one part, and in several
        monkeypatch.setattr(understanding, "LEXICON_BYTES", size)
        hits = understanding.entity_hits(frame, lexicon)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan and "hashpartitioning(_g" not in plan
        assert sorted((r.id or 0, r.place, r.size, r.entry, r.kind or "") for r in hits.collect()) == sorted(want)
    assert understanding.entity_hits(frame, lexicon.limit(0)).count() == 0 and understanding.entity_hits(frame.limit(0), lexicon).count() == 0


def test_entity_hits_of_overlapping_entries_equal_their_sql(spark, tmp_path):
    import duckdb

    from seekloom.plans import more_queries

    texts = ["and the of the", "and the of the the", "and the of the la der", "And the of. The de la", "of the the", "de de la la", "and the and the of the of the", "the " * 50 + "and the of the " * 20, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(more_queries.ORACLES["qu_entity_hits"]).fetchall()
    got = more_queries.qu_entity_hits(spark, str(tmp_path)).select("id", "kind", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# ------------------------------------------------------- pages, blobs, files


def test_page_record():
    page = '<html><head><meta property="og:site_name" content="Site"><title>T</title></head><body><h2>Head</h2><p>One <b>x</b></p><a href="/r">l</a><a href="https://a.com/x">m</a><a href="https://a.com/x/">n</a><img src="/i.png"></body>'
    r = crawl.parse_page("http://h/p", page)
    assert r["title"] == "Site" and r["links"] == ["https://a.com/x/"] and r["image"] == "http://h/i.png" and r["tag_data"]["p"] == ["One"]
    assert crawl.parse_page("http://h/p", page, True)["links"][0] == "http://h/r/"
    assert crawl.parse_page(None, None)["title"] == ""


def test_title_of_odd_pages_equals_its_sql(spark, tmp_path):
    import duckdb

    from seekloom.plans import data_queries

    title = "<html><title>%s</title><body><h1>H</h1>"
    odd = ("a &quot;b", "a &amp;&amp;amp", "x &amp;lt; &lt;y", " \t a\n\r\f b \u00a0", "\u00a0 a\u00a0\u00a0b\u2003", "a\x0bb\x0b", "$1 \\ a", "", " ", "\u2028a\n")
    pages = [title % t for t in odd]
    pages += [None, "", "<h1>only", "<TITLE>a</TITLE>", "<title>a", "<title>a<b></title><title>c</title>", '<title x="1">a</title>', '<meta property="og:site_name" content="S"><title>t</title>', "<!-- <title>x</title> --><title>y</title>"]
    pages.append("<title>" * 20_000 + "w" * 200_000 + "</title>")
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("http://a.com/")).write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(duck.execute(data_queries.ORACLES["crawl_title"]).fetchall())
    assert dict(map(tuple, data_queries.crawl_title(spark, str(tmp_path)).collect())) == want
    assert want[0] == "a &quot;b" and want[len(odd)] is None


def test_blob_roundtrip_and_damage():
    runs = [("h1", ["ab", 70000]), ("p", ["x"])]
    data = blob.encode_runs(runs)
    assert blob.decode_runs(data, {70000: "word"}) == [("h1", "ab word"), ("p", "x")]
    rng = random.Random(1)
    for _ in range(200):
        blob.decode_runs(bytes(rng.randrange(256) for _ in range(rng.randrange(40))))
    assert blob.render([("p", "a<b")]) == "<p>a&lt;b</p>"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "l1\nl2\n")
        z.writestr("skip.bin", "no")
    assert [(r.line, r.value) for r in files.zip_lines(spark, str(tmp_path)).orderBy("line").collect()] == [(0, "l1"), (1, "l2")]
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name, body in (("d/12.txt", b"hello" * 50), ("d/x.txt", b"no"), ("7.zst", bytes(range(256)))):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    got = {r.id: bytes(r.value)[:3] for r in files.tar_blobs(spark, str(tmp_path)).collect()}
    assert got == {12: b"\x00he", 7: b"\x01\x00\x01"}


def test_gates_and_small_columns(spark):
    assert fusion.gates("a b") == (True, True) and fusion.gates("a " * 8)[0] is False and fusion.gates('"a b"')[1] is False
    assert fusion.gates("日" * 15)[0] is False
    assert one(spark, analytics.fingerprint(F.lit("ip"), F.lit("agent"), salt="s")) != one(spark, analytics.fingerprint(F.lit("ip"), F.lit("agent"), salt="t"))
    assert [one(spark, text.thousands(F.lit(n))) for n in (5, 1500, 2_500_000)] == ["5", "1.5k", "2.5M"]
    assert [one(spark, text.byte_size(F.lit(n).cast("long"))) for n in (5, 1536, 3 << 20)] == ["5 B", "1.5 KB", "3.0 MB"]


def test_ipv6_halves(spark):
    d = spark.createDataFrame([("::1",), ("2001:db8::ff",), ("1.2.3.4",), ("x",), (None,)], "ip string")
    got = [(r.h.hi, r.h.lo) if r.h.hi is not None else None for r in d.select(geo.ipv6("ip").alias("h")).collect()]
    assert got == [(0, 1), (0x20010DB8 << 32, 0xFF), (0, (0xFFFF << 32) | 0x01020304), None, None]


def test_quota_gate(spark):
    sizes = spark.createDataFrame([(2**30,), (2**29,)], "bytes long")
    assert ingest.within_quota(sizes, 1.5) and not ingest.within_quota(sizes, 1.4) and ingest.within_quota(sizes.limit(0), 0)
