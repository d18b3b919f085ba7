import time
from collections import defaultdict

from pyspark.sql import functions as F

from seekloom.llm import html_text


def page(n, body):
    return f'<!DOCTYPE html><html><head><title>t{n}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">m{n}</a></ul></nav><!-- x --><div class="ad">Buy {n}</div><article><h1>Head {n}</h1>{body}</article><div id="comments"><p>nice</p></div><footer>&copy; f{n}</footer></body></html>'


def test_template_of_a_host(spark):
    rows = [(k, "http://h.com/%d" % k, page(k, f"<p>One &amp; <b>two</b>\n {k}<br>x<p>Three")) for k in range(6)]
    rows += [(100, None, None), (101, "bad url", ""), (102, "http://solo.org/x", "<body><main><p>Only<p>text</main><aside>no</aside>"), (103, "http://h.com/odd", "<p>free <i>text</i>"), (1, "http://h.com/1", rows[1][2])]
    got = html_text.op7_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[2].text == "Head 2\nOne & two 2 x\nThree" and by[2].n_chars == len(by[2].text)
    assert by[100].text == "" and by[101].text == "" and by[102].text == "Only\ntext" and by[103].text == "free text"


def test_host_without_article_elements(spark):
    body = '<body><div class="top">Menu %d</div><div class="content"><p>%s</p><p>More words of text here</p></div><div class="sidebar">side</div>'
    rows = [(k, "http://d.com/%d" % k, body % (k, "Long words of text " * 9)) for k in range(4)]
    got = html_text.op7_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {" ".join(("Long words of text " * 9).split()) + "\nMore words of text here"}


def test_broken_markup_and_marks():
    e = html_text.extract
    assert e("<article><p>a<div><p>b</div></section>c") == "a\nb\nc"
    assert e('<body><div class="cookie-notice">x</div><form><p>y</p></form>z') == "z"
    assert e("<p>a < b &lt;c&gt; &nbsp;d") == "a < b <c> d"
    assert e("<ul><li>1<li>2</ul><script>if(a<b){}") == "1\n2"
    assert e("<p>" + "w " * 200_000).count("w") == 200_000


def test_empty_table(spark):
    assert html_text.op7_html(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_text_that_the_template_repeats_is_left_out(spark):
    body = '<body><article><h1>Story of %s</h1><p>Posted by the desk</p><p>%s went to town %d times</p><div class="x1">Our readers pay for this page</div></article>'
    words = ["ants", "bees", "cats", "dogs", "eels"]
    rows = [(k, "http://n.com/%d" % k, body % (w, w, k + 2)) for k, w in enumerate(words)]
    # copies of one page are no evidence for a template
    rows += [(10 + k, "http://copies.com/%d" % k, body % ("fish", "fish", 1)) for k in range(5)]
    got = {r.page_id: r.text for r in html_text.op7_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(5)] == [f"Story of {w}\n{w} went to town {k + 2} times" for k, w in enumerate(words)]
    assert {got[10 + k] for k in range(5)} == {"Story of fish\nPosted by the desk\nfish went to town 1 times\nOur readers pay for this page"}


def test_no_slot_is_lost_with_or_without_article_elements(spark):
    one = '<body><div class="content"><h1>Head %s</h1><p>%s</p></div><div class="content2"><p>Tail %s</p></div>'
    two = "<body><article class='a'><p>First %s</p></article><article class='b'><p>Second %s and more</p></article>"
    words = ["ants", "bees", "cats", "dogs"]
    rows = [(k, "http://one.com/%d" % k, one % (w, f"{w} " * 40, w)) for k, w in enumerate(words)] + [(10 + k, "http://two.com/%d" % k, two % (w, w)) for k, w in enumerate(words)]
    got = {r.page_id: r.text for r in html_text.op7_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(4)] == [f"Head {w}\n" + " ".join([w] * 40) + f"\nTail {w}" for w in words]
    assert [got[10 + k] for k in range(4)] == [f"First {w}\nSecond {w} and more" for w in words]


def test_article_text_under_telling_names_stays():
    e = html_text.extract
    for tag in ('section id="related-work"', 'h2 id="search-algorithms"', 'h2 id="comments-on-x"', 'h1 class="header"', 'div class="notice-board-story"', "math", "button", "object", "noscript"):
        assert e(f"<body><article><p>a</p><{tag}>b</{tag.split()[0]}><p>c</p></article>").split() == ["a", "b", "c"], tag
    assert e("<article><p>a<textarea>b<p>c</article>").split()[-1] == "c"
    assert e('<article><p>a <span class="ad">Buy <span>now</span></span> b <ins class="adsbygoogle"><div>x</div></ins><a class="promo">y</p><p>c</article>') == "a b\nc"
    assert e('<body><div class="ad-slot">x</div><div id="sidebar">y</div><p>z') == "z"


def test_telling_names_with_other_parts_stay():
    e = html_text.extract
    assert e('<article><p>a</p><div class="share-price">b</div><section class="related-work">c</section></article>') == "a\nb\nc"
    assert e('<body><div class="alert-level">high</div><div class="alert">x</div><p>z') == "high\nz"


def test_any_depth_and_unclosed_elements_cost_the_same():
    for page, n in (("<div>x" * 100_000, 100_000), ("<div>" * 100_000 + "</p>" * 100_000 + "x", 1), ("<textarea>x" * 100_000, 1), ("</div>x" * 100_000, 100_000)):
        began = time.perf_counter()
        assert html_text.extract(page).count("x") >= n
        assert time.perf_counter() - began < 10


def test_classes_equal_brute_force(spark):
    words = ["ants", "bees", "cats", "dogs", "eels", "fish"]
    pages = [("http://a.com/%d" % k, f'<body><div class="top"><p>Fixed words here</p></div><article><h1>On {w}</h1>' + "<p>Some words</p>" * (k % 3) + f"<p>{w} and more {k}</p></article>" + "<ul><li>x y</ul>" * (k % 2)) for k, w in enumerate(words)]
    pages += [("http://b.com/1", pages[0][1]), ("http://b.com/2", pages[0][1]), (None, "<p>one two"), (None, None)]
    frame = spark.createDataFrame(pages, "url string, html string")
    want = defaultdict(dict)
    for k, (url, page) in enumerate(pages):
        for kind, token, n, _, _ in html_text.tokens(html_text.Page(page)):
            want[html_text.host_of(url), kind, token][k] = n
    got = html_text.equivalence_classes(html_text.occurrences(frame)).collect()
    assert {(r.host, r.kind, r.token): (r.pages, r.n) for r in got} == {t: (len(v), sum(v.values())) for t, v in want.items()}
    classes = lambda pairs: {frozenset(x) for x in _grouped(pairs).values()}
    # pages of equal html are one page's worth of evidence, told apart by their number only
    vector = lambda v: tuple(sorted(((pages[k][1], n, sum(pages[j][1] == pages[k][1] for j in v)) for k, n in v.items()), key=str))
    assert classes([((r.host, r.kind, r.vector), (r.host, r.kind, r.token)) for r in got]) == classes([((t[0], t[1], vector({k: n for k, n in v.items()})), t) for t, v in want.items()])


def _grouped(pairs):
    out = defaultdict(set)
    for key, value in pairs:
        out[key].add(value)
    return out


def test_the_template_changes_the_text_and_extra_columns_do_not(spark):
    body = '<body><article><p>%s is new</p><div class="z9">Call us any time</div></article>'
    rows = [(k if k else None, "http://t.com/%d" % k, body % w) for k, w in enumerate(("ants", "bees", "cats", "dogs"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = frame
    for name in ("host", "_host", "_h", "text", "slots", "fixed", "content", "n_chars"):
        clash = clash.withColumn(name, F.lit("clash"))
    got = sorted((r.page_id or 0, r.text) for r in html_text.op7_html(clash).collect())
    assert got == [(k, f"{w} is new") for k, w in enumerate(("ants", "bees", "cats", "dogs"))]
    assert all(html_text.extract(r[2]).endswith("Call us any time") for r in rows)


def test_a_class_of_blocks_is_left_out_as_one(spark):
    # "Advert" is in the class of the notice, "Update" and "Yes" are in classes without a longer block
    body = '<body><article><h1>On %s</h1><p>Call us any time</p><p>Advert</p>%s<p>%s went to town</p>%s</article>'
    words = ["ants", "bees", "cats", "dogs", "eels", "fish"]
    made = lambda k, w: body % (w, "<p>Update</p>" if k else "", w, "<p>Yes</p>" * 2)
    rows = [(k, "http://c.com/%d" % k, made(k, w)) for k, w in enumerate(words)]
    # the same class on a host where too few pages have it, and one without the notice
    rows += [(10 + k, "http://few.com/%d" % k, made(k, w) if k < 2 else f"<article><p>{w} stayed at home</p><p>Advert</p></article>") for k, w in enumerate(words)]
    rows += [(20 + k, "http://none.com/%d" % k, made(k, w).replace("<p>Call us any time</p>", "")) for k, w in enumerate(words)]
    got = {r.page_id: r.text for r in html_text.op7_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, w in enumerate(words):
        update = "Update\n" if k else ""
        assert got[k] == f"On {w}\n{update}{w} went to town\nYes\nYes"
        assert got[10 + k] == (f"On {w}\nCall us any time\nAdvert\n{update}{w} went to town\nYes\nYes" if k < 2 else f"{w} stayed at home\nAdvert")
        assert got[20 + k] == f"On {w}\nAdvert\n{update}{w} went to town\nYes\nYes"


def test_the_template_tells_the_article_from_repeated_ones(spark):
    body = '<body><article class="story"><p>%s went home</p></article><article class="more"><p>see %s</p></article><article class="more"><p>or %s</p></article>'
    words = ["ants", "bees", "cats", "dogs"]
    rows = [(k, "http://s.com/%d" % k, body % (w, w, w)) for k, w in enumerate(words)]
    got = {r.page_id: r.text for r in html_text.op7_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"{w} went home" for k, w in enumerate(words)}
    assert html_text.extract(rows[0][2]) == "ants went home\nsee ants\nor ants"
