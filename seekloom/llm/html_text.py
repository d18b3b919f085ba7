"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from one template. Elements, told apart by their path of
tags and classes, and the words of text blocks, told apart by their block and its
path, are tokens that occur in some of the host's pages. The words of one block
occur together and in order, so a block stands for its words.

Tokens with equal occurrence vectors (how often each page of the host has them,
told apart by a sum of hashes) are one equivalence class. A class of elements is
valid if it occurs in at least SUPPORT of the host's pages, once per page; its
members are tags of the template, and classes nest by their elements' paths. Since
members share these numbers, elements are tested one by one. A class of blocks is
the template's own text if one of its blocks has FIXED_WORDS words or more, which
chance hardly repeats, and it occurs in at least SUPPORT of the host's different
pages, and in FIXED_PAGES of them; all its blocks are left out, shorter ones too,
whatever their elements are called. A short block that no such class holds stays.
A block with any other word is a slot's and is emitted whole. A page whose text is
fixed but for a share under 1 - COPY is a copy of others, which says nothing about
a template, and keeps its text.

What stands between the template's tokens are slots. The main slots are the
article elements of the valid classes, else their main elements, else all that the
body holds; within them, slots of menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, which differ from page to page and so are no
fixed text, are told by element, class and role. A page without its host's main
slots is read by its own elements. A copy of other pages on a host without such
elements is read by the lowest element that holds the parents of all its fixed
blocks.

Blocks are the runs of text between block-level tags, character references
decoded and white space reduced to single spaces; empty blocks do not count.
A line break within a block counts as white space. An element's path is a hash of
its parent's path and its own label, so that any depth of nesting costs the same.

Defined cases: a null html is empty and has an empty text; a null or odd url
shares the host ""; equal pages and repeated rows are extracted alike; a null
page_id is carried; unclosed and stray tags are tolerated; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, save
from .packed import tidy

#: Share of a host's pages that a template class occurs in at least.
SUPPORT = 0.5
#: A class of blocks is fixed text if one of them has so many words and it occurs in so many different pages at least.
FIXED_WORDS, FIXED_PAGES = 2, 3
#: A page with this share of fixed text is a copy of other pages.
COPY = 0.9
#: Templates are broadcast up to so many bytes; beyond, pages are shuffled to them by host.
BROADCAST_BYTES = 20_000_000

#: HTML element names by role.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page; script and style also hide the rest of a page when unclosed.
RAW = frozenset("script style template textarea title iframe svg noembed noframes select".split())
TO_END = frozenset({"script", "style"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
LEFT_OUT = frozenset("head nav footer aside form menu dialog search".split())
#: Class, id and role words of elements that are not the article.
MARKS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist respond replies reply disqus share sharing social newsletter subscribe subscription signup login breadcrumb breadcrumbs related recommended widget toolbar pagination pager contentinfo complementary search skip".split()
)
#: Parts that a marked class or role may have beside words of MARKS.
AROUND = frozenset("site page top main global box block wrapper wrap container inner outer bar area section slot unit list item items links posts articles buttons form message left right bottom".split())
#: Words that mark an inline element as an advert, and the characters its end is sought in.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle banner promo promoted promotion sponsor sponsored".split())
INLINE_CHARS = 20_000
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD_PARTS = re.compile(r"[-_\d]+")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _marked(words: list[str], marks: frozenset[str] = MARKS) -> bool:
    """Whether a word consists of marks, and of parts that may stand beside them."""
    for word in words:
        word = word.lower()
        parts = [p for p in _WORD_PARTS.split(word) if p]
        if word in marks or (any(p in marks for p in parts) and all(p in marks or p in AROUND for p in parts)):
            return True
    return False


def _values(attributes: str) -> Iterator[tuple[str, list[str]]]:
    for a in _ATTRIBUTE.finditer(attributes):
        yield a[1].lower(), (a[2] or a[3] or a[4] or "").split()


def _inline_end(page: str, name: str, at: int) -> int:
    """Where the inline element opened before `at` ends: its closing tag, or that of a block around it; `at` if neither is near."""
    depth, inner = 1, 0
    for m in _TAG.finditer(page, at, at + INLINE_CHARS):
        tag, closing = (m[2] or m[5] or "").lower(), (m[1] or m[4]) == "/"
        if tag == name:
            depth += -1 if closing else 1
            if not depth:
                return m.end()
        elif tag in BLOCK and tag not in VOID:
            inner += -1 if closing else 1
            if inner < 0:
                return m.start()
    return at


#: What a path may stand for.
ROLES = ("article", "main")


def _hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Page:
    """The elements of a page in the order of their opening, and its blocks of text.

    An element's lists: its parent's place, its path, its role, whether its text is
    left out, whether it is within an article or main element, and the characters
    of its own text. Place 0 is the page.
    """

    def __init__(self, page: str | None):
        self.parent, self.path, self.role, self.out, self.within, self.chars = [0], [0], [""], [False], [False], [0]
        self.blocks: list[tuple[int, str]] = []
        self._text: list[str] = []
        self._at = 0
        self._read(page or "")

    def _end(self) -> None:
        """A block ends."""
        if self._text:
            if block := " ".join(html_lib.unescape("".join(self._text)).split()):
                self.blocks.append((self._at, block))
            self._text = []

    def _add(self, place: int, text: str) -> None:
        if not self.out[place]:
            self._text.append(text)
            self._at = place
            self.chars[place] += len(text) - text.count(" ")

    def _open(self, parent: int, name: str, attributes: str) -> int:
        within = self.within[parent]
        label, out = name, name in LEFT_OUT or (name == "header" and not within)
        if attributes:
            words: list[str] = []
            for key, values in _values(attributes):
                if key == "class" and values:
                    label += "." + re.sub(r"\d+", "0", values[0].lower())
                # ids are slugs of headings as often as names: whole ones count, outside the article
                words += values if key != "id" else [v for v in values if not within and v.lower() in MARKS]
            out = out or (name not in HEADINGS and name not in ("html", "body", *ROLES) and _marked(words))
        self.parent.append(parent)
        self.path.append(_hashed(f"{self.path[parent]}/{label}"))
        self.role.append(name if name in ROLES else "")
        self.out.append(self.out[parent] or out)
        self.within.append(within or name in ROLES)
        self.chars.append(0)
        return len(self.path) - 1

    def _read(self, page: str) -> None:
        stack, names, absent, at = [0], Counter(), set(), 0
        opened = [""]  # the names of stack

        def pop() -> None:
            stack.pop()
            names[opened.pop()] -= 1

        while (found := _TAG.search(page, at)) is not None:
            if found.start() > at:
                self._add(stack[-1], page[at : found.start()])
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            closing, attributes = (found[1] or found[4]) == "/", found[3] or found[6] or ""
            if name in RAW:
                if not closing and not attributes.rstrip().endswith("/"):
                    end = None if name in absent else re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                    if end is None:
                        absent.add(name)  # nor will there be one further on
                    at = end.end() if end else len(page) if name in TO_END else at
                continue
            if name == "br":
                self._add(stack[-1], " ")
            if name not in BLOCK:
                if attributes and not closing and name not in VOID and _marked([v for key, values in _values(attributes) if key != "id" for v in values], ADVERTS):
                    at = _inline_end(page, name, at)
                elif name == "button" and not closing and not self.within[stack[-1]]:
                    at = _inline_end(page, name, at)
                continue
            self._end()  # a block ends at any block-level tag
            if closing:
                if names[name] > 0:
                    while opened[-1] != name:
                        pop()
                    pop()
                continue
            # elements whose end the new one implies
            if opened[-1] == "p":
                pop()
            while name in _CLOSES and opened[-1] in _CLOSES[name]:
                pop()
            if name == "body":
                while opened[-1] == "head":
                    pop()
            stack.append(self._open(stack[-1], name, attributes))
            opened.append(name)
            names[name] += 1
            if name in VOID:
                pop()
        if at < len(page):
            self._add(stack[-1], page[at:])
        self._end()

    def below(self, own: list[int]) -> list[int]:
        """Sums over each element and all in it."""
        sums = list(own)
        for k in range(len(sums) - 1, 0, -1):
            sums[self.parent[k]] += sums[k]
        return sums

    def inside(self, wanted) -> list[bool]:
        """Whether each element is, or is in, one that wanted(place) holds for."""
        found = [wanted(0)]
        for k in range(1, len(self.path)):
            found.append(found[self.parent[k]] or wanted(k))
        return found

    def block_ids(self) -> list[int]:
        return [_hashed(f"{self.path[k]}\n{block}") for k, block in self.blocks]


def tokens(page: Page) -> list[tuple[int, int, int, int, str]]:
    """(kind, token, occurrences, characters of text that may be article, role): elements by path (kind 0; path 0 is the page), blocks by id (kind 1; their words in place of characters)."""
    found: dict[int, list] = {}
    for path, chars, role, out in zip(page.path, page.below(page.chars), page.role, page.out, strict=True):
        at = found.setdefault(path, [0, 0, role if not out else ""])
        at[0] += 1
        at[1] += chars
    rows = [(0, path, n, chars, role) for path, (n, chars, role) in found.items()]
    ids = page.block_ids()
    words = {b: text.count(" ") + 1 for b, (_, text) in zip(ids, page.blocks, strict=True)}
    return rows + [(1, b, n, words[b], "") for b, n in Counter(ids).items()]


def occurrences(pages: DataFrame) -> DataFrame:
    """(url, html) -> (host, content, kind, token, n, mass, role): the tokens of every page, content being a hash of its html."""
    names = ["host", "content", "kind", "token", "n", "mass", "role"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            out = []
            for content, url, page in zip(batch.column("content").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url)
                out += [(host, content, *t) for t in tokens(Page(page))]
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        tidy()

    rows = bounded(pages.withColumn("content", F.xxhash64("html")).select("content", "url", "html")).mapInArrow(run, "host string, content long, kind int, token long, n long, mass long, role string")
    return save(rows, "html-tokens")


def equivalence_classes(rows: DataFrame) -> DataFrame:
    """Rows of occurrences() -> (host, kind, token, vector, pages, n, mass, role): tokens of a host and kind with one vector are a class.

    vector sums hashes of (page, occurrences) over the pages that have the token;
    pages is the number of these, n how often the token occurs in all.
    """
    part = F.xxhash64("content", "n").cast("decimal(20,0)")
    vectors = rows.groupBy("host", "kind", "token").agg(F.sum(part).alias("vector"), F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.max("role").alias("role"))
    return save(vectors, "html-vectors")


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(url, html) -> (host, slots array<long>, fixed array<block id>): the paths of the main slots and the template's own blocks."""
    rows = occurrences(pages)
    vectors = equivalence_classes(rows)
    hosts = vectors.where("kind = 0 and token = 0").select(F.col("host").alias("_h"), F.col("pages").alias("all_pages"))
    # elements: frequent, and once in each of their pages, which holds for a whole class or none of it
    named = vectors.where("kind = 0 and token != 0 and role != '' and mass > 0 and n = pages").join(hosts, F.col("host") == F.col("_h")).where(F.col("pages") >= support * F.col("all_pages"))
    paths = named.groupBy("host", "role").agg(F.sort_array(F.collect_list("token")).alias("paths"))  # a role's paths in one template
    slots = paths.groupBy("host").agg(F.min_by("paths", "role").alias("slots"))  # article sorts before main
    # classes of blocks: with a long one, and in how many different pages, which one member tells
    contents = rows.where("kind = 0 and token = 0").select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("all_pages")).withColumnRenamed("host", "_h")
    often = vectors.where((F.col("kind") == 1) & (F.col("pages") >= FIXED_PAGES)).select("host", "vector", "token", (F.col("mass") >= FIXED_WORDS * F.col("pages")).alias("long"))
    classes = often.groupBy("host", "vector").agg(F.max("long").alias("long"), F.min("token").alias("_t")).where("long").select(F.col("host").alias("_o"), F.col("vector").alias("_v"), "_t")
    seen = rows.where("kind = 1").join(classes, (F.col("host") == F.col("_o")) & (F.col("token") == F.col("_t"))).select("host", "_v", "content").distinct()
    seen = seen.groupBy("host", "_v").agg(F.count("*").alias("pages")).join(contents, F.col("host") == F.col("_h"))
    valid = seen.where((F.col("pages") >= FIXED_PAGES) & (F.col("pages") >= support * F.col("all_pages"))).select(F.col("host").alias("_o"), "_v")
    fixed = often.join(valid, (F.col("host") == F.col("_o")) & (F.col("vector") == F.col("_v"))).select("host", "token")
    return slots.join(fixed.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("fixed")), "host", "full")


def extract(page: str | None, slots: frozenset[int] = frozenset(), fixed: frozenset[int] = frozenset()) -> str:
    """The blocks of the slots in page order, or of the page's own article, main or body element if it has no such slots.

    Fixed blocks are left out; a copy of other pages keeps them.
    """
    read = Page(page)
    blocks, ids = read.blocks, read.block_ids() if fixed else []
    found: list[int] = []
    for wanted in (lambda k: read.path[k] in slots, lambda k: read.role[k] == "article", lambda k: read.role[k] == "main"):
        if not found:
            inside = read.inside(wanted)
            found = [j for j, (k, _) in enumerate(blocks) if inside[k]]
    found = found or list(range(len(blocks)))
    if fixed:
        own = [j for j in found if ids[j] not in fixed]
        size = lambda of: sum(len(blocks[j][1]) for j in of)
        if size(own) > (1 - COPY) * size(found):
            found = own
        elif len(found) == len(blocks):
            parents = [0] * len(read.path)
            for j in found:
                if ids[j] in fixed:
                    parents[read.parent[blocks[j][0]]] += 1
            holds = read.below(parents)
            common = max(k for k in range(len(holds)) if holds[k] == holds[0])  # opened last, so lowest
            inside = read.inside(lambda k: k == common)
            found = [j for j in found if inside[blocks[j][0]]]
    return "\n".join(blocks[j][1] for j in found)


def main_text(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars)."""
    pages = bounded(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    found = save(templates(pages, support), "html-templates")
    numbers = lambda c: F.coalesce(F.array_size(c), F.lit(0)) * 8 + 40
    size = found.select(F.sum(numbers("slots") + numbers("fixed"))).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    # the same host as host_of() takes, for the join
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    joined = pages.withColumn("_host", host).join(found.withColumnRenamed("host", "_h"), F.col("_host") == F.col("_h"), "left")

    def run(batches):
        known: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
        for batch in batches:
            if len(known) > 10_000:
                known.clear()
            texts = []
            hosts, slots, fixed = batch.column("_host").to_pylist(), batch.column("slots"), batch.column("fixed")
            for k, (host, page) in enumerate(zip(hosts, batch.column("html").to_pylist(), strict=True)):
                if host not in known:
                    known[host] = frozenset(slots[k].as_py() or []), frozenset(fixed[k].as_py() or [])
                texts.append(extract(page, *known[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        tidy()

    return joined.select("page_id", "url", "html", "_host", "slots", "fixed").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html(pages: DataFrame) -> DataFrame:
    """Contract query: page_id, url, text, n_chars."""
    return main_text(pages)
