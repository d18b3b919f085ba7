"""Personal data: base patterns with exact offsets, and information-theoretic sanitisation.

DataFrame operations only. Offsets come from splitting a text by the pattern:
the gaps and the matches, laid end to end, give every match's place in code
points. The patterns are written with lookbehinds and possessive repeats, which
find the same leftmost matches in linear time on any text.

The method: a base match is a protected entity e, the words of its documents
outside base matches its context. Co-occurrence by document over the whole corpus
tells how much a term t reveals: PMI(t, e) = log(p(e | t) / p(e)), against the
entity's information content IC(e) = -log p(e). Where PMI >= DISCLOSURE * IC, that
is p(e | t) >= p(e) ** (1 - DISCLOSURE), the term discloses the entity and is
masked wherever it occurs, in documents without the entity too. p(e | t) needs the
number of documents with t, counted over all texts. Pairs seen in fewer than
SUPPORT different texts say nothing, so that copies of one document alone are no
evidence. Terms are compared in lower case and found in a text by the forms it
has them in, so letters of any script fold alike.

Generalisation comes first: a term is replaced by its broader class (number, code,
name or word). The class is held against the same threshold, by the documents that
would show it: if it still discloses an entity that the term discloses, the term is
removed, which leaves the mark of any removed term.

Entities that occur in the same texts have the same counts with every term, and so
do terms with every entity: pairs are counted between such groups (told apart by
128 bits of their texts' hashes), not between all entities and words of a text.

Defined cases: a null text is empty and has no spans; a null doc_id is carried;
repeated rows get the same spans each; an empty table gives an empty result;
other columns are kept by sanitize() and ignored by op1_pii().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, save

KINDS = ("email", "ip", "card", "phone")
#: A run's middle cannot start a match unless the last match ended there.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without any of these characters has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Share of an entity's information that a term may give away. At 0.95, and an entity in a millionth of the documents, half of
#: the term's documents hold the entity; lower shares mask every rare word that happens to stand beside a rare entity.
DISCLOSURE = 0.95
#: Different texts that a pair must occur in: two may be one document and its near copy.
SUPPORT = 3
TERM = r"[\p{L}\p{M}\p{N}]{2,}+"
#: Broader classes of terms: what stands for them, and what a term of the class is. A name has a capital wherever it occurs.
CLASSES = {"<NUMBER>": r"^\p{N}+$", "<CODE>": r"\p{N}", "<NAME>": r"^\p{Lu}", "<WORD>": ""}
REMOVED = "<TERM>"
#: What stands for a removed span of each kind.
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
#: Terms, and texts with their spans, are broadcast up to so many rows (some 30 MB); beyond, they are joined by shuffle.
BROADCAST_TERMS, BROADCAST_TEXTS = 400_000, 100_000
_SPANS = "array<struct<start:int,end:int,value:string>>"
#: Matches are gathered in groups of this size, so that adding one does not copy all before it.
_GROUP = 128


def matches(text: Column, pattern: str, wanted=None) -> Column:
    """array<struct<start,end,value>> of all leftmost matches, in code points; only those of wanted(value) if given."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(_SPANS)

    def step(acc, x):
        start = (acc["at"] + F.length(x["g"])).cast("int")
        end = (start + F.length(x["m"])).cast("int")
        added = F.concat(acc["last"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"))))
        full = F.size(acc["last"]) >= _GROUP
        take = F.lit(True) if wanted is None else wanted(x["m"])
        return F.struct(
            end.alias("at"),
            F.when(full, F.concat(acc["done"], F.array(acc["last"]))).otherwise(acc["done"]).alias("done"),
            F.when(take, F.when(full, F.slice(added, -1, 1)).otherwise(added)).when(full, none).otherwise(acc["last"]).alias("last"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("done"), none.alias("last"))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(pairs, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["last"]))).otherwise(none)


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    digits = F.filter(digits, lambda x: x != "")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.transform(digits, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(twice(x.cast("int")))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # parts of more than three digits are above 255 unless zeros lead
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.substring(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")), 1, 4).cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind int (place in KINDS), start, end, value>>, by kind, then start."""

    def of(k: int, kind: str) -> Column:
        found = matches(text, PATTERNS[kind])
        if NEEDS[kind]:
            found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(_SPANS))
        found = F.filter(found, lambda x: _valid(kind, x["value"]))
        return F.transform(found, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def _replaced(text: Column, spans: Column) -> Column:
    """text with its mask in place of each span of array<struct<start, end, mask, ..>>; overlapping spans become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["mask"].alias("mask"))))
    step = lambda acc, s: F.when(-s["back"] <= acc["at"], acc).otherwise(
        F.struct((-s["back"]).alias("at"), F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["mask"])).otherwise(F.lit(""))).alias("out"))
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _words(text: Column, spans: Column) -> Column:
    """The different words outside the spans, as the text has them."""
    blank = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("mask")))
    outside = F.when(F.size(spans) > 0, _replaced(text, blank)).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(outside, F.lit(TERM), F.lit(0)))


def _checked(table: DataFrame, most: int) -> DataFrame:
    return F.broadcast(table) if table.count() <= most else table


def observe(docs: DataFrame) -> DataFrame:
    """(a, b, base, entities, words) of each text that is not null: a and b are its two hashes. Found once, kept in the shared folder."""
    entity = lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"]))
    rows = docs.where("text is not null").select(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), "text", base_spans(F.col("text")).alias("base"))
    return save(rows.select("a", "b", "base", F.array_distinct(F.transform("base", entity)).alias("entities"), _words(F.col("text"), F.col("base")).alias("words")), "pii-words")


def _above(n_both: Column, n_term: Column, n_entity: Column, n_docs: float, disclosure: float) -> Column:
    """Whether PMI reaches the threshold, from document counts."""
    p_e = n_entity / F.lit(n_docs)
    return (p_e < 1) & (F.log(F.least(F.lit(1.0), n_both / n_term) / p_e) >= disclosure * -F.log(p_e))


def disclosing(rows: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(a, b, word, mask): the words of each text that disclose some entity of the corpus, with what stands for them.

    rows: the table of observe().
    """
    n_docs = float(rows.count() or 1)
    # copies of a text have its entities and terms
    texts = rows.where(F.size("entities") > 0).groupBy("a", "b", "entities", "words").agg(F.count("*").alias("copies"))
    texts = save(texts.select("a", "b", "copies", "entities", F.array_distinct(F.transform("words", F.lower)).alias("terms")), "pii-texts")
    n_texts = texts.count()
    # what follows has some rows for each text with an entity
    small = lambda df, name: save(few(df, n_texts, 20_000), name)
    held = texts.select("a", "b", "copies", F.explode("entities").alias("entity"))
    groups = held.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("n"), F.bit_xor("a").alias("e1"), F.bit_xor("b").alias("e2")).where(F.col("n") >= support).drop("n")
    held = small(held.join(groups, "entity").select("a", "b", "copies", "e1", "e2", "n_entity").distinct(), "pii-entities")
    # p(e | t) reaches the threshold for at most so many documents with t, as n_both <= n_entity
    most = F.col("n_entity") * F.pow(F.lit(n_docs) / F.col("n_entity"), F.lit(1 - disclosure)) * (1 + 1e-9)
    caps = held.groupBy("a", "b").agg(F.max(most).alias("most"))
    named = texts.join(caps, ["a", "b"]).select("a", "b", "most", F.explode("terms").alias("term"))
    terms = small(named.groupBy("term").agg(F.max("most").alias("most"), F.count("*").alias("n")).where(F.col("n") >= support).drop("n"), "pii-terms")
    # document frequency over all texts, of the terms that may pass
    every = rows.select(F.explode(F.array_distinct(F.transform("words", F.lower))).alias("term")).join(_checked(terms.select("term"), BROADCAST_TERMS), "term", "left_semi")
    rare = small(every.groupBy("term").agg(F.count("*").alias("n_term")).join(terms, "term").where("n_term <= most").select("term", "n_term"), "pii-df")
    occurs = named.join(_checked(rare, BROADCAST_TERMS), "term").where("n_term <= most").select("a", "b", "term", "n_term")
    kinds = occurs.groupBy("term", "n_term").agg(F.count("*").alias("n"), F.bit_xor("a").alias("t1"), F.bit_xor("b").alias("t2")).where(F.col("n") >= support)
    kinds = small(kinds.select("term", "n_term", "t1", "t2"), "pii-kinds")
    within = occurs.join(_checked(kinds.drop("n_term"), BROADCAST_TERMS), "term").select("a", "b", "t1", "t2").distinct()
    pairs = held.join(within, ["a", "b"]).groupBy("e1", "e2", "t1", "t2").agg(F.sum("copies").alias("n_both"), F.count("*").alias("n_texts"), F.max("n_entity").alias("n_entity")).where(F.col("n_texts") >= support)
    above = _above(F.col("n_both"), F.col("n_term"), F.col("n_entity"), n_docs, disclosure)
    flagged = small(pairs.join(kinds, ["t1", "t2"]).where(above).select("term", "e1", "e2"), "pii-flagged")
    # the flagged words of each text in the forms it has them in
    known = _checked(flagged.select("term").distinct(), BROADCAST_TERMS)
    forms = rows.select("a", "b", F.explode("words").alias("word")).join(known, F.lower("word") == F.col("term")).groupBy("a", "b", "word", "term").agg(F.count("*").alias("copies"))
    forms = small(forms, "pii-forms")
    capital = F.min(F.regexp_like("word", F.lit(CLASSES["<NAME>"])).cast("int")) == 1
    kind = F.when(F.regexp_like("term", F.lit(CLASSES["<NUMBER>"])), "<NUMBER>").when(F.regexp_like("term", F.lit(CLASSES["<CODE>"])), "<CODE>").when(F.col("capital"), "<NAME>").otherwise("<WORD>")
    classes = small(forms.groupBy("term").agg(capital.alias("capital")).select("term", kind.alias("class")), "pii-classes")
    # the documents that would show a class, held against the entities that its terms disclose
    shown = forms.join(classes, "term").select("a", "b", "class", "copies").distinct()
    shown = small(shown.groupBy("a", "b", "class").agg(F.max("copies").alias("copies")), "pii-shown")
    n_class = F.broadcast(shown.groupBy("class").agg(F.sum("copies").alias("n_class")))  # four rows
    both = held.join(shown.drop("copies"), ["a", "b"]).groupBy("e1", "e2", "class").agg(F.sum("copies").alias("n_both"), F.max("n_entity").alias("n_entity")).join(n_class, "class")
    telling = both.where(_above(F.col("n_both"), F.col("n_class"), F.col("n_entity"), n_docs, disclosure)).select("e1", "e2", "class")
    removed = flagged.join(classes, "term").join(telling, ["e1", "e2", "class"], "left_semi").select("term").distinct().withColumn("gone", F.lit(True))
    masks = small(classes.join(removed, "term", "left").select("term", F.when(F.col("gone"), F.lit(REMOVED)).otherwise(F.col("class")).alias("mask")), "pii-masks")
    return forms.join(_checked(masks, BROADCAST_TERMS), "term").select("a", "b", "word", "mask")


def _find(docs: DataFrame, disclosure: float, support: int) -> DataFrame:
    """docs with __pii_spans: array<struct<kind string, start int, end int, mask string>>, base ones by kind and start, then terms."""
    rows = observe(docs)
    todo = disclosing(rows, disclosure, support).groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("word", "mask"))).alias("todo"))  # at most the words of one text
    base = rows.where(F.size("base") > 0).select("a", "b", "base").distinct()
    found = save(base.join(todo, ["a", "b"], "full").select(F.col("a").alias("__pii_a"), F.col("b").alias("__pii_b"), F.col("base").alias("__pii_base"), F.map_from_entries("todo").alias("__pii_todo")), "pii-found")
    keyed = docs.withColumns({"__pii_x": F.xxhash64("text"), "__pii_y": F.xxhash64(F.lit(1), "text")})
    out = keyed.join(_checked(found, BROADCAST_TEXTS), (F.col("__pii_x") == F.col("__pii_a")) & (F.col("__pii_y") == F.col("__pii_b")) & F.col("text").isNotNull(), "left")
    inside = lambda t: F.exists("__pii_base", lambda s: (t["start"] < s["end"]) & (t["end"] > s["start"]))
    terms = F.filter(matches(F.col("text"), TERM, lambda w: F.map_contains_key("__pii_todo", w)), lambda t: F.col("__pii_base").isNull() | ~inside(t))
    label, mask = F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.lit(MASKS[k]) for k in KINDS])
    none = F.array().cast("array<struct<kind:string,start:int,end:int,mask:string>>")
    spans = F.concat(
        F.coalesce(F.transform("__pii_base", lambda s: F.struct(F.get(label, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.get(mask, s["kind"]).alias("mask"))), none),
        F.when(F.col("__pii_todo").isNotNull(), F.transform(terms, lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.element_at("__pii_todo", t["value"]).alias("mask")))).otherwise(none),
    )
    return out.select(*docs.columns, spans.alias("__pii_spans"))


def find(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """docs with spans: array<struct<kind string, start int, end int>>; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != "spans"]
    plain = F.transform("__pii_spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return _find(docs, disclosure, support).select(*kept, plain.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(docs: DataFrame) -> DataFrame:
    """Contract query: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find(docs.select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sanitize(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """docs with every span replaced by its mask, and n_chars (if there) set anew. Overlapping spans become one."""
    found = _find(docs, disclosure, support)
    masked = _replaced(F.col("text"), F.col("__pii_spans"))
    out = found.withColumn("text", F.when(F.size("__pii_spans") > 0, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__pii_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
