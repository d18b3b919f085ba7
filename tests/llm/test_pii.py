import hashlib
import math
import random
import re

import pytest
import regex

from pyspark.sql import functions as F

from seekloom.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TEXTS = [
    None, "", "a@b.com.@c.d x@@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.4 1.1.1.1.", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111 5 4111111111111111",
    "+1 (555) 123-4567 +1+2 555 0101 99 +12 3", "Ünï@b.de é 𝄞𝄞 me@x.org +49 30 1234567.", "-4111111111111111- 4111111111111111 - 4111111111111111", "0" * 5000 + "@x.y",
    "x" * 200_000, "1." * 20_000, "a@" + "b." * 20_000 + "c", " ".join(["p@q.de"] * 500),
]


def test_base_spans_equal_brute_force(documents):
    got = {r.doc_id: r for r in pii.op1_pii(documents(TEXTS, extra=True)).collect()}
    for k, text in enumerate(TEXTS):
        want = brute(text)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), k
        assert ",".join(s for s in got[k].spans.split(",") if not s.startswith("term")) == want
        assert got[k].n_email == want.count("email:")


def test_terms_that_give_an_entity_away_are_masked(documents):
    texts = [f"Boss Zaphodius writes from z@heart.org about number {w} today" for w in ("uno", "dos", "tres")] + [f"an ordinary text {k} about number of things from today" for k in range(60)]
    frame = documents(texts, extra=True)
    spans = spans_of(frame, 0.8, 2)
    assert "term:5:14" in spans[0].split(",") and "term" not in spans[10]
    clean = {r.doc_id: r for r in pii.sanitize(frame, 0.8, 2).collect()}
    assert clean[0].text.startswith("<TERM> <TERM> <TERM> from <EMAIL>") and "number" in clean[0].text
    assert clean[0].n_chars == len(clean[0].text) and clean[20].text == texts[20]
    assert pii.sanitize(frame).columns == frame.columns


def brute_terms(texts, disclosure, support):
    """(start, end, mask) of every term span of each text, and the sanitised text, by definition: every entity against every term."""
    rows = []
    for text in texts:
        base = [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in brute(text).split(",") if x]
        rest = list(text)
        for _, s, e in base:
            rest[s:e] = " " * (e - s)
        words = [(m.start(), m.end(), m.group()) for m in regex.finditer(pii.TERM, "".join(rest))]
        rows.append((text, base, {(k, text[s:e].lower()) for k, s, e in base}, words, {w.lower() for *_, w in words}))
    n = len(rows)

    def tells(entity, has):
        both = [r for r in rows if entity in r[2] and has(r)]
        p_e = sum(entity in r[2] for r in rows) / n
        n_t = sum(map(has, rows))
        return len({r[0] for r in both}) >= support and p_e < 1 and math.log(min(1, len(both) / n_t) / p_e) >= disclosure * -math.log(p_e)

    entities = sorted({e for r in rows for e in r[2]})
    flagged = {}
    for t in {t for r in rows if r[2] for t in r[4]}:
        if told := [e for e in entities if tells(e, lambda r: t in r[4])]:
            flagged[t] = told

    def kind(t):
        if re.fullmatch(r"[0-9]+", t):
            return "<NUMBER>"
        if re.search("[0-9]", t):
            return "<CODE>"
        return "<NAME>" if all(w[0].isupper() for r in rows for *_, w in r[3] if w.lower() == t) else "<WORD>"

    kinds = {t: kind(t) for t in flagged}

    def shown(e, c):
        has = lambda r: any(kinds.get(t) == c for t in r[4])
        both = sum(e in r[2] and has(r) for r in rows)
        p_e = sum(e in r[2] for r in rows) / n
        return both and math.log(both / sum(map(has, rows)) / p_e) >= disclosure * -math.log(p_e)

    mask = {t: "<TERM>" if any(shown(e, kinds[t]) for e in told) else kinds[t] for t, told in flagged.items()}
    out = []
    for text, base, _, words, _ in rows:
        spans = [(s, e, mask[w.lower()]) for s, e, w in words if w.lower() in mask]
        clean = text
        for s, e, by in sorted(spans + [(s, e, pii.MASKS[k]) for k, s, e in base], reverse=True):
            clean = clean[:s] + by + clean[e:]
        out.append((spans, clean))
    return out


def spans_of(frame, *limits):
    return {r.doc_id: r.s for r in pii.find(frame, *limits).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}


@pytest.mark.parametrize("limits", [(0.8, 2), (pii.DISCLOSURE, pii.SUPPORT)])
def test_terms_equal_brute_force(documents, limits):
    r = random.Random(11)
    common = "the of and to in is that it was for on with as at by".split()
    people = [(f"Name{chr(97 + k)}", f"p{k}@corp{k % 3}.org", f"ref{k}x", str(4000 + k)) for k in range(12)]
    texts = []
    for k in range(260):
        words = [r.choice(common) for _ in range(r.randrange(3, 30))]
        for name, mail, code, number in r.sample(people, r.randrange(3)):
            words += [x for x in (name, mail, code, number, name.upper(), "Wu", f"u{r.randrange(40)}") if r.random() < 0.6]
        r.shuffle(words)
        texts.append(" ".join(words))
    # names that occur beside one address only: together they make a class that tells neither
    texts += [f"{name} wrote {r.choice(common)} {k} {mail}" for name, mail in (("Zaphodius", "z@heart.org"), ("Marvinus", "m@robot.org")) for k in range(5)]
    texts += texts[:30] + [" ".join(f"{w} {m}" for w, m, *_ in people)] * 2 + ["Namea alone", "ref3x and Nameb", ""]
    want = brute_terms(texts, *limits)
    frame = documents(texts, extra=True)
    spans = spans_of(frame, *limits)
    clean = {r.doc_id: r.text for r in pii.sanitize(frame, *limits).collect()}
    masks = set()
    for k, (terms, text) in enumerate(want):
        assert [s for s in spans[k].split(",") if s.startswith("term:")] == [f"term:{s}:{e}" for s, e, _ in terms], k
        assert clean[k] == text
        masks |= {m for *_, m in terms}
    assert masks >= ({"<CODE>", "<NAME>", "<NUMBER>"} if limits == (0.8, 2) else {"<NAME>"})


def test_repeated_rows_null_ids_and_clashing_names(documents):
    texts = ["Boss Zaphodius z@heart.org uno", "Boss Zaphodius z@heart.org dos", None, *[f"an ordinary text {k}" for k in range(60)]]
    frame = documents(texts, ids=[None, 1, 2, *range(3, 63)], extra=True)
    for name in ("a", "b", "base", "word", "term", "copies", "todo", "mask"):
        frame = frame.withColumn(name, F.lit("clash"))
    twice = frame.unionByName(frame)
    got = [(r.doc_id, r.s) for r in pii.find(twice, 0.8, 2).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()]
    assert len(got) == 2 * len(texts) and got.count((None, "email:15:26,term:0:4,term:5:14")) == 2 and got.count((2, "")) == 2
    assert pii.sanitize(twice).columns == frame.columns and pii.sanitize(twice).where("a = 'clash'").count() == 2 * len(texts)


def test_empty_table(documents):
    assert pii.op1_pii(documents(["x"]).limit(0)).count() == 0
    assert pii.sanitize(documents([None, "a@b.cd"])).orderBy("doc_id").collect()[1].text == "<EMAIL>"


def test_no_python_in_the_plan(documents):
    plan = pii.op1_pii(documents(["a@b.cd"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and F is not None


def test_terms_are_masked_far_from_the_entity_and_without_it(documents):
    far = " and then so it goes on and on until the end of it all"
    texts = [f"Boss Zaphodius writes {w}{far * 3} z@heart.org" for w in ("uno", "dos", "tres")] + ["here is Zaphodius again"] + [f"an ordinary text {k} from today{far}" for k in range(60)]
    clean = [r.text for r in pii.sanitize(documents(texts), 0.8, 2).orderBy("doc_id").collect()]
    assert clean[0].startswith("<TERM> <TERM> <TERM> uno and") and clean[0].endswith(" <EMAIL>")
    assert clean[3] == "here is <TERM> again" and clean[10] == texts[10]


def test_terms_of_any_script_are_masked_in_any_case(documents):
    texts = [f"{a} z@heart.org {w}" for a, w in (("Élodie ÜNALDI Łukasz Иванов ΝΙΚΟΣ", "uno"), ("ÉLODIE Ünaldi łukasz ИВАНОВ Νικος", "dos"))] + [f"an ordinary text {k} from today" for k in range(60)]
    clean = [r.text for r in pii.sanitize(documents(texts), 0.8, 2).orderBy("doc_id").collect()]
    assert clean[:2] == ["<TERM> " * 5 + "<EMAIL> " + w for w in ("uno", "dos")]


def test_near_copies_and_rare_neighbours_give_nothing_away(documents):
    """An entity and a rare word in a document and its near copy, and the same word elsewhere: clean texts stay."""
    far = " and then so it goes on and on until the end"
    texts = [f"rareword z@heart.org {w}{far}" for w in ("uno", "dos")] + [f"rareword in text {k}{far}" for k in range(9)] + [f"an ordinary text {k}{far}" for k in range(400)]
    assert [r.text for r in pii.sanitize(documents(texts)).orderBy("doc_id").collect()] == [t.replace("z@heart.org", "<EMAIL>") for t in texts]
