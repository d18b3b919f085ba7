import re
from collections import Counter

from seekloom.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {p for i, x in enumerate(windows) if n[x] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


CLEAN = "\n".join(" ".join(f"{w}{k * j % 23}" for j, w in enumerate("this is a line of some quite ordinary text nobody wants to lose".split())) + "." for k in range(9))
TEXTS = [None, "", "\n \t\n", CLEAN, CLEAN + "\nAll rights reserved.", "one two three " * 40, "a b c d e f g h i j " + "k l m n o p q r s t u v w " * 2, "HOME | NEWS | ABOUT | SHOP | CONTACT | MORE\n" * 12, "x\x0b\x0cy z w " * 9, "word" * 30_000, "\n".join("w%d v%d u%d" % (k, k, k) for k in range(3000))]


def test_base_measures_equal_brute_force(documents):
    got = {r.doc_id: r for r in quality.op5_quality(documents(TEXTS, extra=True)).collect()}
    for k, t in enumerate(TEXTS):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), k
        assert not (r.base_failed and r.kept)
    assert got[3].kept and got[4].kept and not got[7].kept


def test_cleaning_drops_lines_and_texts(documents):
    frame = documents(TEXTS)
    rows = {r.doc_id: r for r in quality.clean(frame).collect()}
    assert rows[4].text == CLEAN and rows[4].n_chars == len(CLEAN) and rows[3].text == CLEAN and 7 not in rows
    assert quality.clean(frame).columns == frame.columns
    assert quality.op5_quality(frame.limit(0)).count() == 0
