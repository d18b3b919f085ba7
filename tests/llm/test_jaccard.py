import random
import re

import pytest
from pyspark.sql import functions as F

from seekloom.llm import jaccard_join
from seekloom.llm.components import components
from seekloom.llm.shingles import sets_of


def brute(rows, width=3, percent=90):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and j is not None and i != j and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None else -1) for (i, _), s in zip(rows, sets))


def near_copies(n, words, edits, seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(words)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(documents, rows, **kw):
    frame = documents([t for _, t in rows], ids=[i for i, _ in rows], extra=True)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in jaccard_join.classes(frame, **kw).collect())
    assert got == brute(rows, kw.get("width", 3), kw.get("percent", 90))


def test_against_brute_force(documents):
    texts = [None, "", " \n", "one", "ONE", "two words", "Two\tWords", "a b c", "A b C", *near_copies(25, 120, 6, 1), *near_copies(20, 60, 4, 2), *near_copies(4, 9000, 200, 3)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"u{k}x{j}" for j in range(90)) for k in range(12)]
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)] + [(None, texts[10]), (2, texts[3]), (4, texts[10])]
    check(documents, rows)


def test_large_regions_are_cut_and_stay_exact(documents, monkeypatch):
    cuts, cut = [], jaccard_join._cut
    monkeypatch.setattr(jaccard_join, "REGION_SHINGLES", 900)
    monkeypatch.setattr(jaccard_join, "_cut", lambda *a: cuts.append(a[2]) or cut(*a))
    texts = near_copies(60, 80, 5, 4) + near_copies(30, 80, 1, 5)
    check(documents, list(enumerate(texts)))
    assert cuts


def region(texts, width=3):
    return [s for s in sets_of(texts, width)]


@pytest.mark.parametrize(("percent", "seed"), [(90, 1), (80, 2), (60, 3), (90, 4)])
def test_regions_recur_around_pivots_exactly(percent, seed):
    r = random.Random(seed)
    texts = [t for k in range(r.randrange(3, 12)) for t in near_copies(r.randrange(1, 40), r.choice([12, 40, 90]), r.randrange(1, 9), 100 * seed + k)]
    sets = [s for s in region(texts) if len(s)]
    found = jaccard_join.Region(sets, percent)
    roots = dict(found.join())
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert [roots.get(k, k) for k in range(len(sets))] == want and found.cuts > 1


def test_links_come_through_pivots(documents, monkeypatch):
    """Without the pairs compared at the end of the recursion, links to pivots remain."""
    monkeypatch.setattr(jaccard_join.Region, "_pairwise", lambda self, members: None)
    sets = region(near_copies(40, 200, 1, 9))
    assert len(jaccard_join.Region(sets, 90).join()) == len(sets) - 1


def test_keep_one_leaves_one_of_each_class(documents):
    texts = near_copies(6, 200, 2, 6) + ["alone in the world of words here", None, None]
    ids = [5, 3, 4, 9, 8, 7, 1, None, 20]
    frame = documents(texts, ids=ids)
    kept = jaccard_join.keep_one(frame.unionByName(frame.where("doc_id = 1")))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 20] and kept.columns == frame.columns


def test_empty_table(documents):
    assert jaccard_join.op10_jaccard(documents(["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (10, 11), (5, 5)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert got == root and F is not None
