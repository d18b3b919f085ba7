import pytest

from seekloom.llm import mixing


def fill(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    """Water-filling by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), budget * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_taken_words(documents):
    texts = [" ".join(["w"] * (1 + k * 7 % 40)) for k in range(900)] + [None, "", " \t"]
    sources = [["a", "b", "é", None, "z"][k % 17 % 5] for k in range(len(texts))]
    frame = documents(texts, sources=sources, extra=True)
    rows = mixing.op9_mix(frame).collect()
    assert len(rows) == len(texts) and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op9_mix(frame).collect()))
    sizes, taken, targets = {}, {}, {}
    for r in rows:
        s = sources[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        targets[s] = r.target
        assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.taken <= 2 * r.size
    want = fill(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 40
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    rows = mixed.collect()
    assert taken == {s: sum(len((r.text or "").split()) for r in rows if r.source == s) for s in sizes}


def test_small_tables(documents):
    assert mixing.op9_mix(documents(["x"]).limit(0)).count() == 0
    assert [r.taken for r in mixing.op9_mix(documents([None, ""])).collect()] == [0, 0]
    one = mixing.op9_mix(documents(["a b c d"], sources=["only"])).first()
    assert one.target == 6 and one.taken in (4, 8)
    twice = mixing.op9_mix(documents(["a b", "a b"], ids=[1, 1], sources=["s", "s"])).collect()
    assert len(twice) == 2 and sum(r.taken for r in twice) == 6


def test_no_python_in_the_plan(documents):
    plan = mixing.op9_mix(documents(["a b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
