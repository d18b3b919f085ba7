"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark. Each task reduces its texts' word pairs to sorted hash
arrays and sends them by hash range as packed blocks; each range is merged once,
written to the shared folder as a sorted array of pair hashes with counts, and
yields partial statistics of contexts (total, and how many pairs were seen once,
twice, more often) and of words (count, and in how many different contexts);
these are merged by hash range likewise. The ranges grow in number with the bytes
of text, so a task's memory does not grow with the corpus, and every text of the
training part counts.

Workers map the finished arrays into memory and look all words of a group of
texts up at once, in sorted order. With D the three discounts from counts of
counts, N1+ numbers of different neighbours and u = 1 / (V + 1) the uniform
share of a word never seen:

    p(w | v) = max(0, c(v w) - D(c(v w))) / c(v .) + gamma(v) * p(w)
    p(w)     = max(0, N1+(. w) - D'(N1+(. w))) / N1+(. .) + gamma' * u

A text is a line of words and one end; its first word's context is the start.

Defined cases: a null text is empty and scores its end only; an unseen context
leaves p(w); with no training text every probability is 1 / (V + 1) = 1; repeated
rows count and score one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, bucket_of, new_path, save
from .packed import mapped, pack, slices, store, tidy, unpack
from .shingles import mix64, unmix64, words

#: Texts are counted and scored in groups of about so many characters.
GROUP_CHARS = 2_000_000
#: Pairs that a task holds before it packs them.
HELD_PAIRS = 3_000_000
#: Bytes of text for each range of hashes, and ranges at least; a power of two is taken.
RANGE_BYTES = 16_000_000
LEAST_PARTS = 16
_START = mix64(np.array([0x5354415254], np.uint64))[0]
_END = mix64(np.array([0x454E44], np.uint64))[0]
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_K2_INVERSE = np.uint64(pow(int(_K2), -1, 2**64))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(before * _K1 + mix64(word * _K2))


def second_words(keys: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The word of each pair from its key and its first word: the key is a bijection of it, so it need not travel along."""
    return unmix64(unmix64(keys) - before * _K1) * _K2_INVERSE


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts with their ends, the hash before each, and tokens per text."""
    hashes, n = words([(t or "").encode().lower() for t in texts])
    n = np.asarray(n, np.int64)
    ends = np.cumsum(n + 1) - 1
    seq = np.empty(len(hashes) + len(texts), np.uint64)
    word = np.ones(len(seq), bool)
    word[ends] = False
    seq[word] = hashes
    seq[ends] = _END
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = _START
    return seq, before, n + 1


def _text_groups(texts: list[str | None]):
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP_CHARS:
            yield texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[first], *[np.add.reduceat(v[order].astype(np.int64), first) if len(keys) else v.astype(np.int64) for v in values]


def _pairs(train: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        held, size = [], 0

        def flush():
            word, before = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            keys = pair_keys(before, word)
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            n = np.diff(np.append(first, len(keys))).astype(np.uint32)
            keys, before = keys[first], before[order[first]]
            for part, s in slices(keys, bits):
                known, place = np.unique(before[s], return_inverse=True)
                yield part, pack(keys_sorted=keys[s], before_sorted=known, place=place.astype(np.uint32), n=n[s])

        def rows():
            out = list(flush())
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["part", "data"])

        for batch in batches:
            for group in _text_groups(batch.column("text").to_pylist()):
                word, before, _ = tokens(group)
                held.append((word, before))
                size += len(word)
                if size >= HELD_PAIRS:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()
        tidy()

    return train.select("text").mapInArrow(run, "part int, data binary")


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _merge_pairs(folder: str, bits: int):
    """One range of pairs: store it, and give the partial statistics of contexts and words."""

    def run(key, table):
        part = key[0].as_py()
        blocks = [unpack(d.as_py()) for d in table.column("data")]
        keys = np.concatenate([b["keys_sorted"] for b in blocks])
        before = np.concatenate([b["before_sorted"][b["place"]] for b in blocks])
        n = np.concatenate([b["n"] for b in blocks])
        blocks.clear()
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.add.reduceat(n[order].astype(np.int64), first)
        keys, before = keys[first], before[order[first]]
        word = second_words(keys, before)
        store(folder, f"pair-{part}.keys", keys)
        # one byte a count; the few larger ones stand apart
        store(folder, f"pair-{part}.small", np.minimum(n, 255).astype(np.uint8))
        big = n >= 255
        store(folder, f"pair-{part}.bigkeys", keys[big])
        store(folder, f"pair-{part}.big", n[big])
        out = [("stat", part, pickle.dumps(_counts_of_counts(n)))]
        v, total, one, two, more = _summed(before, n, n == 1, n == 2, n >= 3)
        for p, s in slices(v, bits):
            out.append(("context", p, pack(key_sorted=v[s], total=total[s], one=one[s].astype(np.uint32), two=two[s].astype(np.uint32), more=more[s].astype(np.uint32))))
        w, count, types = _summed(word, n, np.ones(len(n), np.int64))
        for p, s in slices(w, bits):
            out.append(("word", p, pack(key_sorted=w[s], count=count[s], types=types[s].astype(np.uint32))))
        tidy()
        return pa.table({"kind": pa.array([x[0] for x in out]), "part": pa.array([x[1] for x in out], pa.int32()), "data": pa.array([x[2] for x in out], pa.binary())})

    return run


def _merge_stats(folder: str):
    """One range of contexts or words: store it; of words, give what the discounts need."""

    def run(key, table):
        kind, part = key[0].as_py(), key[1].as_py()
        blocks = [unpack(d.as_py()) for d in table.column("data")]
        names = [x for x in blocks[0] if x != "key_sorted"]
        keys, *values = _summed(np.concatenate([b["key_sorted"] for b in blocks]), *[np.concatenate([b[x] for b in blocks]) for x in names])
        store(folder, f"{kind}-{part}.keys", keys)
        for name, v in zip(names, values, strict=True):
            store(folder, f"{kind}-{part}.{name}", v if name in ("total", "count") else v.astype(np.uint32))
        stat = {}
        if kind == "word":
            count, types = values
            stat = {"of": _counts_of_counts(types), "types": int(types.sum()), "v": len(keys), "n": int(count.sum()), "more": int((types >= 3).sum())}
        return pa.table({"stat": pa.array([pickle.dumps(stat)], pa.binary())})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D(1), D(2), D(3 and more) after Chen and Goodman, kept within what a count can give."""
    if not n1 or not n2:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([min(max(x, 0.01), k - 0.01) for k, x in zip((1, 2, 3), d, strict=True)])


class Model:
    """Where the arrays are, and the few global numbers. Workers map the arrays on first use."""

    def __init__(self, folder: str, bits: int, pair_counts: list[int], word_stats: list[dict]):
        self.folder, self.bits = folder, bits
        total = lambda key: sum(s[key] for s in word_stats)
        self.n, self.v, self.types = total("n"), total("v"), total("types")
        of = [sum(s["of"][k] for s in word_stats) for k in range(4)]
        self.d, self.d1 = discounts(*pair_counts), discounts(*of)
        more = total("more")
        self.gamma1 = float(self.d1 @ np.array([of[0], of[1], more])) / self.types if self.types else 1.0

    def _array(self, name: str, kind: str) -> np.ndarray:
        return mapped(self.folder, name, kind)

    def look_up(self, kind: str, keys: np.ndarray, fields: dict[str, str]) -> list[np.ndarray]:
        """Values of sorted distinct keys, 0 where absent."""
        out = [np.zeros(len(keys), np.int64) for _ in fields]
        for part, s in slices(keys, self.bits):
            stored = self._array(f"{kind}-{part}.keys", "u8")
            if not len(stored):
                continue
            at = np.minimum(np.searchsorted(stored, keys[s]), len(stored) - 1)
            hit = stored[at] == keys[s]
            for o, (name, t) in zip(out, fields.items(), strict=True):
                if name == "small":
                    value = self._array(f"{kind}-{part}.small", "u1")[at].astype(np.int64)
                    if (large := hit & (value == 255)).any():
                        big = self._array(f"{kind}-{part}.bigkeys", "u8")
                        value[large] = self._array(f"{kind}-{part}.big", "i8")[np.searchsorted(big, keys[s][large])]
                else:
                    value = self._array(f"{kind}-{part}.{name}", t)[at].astype(np.int64)
                o[s] = np.where(hit, value, 0)
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        word, before, lengths = tokens(texts)
        of = np.repeat(np.arange(len(texts)), lengths)
        w, w_at = np.unique(word, return_inverse=True)
        count, types = self.look_up("word", w, {"count": "i8", "types": "u4"})
        v, v_at = np.unique(before, return_inverse=True)
        total, one, two, more = self.look_up("context", v, {"total": "i8", "one": "u4", "two": "u4", "more": "u4"})
        k, k_at = np.unique(pair_keys(before, word), return_inverse=True)
        (pair,) = self.look_up("pair", k, {"small": "u1"})
        uniform = 1.0 / (self.v + 1)
        lower = self.gamma1 * uniform + (np.maximum(types - self.d1[np.clip(types, 1, 3) - 1], 0) / self.types if self.types else np.zeros(len(w)))
        known = total > 0
        gamma = np.where(known, (self.d[0] * one + self.d[1] * two + self.d[2] * more) / np.maximum(total, 1), 1.0)
        upper = np.maximum(pair - self.d[np.clip(pair, 1, 3) - 1], 0)[k_at] / np.maximum(total, 1)[v_at]
        p = np.where(known[v_at], upper, 0.0) + gamma[v_at] * lower[w_at]
        add = lambda x: np.bincount(of, x, len(texts))
        base = np.log10((count + 1) / (self.n + 1 * (self.v + 1)))
        return lengths, add((count > 0)[w_at]).astype(np.int64), add(base[w_at]), add(np.log10(p))


def train(docs: DataFrame) -> Model:
    """Count a model over every text of docs."""
    spark = bounded(docs).sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = math.ceil(math.log2(max(LEAST_PARTS, size / RANGE_BYTES)))
    folder = new_path(spark, "lm")
    pairs = _pairs(docs, bits)
    merged = save(pairs.groupBy("part").applyInArrow(_merge_pairs(folder, bits), "kind string, part int, data binary"), "lm-stats", codec="none")
    of = [0, 0, 0, 0]
    for row in merged.where("kind = 'stat'").collect():  # one short row a range
        of = [a + b for a, b in zip(of, pickle.loads(row.data), strict=True)]
    stats = merged.where("kind != 'stat'").groupBy("kind", "part").applyInArrow(_merge_stats(folder), "stat binary")
    word_stats = [s for r in stats.collect() if (s := pickle.loads(r.stat))]  # likewise
    return Model(folder, bits, of, word_stats)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens, n_known, base_score and score (those names are replaced)."""
    added = ["n_tokens", "n_known", "base_score", "score"]
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept, *[F.lit(0).cast("long").alias(c) for c in added[:2]], *[F.lit(0.0).alias(c) for c in added[2:]]).schema

    def run(batches):
        for batch in batches:
            found = [model.score(g) for g in _text_groups(batch.column("text").to_pylist())]
            arrays = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)] if found else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *arrays], names=[*kept, *added])
        tidy()

    return bounded(docs).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return bucket_of(doc_id, 7) == 2


def op8_lm(docs: DataFrame) -> DataFrame:
    """Contract query: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
