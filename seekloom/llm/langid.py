"""Language identification by nearest centroid over TF-IDF character n-grams.

Texts become vectors of hashed letter n-grams (1 to 3 code points, words marked by
one space), term counts dampened by log, weighted by inverse document frequency
and scaled to length one. Every learned language has several centroids, found by
spherical k-means within the language; a text takes the language of the centroid
of highest cosine. It is rejected if its distance to that centroid exceeds the
largest usual distance of the centroid's training texts of about its length; where
a language has few texts of a length, its longer ones thinned to that length count,
and where it has few texts at all, those of all languages. Fewer than ENOUGH rows
in all are no ground to reject.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS in all,
shared evenly among the languages, smallest hashes of doc_id first) and has a
fixed size per language; predictions read every whole text.

Defined cases: a null text or one without letters is ``und`` with score 0 and
rejected; without any labelled row every text is ``und``; equal cosines go to the
language that sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, bucket_of
from .packed import tidy

#: Bound of the labelled rows the model is fitted on.
SAMPLE_ROWS = 3_000
DIMENSIONS = 8_192
CENTROIDS = 3
#: A text is rejected beyond this quantile of training distances, widened by MARGIN.
QUANTILE = 0.995
MARGIN = 0.15
#: Texts are grouped by length for the rejection distance: bounds in n-grams.
LENGTHS = (30, 100, 300, 1_000)
#: Training distances that a limit is read from.
ENOUGH = 20
#: Texts are hashed in groups of about so many characters.
GROUP_CHARS = 200_000

_fold: np.ndarray | None = None
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def _folding() -> np.ndarray:
    """Code point -> lower-case letter, or a space for anything that is no letter."""
    global _fold
    if _fold is None:
        fold = np.full(0x110000, 32, np.uint32)
        for k in range(0x30000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                fold[k] = ord(low[0])
        _fold = fold
    return _fold


def counts(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """n-gram counts of each text, one row each."""
    lengths = [len(t or "") + 3 for t in texts]
    joined = "".join("  " + (t or "") + " " for t in texts)
    c = _folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = c != 32
    # runs of spaces count as one
    keep = letter | np.concatenate([[True], letter[:-1]])
    of = np.repeat(np.arange(len(texts)), lengths)
    c, of, letter = c[keep], of[keep], letter[keep]
    h1 = c * _A
    h2 = h1[:-1] ^ (c[1:] * _B)
    h3 = h2[:-1] ^ (c[2:] * _C)
    mask = np.uint32(dimensions - 1)
    flat = []
    for n, h in ((1, h1), (2, h2), (3, h3)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        h ^= h >> np.uint32(13)
        ok = (of[n - 1 :] == of[: len(h)]) & (letter[: len(h)] if n == 1 else (letter[1 : 1 + len(h)] | letter[: len(h)]))
        flat.append((of[: len(h)].astype(np.int64) * dimensions + (h & mask))[ok])
    return np.bincount(np.concatenate(flat), minlength=len(texts) * dimensions).astype(np.float32).reshape(len(texts), dimensions)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.maximum(norm, 1e-12)


class Model:
    """Languages, weights and centroids; a few hundred kilobytes."""

    def __init__(self, tf: np.ndarray, langs: list[str], centroids: int = CENTROIDS):
        self.langs = sorted(set(langs))
        grams = tf.sum(1)
        df = np.count_nonzero(tf, 0)
        self.idf = np.log((1 + len(tf)) / (1 + df)).astype(np.float32) + 1
        rows = np.log1p(tf)
        rows *= self.idf
        rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-12)[:, None]
        label = np.array([self.langs.index(x) for x in langs])
        centers, owner, limits, thinned = [], [], [], []
        for k in range(len(self.langs)):
            own = rows[label == k]
            found = self._cluster(own, min(centroids, len(own)))
            near = (own @ found.T).max(1)
            size = np.searchsorted(LENGTHS, grams[label == k])
            overall = 1 - near
            limit = [min(0.995, np.quantile(d, QUANTILE) + MARGIN) if len(d := overall[size == s]) >= ENOUGH else np.nan for s in range(len(LENGTHS) + 1)]
            thinned.append([self._thinned(tf[label == k], own, found, s) if np.isnan(limit[s]) else np.zeros(0) for s in range(len(LENGTHS) + 1)])
            centers.append(found)
            owner += [k] * len(found)
            limits.append(limit)
        for s in range(len(LENGTHS) + 1):
            pooled = np.concatenate([x[s] for x in thinned]) if thinned else np.zeros(0)
            for limit, own in zip(limits, thinned, strict=True):
                if np.isnan(limit[s]):
                    d = own[s] if len(own[s]) >= ENOUGH else pooled
                    limit[s] = (q := np.quantile(d, QUANTILE)) + MARGIN * (1 - q) if len(d) >= ENOUGH else limit[s - 1] if s else 0.995
        limits = [limits[k] for k in owner]
        self.centers = np.concatenate(centers).astype(np.float32) if centers else np.zeros((0, tf.shape[1]), np.float32)
        self.owner, self.limits = np.array(owner, int), np.array(limits)

    def _thinned(self, tf: np.ndarray, rows: np.ndarray, centers: np.ndarray, size: int) -> np.ndarray:
        """Distances of texts of this length or longer, thinned to the length's lower bound, to centroids that leave them out."""
        low = LENGTHS[size - 1] if size else LENGTHS[0] // 3
        nearest = np.argmax(rows @ centers.T, 1)
        sums = np.stack([rows[nearest == j].sum(0) for j in range(len(centers))])
        random, out = np.random.default_rng(size), []
        for k in np.flatnonzero(tf.sum(1) > low):
            left = sums[nearest[k]] - rows[k]
            if (norm := np.sqrt(left @ left)) > 1e-6:
                few = np.log1p(random.binomial(tf[k].astype(int), low / tf[k].sum())) * self.idf
                out.append(1 - few @ left / norm / max(np.sqrt(few @ few), 1e-12))
        return np.array(out)

    @staticmethod
    def _cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
        """Spherical k-means, started from rows far from each other; no randomness."""
        centers = unit(rows.mean(0, keepdims=True))
        while len(centers) < k:
            centers = np.concatenate([centers, rows[[np.argmin((rows @ centers.T).max(1))]]])
        for _ in range(rounds):
            nearest = np.argmax(rows @ centers.T, 1)
            centers = unit(np.stack([rows[nearest == j].mean(0) if (nearest == j).any() else centers[j] for j in range(k)]))
        return centers

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether it is rejected, for each text."""
        tf = counts(texts, len(self.idf))
        grams = tf.sum(1)
        if not len(self.centers):
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = unit(np.log1p(tf) * self.idf) @ self.centers.T
        best = np.argmax(cosine, 1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0, 1)
        rejected = (1 - score > self.limits[best, np.searchsorted(LENGTHS, grams)]) | (grams == 0)
        langs = ["und" if not g else self.langs[self.owner[b]] for g, b in zip(grams, best, strict=True)]
        return langs, np.where(grams > 0, score, 0.0), rejected


def _groups(texts: list[str | None]):
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP_CHARS or k - at >= 127:
            yield texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of (doc_id, text, lang) rows; null langs and texts teach nothing."""
    rows = labelled.select("doc_id", "lang", "text").where("lang is not null and text is not null")
    found = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(sample_rows).collect()}
    if not found:
        return Model(np.zeros((0, DIMENSIONS), np.float32), [])
    each = max(1, sample_rows // len(found))
    # 62 bits of the hash as a number from 0 to 1; a little more than the share, so that enough rows are below it
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("langid")), 2) / F.lit(float(2**62))
    share = F.lit(1.25 * each + 20) / F.element_at(F.create_map(*[F.lit(x) for k, v in found.items() for x in (k, float(v))]), F.col("lang"))
    picked = rows.withColumn("u", u).where(F.col("lang").isin(list(found)) & ((F.col("u") <= share) | (share >= 1)))

    def vectors(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = [v.tobytes() for g in _groups(texts) for v in np.minimum(counts(g), 65535).astype(np.uint16)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("u"), pa.array(rows, pa.binary())], names=["lang", "u", "v"])

    def learn(batches):
        taken: dict[str, list[bytes]] = {k: [] for k in found}
        for batch in batches:
            for lang, v in zip(batch.column("lang").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if len(taken[lang]) < each:
                    taken[lang].append(v)
        langs = [k for k in sorted(taken) for _ in taken[k]]
        tf = np.stack([np.frombuffer(v, np.uint16) for k in sorted(taken) for v in taken[k]])
        taken.clear()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(tf, langs))], pa.binary())], names=["model"])
        tidy()

    # the bounded sample meets in one task, which returns the model alone
    sample = bounded(picked).mapInArrow(vectors, "lang string, u double, v binary").orderBy("u", "lang", "v").limit(int(1.25 * sample_rows) + 20 * len(found))
    return pickle.loads(sample.mapInArrow(learn, "model binary").first().model)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected (those names are replaced)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score, rejected = [], [], []
            for group in _groups(texts):
                a, b, c = shared.value.predict(group)
                lang += a
                score += b.tolist()
                rejected += c.tolist()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*kept, "lang_pred", "score", "rejected"])
        tidy()

    return bounded(docs).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return bucket_of(doc_id, 3) == 1


def op6_langid(docs: DataFrame) -> DataFrame:
    """Contract query: doc_id, held_out, lang_pred, score, rejected."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
