"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A long text is cut before it is encoded, only where no token can span the cut:
between a letter and a space that a letter follows, where the splitting pattern
always starts a new match. The pieces' ids, joined, equal those of the whole
text. Decoding joins the raw bytes of the ids, so text that is cut inside a
character also comes back byte for byte.

Defined cases: null and empty texts have no tokens, an empty table gives an
empty result, repeated rows are encoded one by one, other columns are kept
unless they have the name of an output.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .packed import tidy

RANKS = "byte_bpe_50k.tiktoken"
#: Texts above so many characters are encoded in pieces of about this length.
PIECE_CHARS = 16_384
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str | None = None):
    """The encoding of a rank file, built once a worker. None: the public 50k file of this machine."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts of about size characters, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, ranks_path: str | None = None) -> np.ndarray:
    enc = encoding(ranks_path)
    if not text:
        return np.empty(0, "<u4")
    if len(text) <= PIECE_CHARS:
        return np.array(enc.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), "<u4") for p in pieces(text)])


def decode(ids, ranks_path: str | None = None) -> bytes:
    return encoding(ranks_path).decode_bytes(list(map(int, ids)))


def encode_table(docs: DataFrame, ranks_path: str | None = None, column: str = "text") -> DataFrame:
    """docs with token_ids array<long>, n_tokens long; ids are those of the whole text."""
    kept = [c for c in docs.columns if c not in ("token_ids", "n_tokens")]
    schema = docs.select(*kept, F.lit(None).cast("array<long>").alias("token_ids"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches):
        for batch in batches:
            ids = [encode(t, ranks_path).astype("i8") for t in batch.column(column).to_pylist()]
            arrays = [*[batch.column(c) for c in kept], pa.array(ids, pa.list_(pa.int64())), pa.array([len(i) for i in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "token_ids", "n_tokens"])
        tidy()

    return bounded(docs).mapInArrow(run, schema)


def decode_table(tokens: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(.., token_ids) -> and decoded binary."""
    kept = [c for c in tokens.columns if c != "decoded"]
    schema = tokens.select(*kept, F.lit(None).cast("binary").alias("decoded")).schema

    def run(batches):
        for batch in batches:
            out = [decode(ids or [], ranks_path) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.binary())], names=[*kept, "decoded"])
        tidy()

    return bounded(tokens).mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Encode and decode every text, keeping digests in place of ids and bytes."""

    def run(batches):
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text, ranks_path)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(encoding(ranks_path).decode_bytes(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tidy()

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, lang, source) with n_tokens, the ids as little-endian unsigned 32-bit integers, and digests of both directions."""
    names = ["doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = encode(text, ranks_path)
                data = ids.tobytes()
                rows.append((len(ids), data, hashlib.sha256(data).hexdigest(), hashlib.sha256(encoding(ranks_path).decode_bytes(ids.tolist())).hexdigest()))
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:3]], *arrays], names=names)
        tidy()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return bounded(rows).mapInArrow(run, "doc_id long, lang string, source string, n_tokens long, token_ids binary, ids_sha256 string, decoded_sha256 string")


def op3_bpe(docs: DataFrame) -> DataFrame:
    """Contract query: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(docs)
