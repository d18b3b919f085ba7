"""Token blobs: a flag byte (1: zstd), then tagged runs of length-prefixed tokens."""

from __future__ import annotations

import html as html_lib

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = b"\xff\xff\xff\xff"
#: Element of each tag code.
ELEMENTS = ("h1", "h2", "h3", "h4", "h5", "h6", "span", "p", "a", "li", "label", "title", "td", "th")


def decode_runs(blob: bytes | None, dictionary: dict[int, str] | None = None) -> list[tuple[str, str]]:
    """[(element, text)]. A token of at most 3 bytes is literal, a longer one a little-endian dictionary id; damage ends the list."""
    if not blob:
        return []
    body = blob[1:]
    if blob[0] == 1:
        try:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError:
            return []
    out, at = [], 0
    while at < len(body):
        code, at, words = body[at], at + 1, []
        while at < len(body) and body[at : at + 4] != END:
            n = body[at]
            token = body[at + 1 : at + 1 + n]
            at += 1 + n
            if len(token) < n:
                break
            words.append(token.decode("utf-8", "replace") if n <= 3 else (dictionary or {}).get(int.from_bytes(token, "little"), ""))
        at += 4
        if code < len(ELEMENTS):
            out.append((ELEMENTS[code], " ".join(w for w in words if w)))
    return out


def encode_runs(runs: list[tuple[str, list[str | int]]], compress: bool = True) -> bytes:
    """The inverse, for ids of at least four bytes and literals of at most three."""
    body = b""
    for element, words in runs:
        body += bytes([ELEMENTS.index(element)])
        for w in words:
            token = w.encode() if isinstance(w, str) else w.to_bytes(max(4, (w.bit_length() + 7) // 8), "little")
            body += bytes([len(token)]) + token
        body += END
    return b"\x01" + zstandard.ZstdCompressor(level=3).compress(body) if compress else b"\x00" + body


def render(runs: list[tuple[str, str]]) -> str:
    return "".join(f"<{e}>{html_lib.escape(t)}</{e}>" for e, t in runs)


def token_id(word: str) -> int:
    """The dictionary id of a word: the 64-bit XXH64 that Spark's xxhash64() gives."""
    return xxhash.xxh64_intdigest(word.encode(), seed=42)


def encode_words(words: list[str]) -> list[str | int]:
    """Words of at most three bytes as literals, longer ones as ids."""
    return [w if len(w.encode()) <= 3 else token_id(w) for w in words]


def dictionary(words: DataFrame, word: str = "word") -> DataFrame:
    """(word) -> (token_id, word) of the different words longer than three bytes."""
    return words.select(F.col(word).alias("word")).where(F.octet_length("word") > 3).distinct().select(F.xxhash64("word").alias("token_id"), "word")


def decode_tokens(blobs: DataFrame) -> DataFrame:
    """(id, value) -> (id, place, word, token_id): every token in order, ids still to be looked up."""

    def run(batches):
        for batch in batches:
            out = {"id": [], "place": [], "word": [], "token_id": []}
            for key, value in zip(batch["id"], batch["value"], strict=True):
                for place, (word, number) in enumerate(_tokens(bytes(value) if value is not None else None)):
                    for name, x in zip(out, (key, place, word, number), strict=True):
                        out[name].append(x)
            yield pd.DataFrame({"id": pd.Series(out["id"], dtype="int64"), "place": pd.Series(out["place"], dtype="int64"), "word": pd.Series(out["word"], dtype="object"), "token_id": pd.Series(out["token_id"], dtype="Int64")})

    return blobs.select("id", "value").mapInPandas(run, "id long, place long, word string, token_id long")


def texts(blobs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, value) and a dictionary table -> (id, text): words joined by spaces; ids the dictionary lacks leave nothing."""
    found = decode_tokens(blobs).join(known.withColumnRenamed("word", "_known"), "token_id", "left").withColumn("w", F.coalesce("word", "_known"))
    joined = found.where("w is not null").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]).alias("ws"))  # the words of one text
    return blobs.select("id").join(joined, "id", "left").select("id", F.coalesce(F.array_join("ws", " "), F.lit("")).alias("text"))


def _tokens(blob: bytes | None):
    """(literal, None) or (None, signed id) of every token of every run; damage ends the list."""
    body = (blob or b"")[1:]
    if blob and blob[0] == 1:
        try:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError:
            return
    at = 0
    while at < len(body):
        at += 1
        while at < len(body) and body[at : at + 4] != END:
            n = body[at]
            token = body[at + 1 : at + 1 + n]
            at += 1 + n
            if len(token) < n:
                return
            yield (token.decode("utf-8", "replace"), None) if n <= 3 else (None, int.from_bytes(token[:8].ljust(8, b"\0"), "little", signed=True))
        at += 4


def decode_table(blobs: DataFrame, dictionary: dict[int, str] | None = None) -> DataFrame:
    """(id, value) -> (id, text, html)."""
    shared = blobs.sparkSession.sparkContext.broadcast(dictionary or {})

    def run(batches):
        for batch in batches:
            runs = [decode_runs(bytes(v) if v is not None else None, shared.value) for v in batch["value"]]
            yield pd.DataFrame({"id": batch["id"], "text": ["\n".join(t for _, t in r) for r in runs], "html": [render(r) for r in runs]})

    return blobs.select("id", "value").mapInPandas(run, "id long, text string, html string")
