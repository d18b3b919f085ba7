import hashlib
import random

import numpy as np

from seekloom.llm import bpe


def test_pieces_give_the_ids_of_the_whole_text():
    r = random.Random(2)
    words = ["the", "it's", "naïve", "日本", "x1y2", "  ", "\n\n", "'ll", "12345", "...", "émile", "\t"]
    text = " ".join(r.choice(words) for _ in range(30_000))
    assert len(list(bpe.pieces(text))) > 3 and "".join(bpe.pieces(text)) == text
    assert bpe.encode(text).tolist() == bpe.encoding().encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text.encode()


def test_table_forms(documents):
    texts = [None, "", "Hello <|endoftext|> wörld 𝄞", "a" * 50_000, "x y " * 9000]
    got = {r.doc_id: r for r in bpe.op3_bpe(documents(texts, extra=True)).collect()}
    for k, t in enumerate(texts):
        ids = bpe.encoding().encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    frame = bpe.decode_table(bpe.encode_table(documents(texts, extra=True)))
    assert {r.doc_id: bytes(r.decoded) for r in frame.collect()} == {k: (t or "").encode() for k, t in enumerate(texts)}
    assert bpe.op3_bpe(documents(["x"]).limit(0)).count() == 0
