"""op6: the tokenizer itself over whole texts, and exact round trips."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm import fixtures as fx
from weftline.llm import bpe


def whole(text: str) -> list[int]:
    return bpe.coder(bpe.RANKS)[0].encode_ordinary(text)


def test_cut_texts_have_the_same_ids():
    rng = random.Random(2)
    alphabet = ["a", "B", "é", "ß", "7", "42", " ", "  ", "\n", "\t ", "'s", "'", "!", "…", "漢字", "🙂", " ", "x y", "<|endoftext|>"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))
        for long in (1, 5, 20):
            assert "".join(bpe.pieces(text, long)) == text
            ids = bpe.encode_one(text, long=long)
            assert ids.tolist() == whole(text), (text, long)
            assert bpe.decode_raw(ids) == text.encode()


def test_raw_bytes_of_any_ids(spark):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_256, 2000)
    enc = bpe.coder(bpe.RANKS)[0]
    assert bpe.decode_raw(ids) == b"".join(enc.decode_single_token_bytes(int(i)) for i in ids)
    half = whole("🙂")[:1]
    df = spark.createDataFrame([(1, half), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    got = {r["doc_id"]: (r["raw"], r["text"]) for r in bpe.decode(df).collect()}
    assert bytes(got[1][0]) == bpe.decode_raw(np.array(half)) and got[1][1] is None and got[2] == (None, None) and bytes(got[3][0]) == b"" and got[3][1] == ""


def test_table_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    enc = bpe.encode(docs)
    assert enc.where("not exact or n_tokens <> size(token_ids)").count() == 0 and enc.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in enc.limit(40).collect():
        assert r["token_ids"] == whole(text[r["doc_id"]])
    assert {r["doc_id"]: r["text"] for r in bpe.decode(enc).collect()} == text


def test_awkward_rows(spark):
    df = fx.awkward(spark)
    got = bpe.encode(df, keep=("lang", "id"))
    assert got.columns == ["doc_id", "lang", "id", "n_bytes", "n_tokens", "token_ids", "exact"] and got.count() == df.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["token_ids"] == [] and by[2]["exact"] and by[3]["token_ids"] is None and by[3]["exact"] is None and by[5]["exact"]
    assert bpe.encode(fx.empty(spark)).count() == 0


@pytest.mark.parametrize("ranks", ["/opt/tokenizers/byte_bpe_multi_50k.tiktoken"])
def test_other_vocabulary(ranks):
    ids = bpe.encode_one("Grüße aus München, 漢字 🙂", ranks)
    assert bpe.decode_raw(ids, ranks).decode() == "Grüße aus München, 漢字 🙂"
