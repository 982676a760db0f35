"""BPE encoder against the tokenizers library; exact round trip."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from conftest import SF_SMALL
from ragloom.llm import op1_bpe as B


@pytest.fixture(scope="module")
def model():
    with open(B.vocabulary_path(), encoding="utf-8") as fh:
        return B.BpeModel(fh.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(B.vocabulary_path())


def test_random_texts(model, library):
    rnd = random.Random(11)
    alphabet = "aab bc  the'sT'll\n\t\r\x1c\x1f\x85\xa0 éß漢字😀१२ⅷ'ré.,!?<|endoftext|>0123 　​́ſK"
    for _ in range(4000):
        x = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25)))
        if rnd.random() < .2:
            x += "<|endoftext|>" + x[:5]
        if rnd.random() < .3:
            x = rnd.choice(["a", "ab", "th", "=", " ", "\n", "0", "'"]) * rnd.randint(1, 70) + x
        ids = library.encode(x, add_special_tokens=False).ids
        assert model.encode(x) == ids, x
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_very_long_words(model, library):
    for x in ("a" * 20_000, "ab" * 9_000 + "é" * 500, "=" * 5_000, " " * 3_000 + "x", "<|endoftext|>" * 50):
        assert model.encode(x) == library.encode(x, add_special_tokens=False).ids


def test_every_token_encodes_to_itself_or_is_unreachable(model, library):
    for i in range(0, 50_000, 97):
        text = model.token_bytes[i].decode("utf-8", "ignore")
        if text.encode() == model.token_bytes[i]:
            assert model.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_query_matches_the_library(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in B.op1_bpe_round_trip(spark, SF_SMALL).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        got = rows[d["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert got["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_defined_cases(spark):
    voc = B.Vocabulary.load(spark, B.vocabulary_path())
    df = spark.createDataFrame([(None, "x", 1), ("", "y", 2), ("twice", "z", 3), ("twice", "z", 3)],
                               "text string, ids string, extra int")
    enc = B.encode(df, voc, decoded_col="back")
    rows = enc.collect()
    assert enc.columns == ["text", "extra", "ids", "back"]
    assert sorted((r["back"], len(r["ids"])) for r in rows)[:2] == [("", 0), ("", 0)]
    assert rows[2]["ids"] == rows[3]["ids"]
    dec = B.decode(enc, voc, text_col="text").collect()
    assert [r["text"] for r in dec] == [r["back"] for r in rows]
    assert B.encode(df.limit(0), voc).count() == 0
    nulls = spark.createDataFrame([(None,)], "ids array<int>")
    assert B.decode(nulls, voc).first()["decoded"] is None
