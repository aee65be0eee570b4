import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from quizloom.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def reference(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_every_code_point(own, reference):
    for start in range(0, 0x110000, 4096):
        points = [chr(c) for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000]
        for text in (" ".join(points), "a".join(points)):
            assert own.encode(text).tolist() == reference.encode_ordinary(text), hex(start)


def test_random_texts(own, reference):
    rng = random.Random(3)
    letters = ["a", "b", " ", " ", "\n", "\t", "'s", "'ll", "é", "7", "!!", " ", "\x1c", "漢", "🙂", "the", "ing"]
    for _ in range(2000):
        text = "".join(rng.choices(letters, k=rng.randrange(60)))
        assert own.encode(text).tolist() == reference.encode_ordinary(text), repr(text)


def test_long_pieces_and_slices(own, reference, monkeypatch):
    rng = random.Random(4)
    for text in ("a" * 5000, "".join(rng.choices("abcdefgh", k=20_000)), "=" * 3000, " " * 999, "\n " * 500):
        assert own.encode(text).tolist() == reference.encode_ordinary(text)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    monkeypatch.setattr(own._cache, "_limit", 40)
    text = " ".join("".join(rng.choices("abcdéf \n", k=9)) for _ in range(3000))
    assert own.encode(text).tolist() == reference.encode_ordinary(text)


def test_query_on_edge_rows(spark, reference):
    texts = ["", None, "plain text", "plain text", "x " * 50_000, "é\n\n  z"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in queries.encoded_digests(df).collect()}
    for i, text in enumerate(texts):
        ids = reference.encode_ordinary(text or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert queries.encoded_digests(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir, reference):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids_sha256 for r in queries.op5_byte_bpe(spark, sf_dir).collect()}
    for row in rows:
        ids = reference.encode_ordinary(row.text or "")
        assert got[row.doc_id] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
