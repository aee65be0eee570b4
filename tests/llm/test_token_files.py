import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quizloom.llm import parts, queries, token_files

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_as_the_library(library, monkeypatch):
    own = token_files.WordTokenizer(PATH)
    rng = random.Random(8)
    letters = ["Word", "über", "Été.", "it's", "I'LL,", "3.14", "x2", " ", "\n", "\t", "...", "%$", "é", "J̌",
             "ǅ", "ΣΑΣ", "漢字", "🙂", "<|endoftext|>", "<|EndOfText|>", "foo,", "\x1c", " ", "²", "'", "a.b", "KK"]
    texts = ["".join(rng.choice(["", " "]) + rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for text in texts:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    ids, counts = own.encode_column(pa.array([*texts, None]))
    assert counts.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in [*texts, ""]]
    monkeypatch.setattr(own, "_table", parts.ChunkTable(own._learn, 50, 1 << 20))
    for start in range(0, 1500, 10):
        again = own.encode_column(pa.array(texts[start:start + 10]))[0]
        assert again.tolist() == [i for t in texts[start:start + 10] for i in library.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("change", [
    {"normalizer": {"type": "NFC"}}, {"normalizer": None}, {"pre_tokenizer": {"type": "WhitespaceSplit"}},
])
def test_other_files_are_encoded_whole(change, new_path):
    with open(PATH, encoding="utf-8") as file:
        read = json.load(file) | change
    path = new_path("other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(read, file)
    own, other = token_files.WordTokenizer(path), Tokenizer.from_file(path)
    assert not own.by_blanks and token_files.WordTokenizer(PATH).by_blanks
    for text in ("Two Words, and É  more.", "", "a\nb c."):
        assert own.encode(text).tolist() == other.encode(text, add_special_tokens=False).ids


def test_rows_are_read_by_slot(spark, new_path, monkeypatch):
    df = spark.createDataFrame([(4, "a"), (4, "b c"), (5, "d"), (None, "e")], "doc_id long, text string").coalesce(1)
    folder = "file://" + new_path("tokens")
    token_files.store(spark, df, folder, "doc_id", "text", PATH, 2)
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    shards = [token_files.ShardReader(f"{folder}/shards", r.shard, r.width) for r in manifest]
    for shard in shards:
        assert shard.places().tolist() == list(range(len(shard.keys)))
        shard._index["fingerprints"] = shard._index["fingerprints"] + np.uint32(1)
    with pytest.raises(ValueError):
        [shard.places() for shard in shards]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(-2**62, 2**62, n))
        table = token_files.PerfectHash.build(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    table = token_files.PerfectHash(np.zeros(0, bool), np.zeros(0, np.int64), keys[:9])
    assert table.slots(keys[:9]).tolist() == list(range(9))


def expected(rows, library):
    start, out = 0, []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_on_edge_rows(spark, library, new_path):
    rows = [(None, "no key"), (None, "no key"), (-5, "x"), (1, ""), (2, None), (3, "twice"), (3, "twice"), (9, "long word " * 20_000)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, key string").orderBy("text")
    folder = "file://" + new_path("tokens")
    manifest = token_files.store(spark, df, folder, "doc_id", "text", PATH, 2, shard_bytes=8)
    assert manifest.count() > 2
    got = sorted(token_files.read_shards(manifest, f"{folder}/shards").collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == expected(rows, library)
    wanted = spark.createDataFrame([(k,) for k in (3, 9, -5, 77, None, -10**12)], "key long")
    found = sorted((r.key, len(r.ids)) for r in token_files.lookup(wanted, manifest, f"{folder}/shards").collect())
    sizes = {k: n for k, _, n, _ in expected(rows, library)}
    assert found == [(-5, sizes[-5]), (3, sizes[3]), (3, sizes[3]), (9, sizes[9])]


def test_empty_table(spark, new_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = "file://" + new_path("none")
    manifest = token_files.store(spark, df, folder, "doc_id", "text", PATH, 2)
    assert token_files.read_shards(manifest, f"{folder}/shards").count() == 0


def test_whole_table(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op10_token_files(spark, sf_dir).collect())
    assert got == sorted(expected(sorted((r.doc_id, r.text) for r in rows), library))
