import hashlib
import itertools
import json
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quizloom.llm import automaton, parts, queries

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return automaton.codec(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def random_merges(rng, letters, count):
    """Labels and merges of unions that differ."""
    labels = {i: bytes([c]) for i, c in enumerate(letters)}
    merges = []
    while len(merges) < count:
        left, right = rng.choice(list(labels)), rng.choice(list(labels))
        union = labels[left] + labels[right]
        if union in labels.values() or len(union) > 6:
            continue
        labels[len(labels)] = union
        merges.append((left, right, len(labels) - 1))
    return labels, merges


def whole_automaton(labels, merges):
    """The construction written out: every state with all its arcs."""
    arcs = {0: {t: 0 for t, label in labels.items() if len(label) == 1}}
    for left, right, union in merges:
        copies = {}
        for state in list(arcs):
            to = arcs[state].get(left)
            if to is None or right not in arcs[to]:
                continue
            if to not in copies:
                copies[to] = len(arcs)
                arcs[copies[to]] = {t: s for t, s in arcs[to].items() if t != right}
        changes = [(s, own[left]) for s, own in arcs.items() if own.get(left) in copies]
        ends = {to: arcs[to][right] for to in copies}
        for state, to in changes:
            arcs[state][union] = ends[to]
            arcs[state][left] = copies[to]
    return arcs


def merged(text, labels, merges):
    ids = {label: i for i, label in labels.items()}
    tokens = [ids[bytes([b])] for b in text]
    for left, right, union in merges:
        at, out = 0, []
        while at < len(tokens):
            if tokens[at:at + 2] == [left, right]:
                out.append(union)
                at += 2
            else:
                out.append(tokens[at])
                at += 1
        tokens = out
    return tokens


@pytest.mark.parametrize("seed", range(12))
def test_gadgets_are_those_of_the_whole_automaton(seed):
    rng = random.Random(seed)
    labels, merges = random_merges(rng, b"ab" if seed % 2 else b"abc", 8)
    compiled, whole = automaton.Automaton(labels, merges), whole_automaton(labels, merges)
    states = {automaton.START: 0}
    queue = [automaton.START]
    while queue:  # states that are reached, by the token that leads there
        state = queue.pop()
        allowed = {t for t in labels if t in whole[states[state]]}
        assert {t for t in labels if compiled.arc(state, t)} & allowed == allowed
        used = {t for t in labels if compiled.arc(state, t)} - allowed
        assert not any(t in arcs for t in used for arcs in whole.values())  # tokens that no merge can make
        both = np.array([(state, t) for t in labels], np.int64)
        assert compiled.arcs(both[:, 0], both[:, 1]).tolist() == [compiled.arc(state, t) for t in labels]
        for token in allowed:
            if token not in states:
                states[token] = whole[states[state]][token]
                queue.append(token)
            assert states[token] == whole[states[state]][token]
    for size in range(1, 8):
        words = [bytes(w) for w in itertools.product(labels[0] + labels[1], repeat=size)]
        found, counts = compiled.spell(words)
        ends = np.concatenate([[0], np.cumsum(counts)])
        for i, word in enumerate(words):
            assert found[ends[i]:ends[i + 1]].tolist() == merged(word, labels, merges)
            assert compiled._spell_one(word) == merged(word, labels, merges)


def test_every_code_point(own, library):
    for start in range(0, 0x110000, 4096):
        points = [chr(c) for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000]
        for text in (" ".join(points), "a".join(points), " a ".join(points)):
            assert own.encode(text) == ids_of(library, text), hex(start)


def test_random_texts(own, library):
    rng = random.Random(3)
    letters = ["a", "b", " ", " ", "\n", "\t", "'s", "'ll", "é", "7", "!!", "\x1c", "漢", "🙂", "the", "ing", "  ", "​",
               "<|endoftext|>", "<|endo", "\xa0", ".", ",", "a. ", "b.,", "\x1f", "\x1f1"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)] + [None, ""]
    ids, counts = own.encode_column(pa.array(texts))
    ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
    decoded = own.decode_column(ids, counts).to_pylist()
    for i, text in enumerate(texts):
        mine = ids[ends[i]:ends[i + 1]].tolist()
        assert mine == ids_of(library, text or ""), repr(text)
        assert decoded[i] == library.decode(mine, skip_special_tokens=False) == (text or "")


def test_ids_that_are_no_text(own, library):
    rng = random.Random(4)
    lists = [[rng.randrange(50257) for _ in range(rng.randrange(9))] for _ in range(500)]
    flat = np.array([i for one in lists for i in one], np.int64)
    decoded = own.decode_column(flat, np.array(list(map(len, lists)))).to_pylist()
    assert decoded == [library.decode(one, skip_special_tokens=False) for one in lists]
    assert own.decode_column(np.array([-1, 99999, 64]), np.array([3, 0])).to_pylist() == ["a", ""]


def test_long_words_and_small_tables(own, library, monkeypatch):
    rng = random.Random(4)
    for text in ("a" * 5000, "".join(rng.choices("abcdefgh", k=20_000)), "=" * 3000, " " * 999, "\n " * 500, "=-" * 4000):
        assert own.encode(text) == ids_of(library, text)
    monkeypatch.setattr(own, "table", parts.ChunkTable(own._learn, 40, 1 << 20))
    for _ in range(20):
        text = " ".join("".join(rng.choices("abcdéf \n", k=5)) for _ in range(100))
        assert own.encode(text) == ids_of(library, text)


@pytest.mark.parametrize("change", [
    {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None},
    {"model": {"dropout": 0.1}}, {"model": {"ignore_merges": True}}, {"added_tokens": [{"lstrip": True}]},
])
def test_other_files_are_refused(change, new_path):
    with open(PATH, encoding="utf-8") as file:
        read = json.load(file)
    for name, value in change.items():
        if name == "model":
            read["model"] |= value
        elif name == "added_tokens":
            read[name] = [read[name][0] | value[0]]
        else:
            read[name] = value
    path = new_path("other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(read, file)
    with pytest.raises(ValueError):
        automaton.Codec(path)


def test_rows(spark, library):
    texts = ["", None, "plain text", "plain text", "x " * 50_000, "é\n\n  z", "a <|endoftext|>  b", "q" * 300_000]
    df = spark.createDataFrame([(i % 7, t, "clash", "dot") for i, t in enumerate(texts)], "doc_id long, text string, ids string, `a.b` string")
    made = automaton.encode_rows(df, "text", PATH, decoded="decoded")
    assert made.columns == ["doc_id", "text", "a.b", "ids", "decoded"]
    rows = made.withColumn("again", automaton.decode(F.col("ids"), PATH)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.ids == ids_of(library, row.text or "") and row.decoded == row.again == (row.text or "")
        assert row["a.b"] == "dot"
    assert automaton.encode_rows(df.limit(0), "text", PATH).count() == 0
    nulls = spark.createDataFrame([(None,), ([64, None, 65],)], "ids array<int>")
    assert [r[0] for r in nulls.select(automaton.decode(F.col("ids"), PATH)).collect()] == ["", "ab"]


def test_whole_table(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_automaton_bpe(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for row in rows:
        ids = ids_of(library, row.text or "")
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
