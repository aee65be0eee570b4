import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom.llm import decontaminate as D
from quizloom.llm import queries
from quizloom.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    owners = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[i:i + window]), set()).add("" if item is None else str(item))
    sizes = sorted({len(k) for k in owners})
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for n in sizes:
                own = owners.get(tuple(w[i:i + n])) if i + n <= len(w) else None
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_index_against_plain_search():
    rng = np.random.default_rng(2)
    for top, n in ((1, 40), (3, 400), (40, 3000)):
        text = rng.integers(0, top + 1, n) * (rng.random(n) < 0.95)
        text = np.append(text, 0)
        index = FMIndex(text, top, sample=4)
        phrases = rng.integers(1, top + 1, (60, 5))
        sizes = rng.integers(1, 6, 60)
        low, high = index.search(phrases, sizes)
        for p, k, a, b in zip(phrases, sizes, low, high):
            expected = [i for i in range(n - k + 1) if (text[i:i + k] == p[:k]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


@pytest.fixture
def tables(spark):
    rng = random.Random(11)
    vocabulary = ["Alpha", "beta", "gamma", "délta", "x9", "漢字", "mu"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1, 3, 13, 14, 30]) if i else 30)) for i in range(1, 12)]
    items += [(50, None), (51, ""), (52, "..."), (None, text(20)), (4, items[3][1]), (60, items[3][1].upper())]
    items = [i for i in items if len(words(i[1])) != 1] + [(70, "solo")]
    docs = [(i, " zz ".join([text(5), rng.choice(items)[1] or "", "solo"[:rng.randrange(5)], text(8)])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "!!"), (103, docs[0][1]), (103, docs[0][1]), (None, docs[1][1]), (104, "gamma " * 30_000)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 100}, {"block_bytes": 300}])
def test_rows_match_brute_force(spark, tables, options):
    docs, items = tables
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_hits(df, bench, **options)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(
        ",".join(sorted(r["items"])).encode()).hexdigest(), r.bad) for r in
        found.withColumn("bad", D.is_contaminated()).collect())
    assert got == sorted((str(d), *rest) for d, *rest in brute(docs, items))
    cleaned = found.select("doc_id", "text", "n_words", "n_hit", D.without_spans(F.col("text"), F.col("spans")).alias("rest"))
    for row in cleaned.where("text is not null").collect():
        assert len(words(row.rest)) <= row.n_words - row.n_hit + 1
        if not row.n_hit:
            assert row.rest == row.text


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.find_hits(docs.limit(0), bench).count() == 0
    row = D.find_hits(docs, bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row["items"], row.spans) == (2, 0, [], [])


def test_whole_table(spark, sf_dir):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text").collect()]
    got = sorted(tuple(r) for r in queries.op2_decontaminate(spark, sf_dir).collect())
    assert got == sorted(brute(read("documents", "doc_id"), read("benchmark", "item_id")))
    assert any(r[5] for r in got)
