import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quizloom.llm import simhash


def brute_fingerprint(text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


TEXTS = [
    "one two three four five six", "ONE two\tthree four\nfive six", "", None, " \n ", "alone",
    "Élan éclair ÀB", "élan éclair Àb", "a b", "A B", "word " * 5000, "x" * 100_000,
]


def test_fingerprints(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r.v for r in df.select("doc_id", simhash.fingerprint(F.col("text")).alias("v")).collect()}
    for i, text, _ in rows:
        assert got[i] & (1 << 64) - 1 == brute_fingerprint(text), text


@pytest.mark.parametrize("hot", [64, 3, 0])
def test_links_match_brute_force(spark, hot):
    rng = random.Random(5)
    prints = [0, 3, 7 << 61]
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(15):
            prints.append(value)
            for bit in rng.sample(range(64), rng.randrange(4)):
                value ^= 1 << bit
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.similar_fingerprints(df, hot_bucket=hot).collect()
    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    roots = {r.node: r.root for r in simhash.connected_components(
        simhash.similar_fingerprints(df, hot_bucket=hot)).collect()}
    got = [roots.get(p, p) for p in signed]
    expected = brute_components(prints)
    pairs = len(set(zip(got, expected)))
    assert pairs == len(set(got)) == len(set(expected))


def test_components_of_rows(spark):
    rows = [(7, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "solo"),
            (9, None), (8, ""), (5, "other words here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([("7", "3"), ("3", "3"), ("3", "3"), ("None", "3"), ("None", "None"),
                          ("9", "8"), ("8", "8"), ("5", "5")])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "5", "8", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.similar_fingerprints(spark.createDataFrame([(1,)], "fp long"), max_distance=3)
