import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom.llm import language_id as L
from quizloom.llm import queries
from quizloom.llm.grams import Words

SF = "/root/testdata/sf0.1"


def brute_marginals(scores, moves):
    n, states = scores.shape
    total, weight = np.zeros((n, states)), 0.0
    for path in itertools.product(range(states), repeat=n):
        w = np.exp(sum(scores[i, s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        weight += w
        for i, s in enumerate(path):
            total[i, s] += w
    return total / weight


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_forward_backward_matches_all_paths(block):
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 1, 7, 4, 0])
    scores, moves = rng.normal(size=(counts.sum(), 3)) * 2, rng.normal(size=(3, 3)) * 2
    got, start = L.marginals(scores, counts, moves, block), 0
    for n in counts:
        if n:
            np.testing.assert_allclose(got[start:start + n], brute_marginals(scores[start:start + n], moves), atol=1e-9)
        start += n


def test_expected_moves():
    rng = np.random.default_rng(2)
    scores, moves = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3))
    found, expected = L.expectations(scores, moves)
    for chain, own in zip(scores, found):
        np.testing.assert_allclose(own, brute_marginals(chain, moves), atol=1e-9)
    total, gap = np.zeros((3, 3)), 1e-6
    for a, b in itertools.product(range(3), repeat=2):  # the slope of the log of the sum over paths
        shifted = moves.copy()
        shifted[a, b] += gap
        total[a, b] = sum((log_sum(c, shifted) - log_sum(c, moves)) / gap for c in scores)
    np.testing.assert_allclose(expected, total, atol=1e-4)


def log_sum(scores, moves):
    n, states = scores.shape
    return np.log(sum(
        np.exp(sum(scores[i, s] for i, s in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])))
        for p in itertools.product(range(states), repeat=n)
    ))


def small_model(spark):
    rows = [("the cat and the dog went to the house", "en"), ("le chat et le chien vont à la maison", "fr")] * 40
    df = spark.createDataFrame(rows, "text string, lang string")
    return L.fit(df, "text", F.col("lang"))


def test_edge_rows_and_switching(spark):
    model = small_model(spark)
    texts = [None, "", "12 34 --", "the dog", "le chien à la maison", "the dog", "漢字", "the cat " * 60_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in L.add_language(df, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4, 5, 7)] == ["und", "und", "und", "en", "fr", "en", "en"]
    assert [got[i].score for i in (0, 1, 2)] == [0, 0, 0] and got[6].lang_pred in ("en", "fr")
    assert all(0 <= r.score <= 1 for r in got.values())
    words = Words.of(["the cat and the dog went to the house le chat et le chien vont à la maison"])
    found = model.word_probabilities(words).argmax(axis=1).tolist()
    assert found[:9] == [0] * 9 and found[9:] == [1] * 9
    assert L.add_language(df.limit(0), model).count() == 0
    nothing = df.select("text", F.lit(None).cast("string").alias("lang"))
    assert L.fit(nothing, "text", F.col("lang")) is None
    assert {tuple(r) for r in L.add_language(df, None).select("lang_pred", "score").collect()} == {("und", 0.0)}
    one = L.fit(spark.createDataFrame([("abc", "en")], "text string, lang string"), "text", F.col("lang"))
    assert one.label(["xyz"])[0] == ["en"]


def test_every_language_is_sampled_within_the_bound(spark):
    """Copies of one text, very long texts, and one passage beyond the bound."""
    french = "le chat et le chien vont à la maison et la maison est belle " * 50
    german = "der hund und die katze gehen nach hause weil es regnet " * 3000
    spanish = [f"el perro y el gato van a la casa número {i}" for i in range(300)]
    rows = [(french, "fr")] * 400 + [(german, "de")] + [(t, "es") for t in spanish] + [("", "xx"), ("-- !", "xx")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    for most in (1, 500, 5000):
        size, longest = {}, {}
        for r in L.draw_sample(df, most).collect():
            size[r.lang] = size.get(r.lang, 0) + len(r.text.encode())
            longest[r.lang] = max(longest.get(r.lang, 0), len(r.text.encode()))
        assert size.keys() == {"fr", "de", "es"}
        assert all(size[lang] < most + longest[lang] <= most + L.SAMPLE_TEXT for lang in size)
    model = L.fit(df, "text", F.col("lang"), sample_bytes=4000)
    asked = ["le chien à la maison", "die katze und der hund", "el gato y el perro"]
    assert model.label(asked)[0] == ["fr", "de", "es"]


def test_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    right = np.mean([r.lang_pred == truth[r.doc_id] for r in held])
    assert right > 0.98, right
