import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom.llm import queries, toxicity
from quizloom.llm.grams import Words, slices

SF = "/root/testdata/sf0.1"


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def test_words_and_slices():
    texts = ["Été à-la a1", "", "x", "--", "A " * 10 + "b"]
    got = Words.of(texts)
    assert got.counts.tolist() == [len(words(t)) for t in texts]
    flat = [w.encode() for t in texts for w in words(t)]
    assert got.sizes.tolist() == [len(w) for w in flat] and got.data.tobytes() == b"".join(flat)
    hashes, stems = got.hashes(), got.hashes(2)
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (hashes[i] == hashes[j]) == (a == b) and (stems[i] == stems[j]) == (a[:2] == b[:2])
    cut = defaultdict(str)
    for owners, parts in slices(texts, 4):
        for o, p in zip(owners, parts):
            cut[o] += p
    assert [cut[i] for i in range(len(texts))] == texts


def test_ratios_match_a_plain_count(spark):
    rows = [("you stupid fool stupid", 1), ("a fine day a fine night", 0), ("foolish stupidity", 1), ("day by day", 0),
            (None, 1), ("", 0), ("nothing", None)]
    df = spark.createDataFrame(rows, "text string, y int")
    model = toxicity.Model.of(toxicity.count_words(df.where("y is not null"), "text", F.col("y")), 2.0)
    count = [Counter(), Counter()]
    for text, y in rows:
        if y is not None:
            count[1 - y].update(words(text))
    stem = [Counter(), Counter()]
    types = Counter(w[:4] for w in set(count[0]) | set(count[1]))
    for c in (0, 1):
        for w, n in count[c].items():
            stem[c][w[:4]] += n
    total = [sum(c.values()) for c in count]
    spread = sum(types.values()) + 0.5 * (1 << toxicity.STEM_BITS)

    alone = [sum(count[0][w] + count[1][w] == 1 for w in c) for c in count]

    def p(c, w):
        s, both = w[:4], count[0][w] + count[1][w]
        base = (types[s] + 0.5) / spread
        p_stem = max(stem[c][s] - 0.75, 0) / total[c] + 0.75 * len(stem[c]) / total[c] * base
        left = (0.75 * len(count[c]) + 0.25 * alone[c]) / total[c]
        if both <= 1:  # discounted whole
            return left * p_stem
        share = (both + 0.5) / (stem[0][s] + stem[1][s] + 0.5)
        return max(count[c][w] - 0.75, 0) / total[c] + left * p_stem * share

    asked = ["stupid", "stupidest", "day", "fine", "unknown", "fool", "by"]
    got = model.ratios(Words.of([" ".join(asked)]))
    for w, ratio in zip(asked, got):
        assert ratio == pytest.approx(math.log(p(0, w) / p(1, w)), rel=1e-3, abs=1e-4), w


def test_rare_toxic_words_keep_their_evidence_among_many(spark):
    """More distinct words than any table of fixed size could tell apart."""
    common = spark.range(0, 3000, 1, 8).select(
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(
            F.lit("w"), F.hex(F.col("id") * 1000 + i))), " ").alias("text"), F.lit(0).alias("y"))
    rare = [f"zq{i}x" for i in range(200)]
    df = common.union(spark.createDataFrame([(" ".join(rare), 1)] * 2, "text string, y int"))
    words = toxicity.materialise(toxicity.count_words(df, "text", F.col("y")))
    assert words.count() == 3_000_200
    assert toxicity.Model.of(words, 2.0).ratios(Words.of([" ".join(rare)])).min() > 5


def expressions(count):
    """Texts of 60 words in which "alpha beta" is toxic, and the same words apart are not."""
    rng, words = np.random.default_rng(1), np.array([f"w{i}" for i in range(400)])
    for i in range(count):
        own = words[rng.integers(0, 400, 58)].tolist()
        if i % 2:
            at = rng.integers(0, 58)
            own[at:at] = ["alpha", "beta"]
        else:
            first, second = sorted(rng.choice(58, 2, replace=False).tolist())
            own.insert(first, "beta")
            own.insert(second + 3, "alpha")
        yield i, " ".join(own), i % 2


def test_a_toxic_expression_of_plain_words(spark):
    df = spark.createDataFrame(list(expressions(4000)), "doc_id long, text string, y int").repartition(8)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(df.where(~held), "text", F.col("y"))
    got = toxicity.add_score(df.where(held), model).collect()
    toxic, plain = (np.array([r.score for r in got if r.y == y]) for y in (1, 0))
    assert (toxic[:, None] > plain).mean() >= 0.95


def test_pairs_match_a_plain_count(spark):
    rows = [("you are bad you are bad", 1), ("are you bad", 0), ("you are", 0), ("bad you", None), (None, 0), ("a b a b a b", 0)]
    df = spark.createDataFrame(rows, "text string, y int").where("y is not null")
    ratios = toxicity.Ratios.of(toxicity.materialise(toxicity.count_words(df, "text", F.col("y"))))
    counts = [Counter(), Counter()]
    for text, y in rows:
        if y is not None:
            own = words(text)
            counts[1 - y].update(zip(own, own[1:]))
    for most in (100, 0):
        model = toxicity.Model.held(ratios, 2.0, most)[0]
        shared = spark.sparkContext.broadcast(model)
        pairs = toxicity.count_pairs(df, "text", F.col("y"), shared, ratios.words)
        got = Counter((r.toxic, r.ordinary, r.n) for r in pairs.collect())
        both = set(counts[0]) | set(counts[1])
        listed = [(counts[0][p], counts[1][p]) for p in both]
        assert got == Counter((t, o, t + o) for t, o in listed if t + o > 1)
        held = toxicity.Model.held(ratios, 2.0, 100)[0]
        added = {r.hash: r.ratio for r in ratios.of_pairs(pairs, -1e9).collect()}
        odds = ratios.toxic / ratios.ordinary
        for (a, b), t, o in [(p, counts[0][p], counts[1][p]) for p in both if counts[0][p] + counts[1][p] > 1]:
            found = Words.of([f"{a} {b}"])
            key = toxicity._pair_hashes(found.hashes(), np.zeros(2, int))[0].view(np.int64)[0]
            r = np.rint(held.ratios(found)[1] * 64) / 64
            back, q = 0.75 * ((t > 0) + (o > 0)), math.exp(r) * odds / (1 + math.exp(r) * odds)
            expected = math.log((max(t - 0.75, 0) + back * q) / ratios.toxic) - math.log(
                (max(o - 0.75, 0) + back * (1 - q)) / ratios.ordinary) - r
            assert added[key] == pytest.approx(expected, abs=1e-4)


def test_filter_holds_its_keys(spark):
    rng = np.random.default_rng(2)
    keys, others = (rng.integers(-2**63, 2**63 - 1, 50_000) for _ in range(2))
    made = toxicity.Filter.of(spark.createDataFrame([(int(k),) for k in keys], "hash long"), "hash")
    assert made.may_hold(keys.view(np.uint64)).all() and made.may_hold(others.view(np.uint64)).mean() < 0.1


@pytest.mark.parametrize("hot_rows", [0, 3, 40])
def test_words_that_are_not_held_are_joined(spark, hot_rows):
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"{a}{b}" for a in ("stup", "fine", "dayl", "grim", "x", "é") for b in range(25)])
    rows = []
    for i in range(300):
        toxic = int(i % 3 == 0)
        own = vocabulary[rng.integers(0, 75, 12) + 60 * toxic]
        rows.append((i, " ".join([*own, *["so", "bad"][:2 * toxic], "bad" if i % 2 else "so", f"only{i}", f"un{i}seen"]), toxic))
    rows += [(900 + i, rows[7][1], 0) for i in range(40)] + [(990, None, 1), (991, "", 0), (992, "unheard zzz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    whole = toxicity.fit(df, "text", F.col("y"), pair_margin=0.1)
    expected = {r.doc_id: r.score for r in toxicity.add_score(df, whole).collect()}
    assert whole.shared.value.whole and len(whole.shared.value.pairs) > 40
    model = toxicity.fit(df, "text", F.col("y"), pair_margin=0.1, hot_rows=hot_rows)
    held = model.shared.value
    assert not held.whole and len(held.words) <= hot_rows and len(held.pairs) <= hot_rows and held.pair_filter
    for most in (0, 1000):
        got = toxicity.add_score(df, model, broadcast_rows=most).collect()
        assert len(got) == len(rows)
        assert all(r.score == pytest.approx(expected[r.doc_id], rel=1e-6, abs=1e-9) for r in got)


def test_edge_rows(spark):
    rows = [(1, "bad bad word", 1), (2, "good", 0), (2, "good", 0), (3, None, 0), (4, "", 1), (None, "bad", None),
            (5, "bad thing", 1), (6, "fine " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int").withColumn("score", F.lit("clash"))
    model = toxicity.fit(df, "text", F.col("y"))
    got = toxicity.add_score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.add_score(df.limit(0), model).count() == 0
    assert toxicity.fit(df.where("y = 0"), "text", F.col("y")) == 0.0
    assert toxicity.fit(df.where("y = 1"), "text", F.col("y")) == 1.0
    assert toxicity.fit(df.limit(0), "text", F.col("y")) == 0.0
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    for most in (0, 100):
        found = toxicity.label_rows(df, labels, "doc_id", "toxic", "_t", broadcast_rows=most).collect()
        assert [(r.doc_id, r._t) for r in found] == [(1, 1)]


def test_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op1_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    score, predicted, toxic = map(np.array, zip(*held))
    wins = (score[toxic == 1][:, None] > score[toxic == 0]).mean()
    assert wins > 0.97
    assert (predicted == toxic).mean() > 0.96
