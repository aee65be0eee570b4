import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text import python_terms

from quizloom.operators import blocks, lexical, postings

WORDS = [f"w{i}" for i in range(30)]


def texts(seed, n, longest):
    pick = random.Random(seed)
    return [" ".join(pick.choices(WORDS, k=pick.randint(0, longest))) for _ in range(n)]


def brute_force(queries, passages, k, chunk, sample):
    """Reference result: {query: [(score, passage)]} with dense scores."""
    counted = {p: Counter(python_terms(t)) for p, t in passages.items()}
    first = sorted(counted)[:sample]
    result = {}
    ids = sorted(queries)
    for start in range(0, len(ids), chunk):
        part = ids[start : start + chunk]
        mine = {q: Counter(python_terms(queries[q])) for q in part}
        vocab = set().union(*mine.values()) if mine else set()
        idf = {
            t: math.log((1 + len(first)) / (1 + sum(t in counted[p] for p in first))) + 1
            for t in vocab
        }

        def unit(counts, idf=idf):
            raw = {t: n * idf[t] for t, n in counts.items() if t in idf}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            return {t: x / norm for t, x in raw.items()}

        sides = {p: unit(c) for p, c in counted.items()}
        for q in part:
            left = unit(mine[q])
            scores = [
                (round(sum(x * side.get(t, 0.0) for t, x in left.items()), 6), p)
                for p, side in sides.items()
            ]
            result[q] = sorted(scores, key=lambda s: (-s[0], s[1]))[:k]
    return result


def frames(spark, queries, passages, parts=3):
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    p = spark.createDataFrame(list(passages.items()), "passage_id long, text string")
    return q.repartition(parts), p.repartition(parts)


def found(df):
    result = {}
    for row in df.orderBy("query_id", "rank").collect():
        result.setdefault(row["query_id"], []).append((row["score"], row["passage_id"]))
    return result


@pytest.fixture(scope="module")
def data():
    queries = dict(enumerate(texts(1, 23, 12)))
    queries[5] = ""
    passages = {3 * i: t for i, t in enumerate(texts(2, 80, 40))}
    passages[9] = passages[6]
    passages[12] = "the of"
    return queries, passages


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"query_chunk": 7},
        {"query_chunk": 7, "idf_sample": 20},
        {"max_terms": 15},
        {"query_chunk": 9, "max_terms": 25, "idf_sample": 30},
        {"query_chunk": 19, "max_terms": 150},
    ],
)
def test_equals_brute_force(spark, data, options):
    queries, passages = data
    got = found(lexical.lexical_topk(*frames(spark, queries, passages), k=5, **options))
    expected = brute_force(
        queries, passages, 5, options.get("query_chunk", 800), options.get("idf_sample", 500_000)
    )
    assert got.keys() == expected.keys()
    for q, hits in expected.items():
        assert got[q] == hits


@pytest.mark.parametrize("block", [2048, 3])
@pytest.mark.parametrize("options", [
    {}, {"query_chunk": 7}, {"query_chunk": 7, "idf_sample": 20}, {"query_chunk": 9, "max_terms": 25, "idf_sample": 30},
])
def test_index_equals_brute_force(spark, data, options, block, monkeypatch, new_path):
    queries, passages = data
    asked, texts = frames(spark, queries, passages)
    monkeypatch.setattr(postings, "BLOCK_PASSAGES", block)
    postings.write(texts, new_path("index"), folders=5)
    index = postings.read(spark, new_path("index"), folders=5)
    got = found(lexical.lexical_topk(asked, None, k=5, index=index, **options))
    expected = brute_force(
        queries, passages, 5, options.get("query_chunk", 800), options.get("idf_sample", 500_000)
    )
    assert got == expected


def test_index_holds_every_place(spark, new_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_TOKENS", 4)
    texts = {1: "w1 w2 the w1", 2: None, 3: "", 4: "w2 " * 50, 5: "w2", 6: "w2"}
    schema = "passage_id long, text string"
    postings.write(spark.createDataFrame(list(texts.items()), schema).coalesce(1), new_path("index"), folders=3)
    index = postings.read(spark, new_path("index"), folders=3)
    for words in ([], ["w9"]):
        assert [r["terms"] for r in index.sparse_rows(words, np.zeros(0, np.int64)).collect()] == [[]] * 6
    got, rows = Counter(), index.rows.collect()
    blocks_ = {r["block"]: (np.frombuffer(r["ids"], "<i8"), postings._places(r["steps"])) for r in rows if r["word"] is None}
    for row in rows:
        if row["word"] is not None:
            ids, starts = blocks_[row["block"]]
            places = postings._places(row["steps"])
            own = np.searchsorted(starts, places, "right") - 1
            got.update(zip(ids[own].tolist(), (places - starts[own]).tolist(), [row["word"]] * len(places)))
    assert len(blocks_) > 1 and sorted(np.concatenate([i for i, _ in blocks_.values()]).tolist()) == sorted(texts)
    assert got == Counter([(1, 0, "w1"), (1, 1, "w2"), (1, 2, "w1"), *((4, i, "w2") for i in range(50)), (5, 0, "w2"), (6, 0, "w2")])
    assert index.passages.count() == 6
    # Only rows of the words asked for are read, from their folders.
    read = index.of_words(["w1", "w9"])
    assert read.agg(F.sum(F.octet_length("steps"))).first()[0] == 8 and read.select("code").distinct().collect() == [(0,)]
    assert "PartitionFilters: [folder" in read._jdf.queryExecution().executedPlan().toString()
    sparse = index.sparse_rows(["w1", "w2"], np.array([1, 3]))  # w1 w2, and w2 w2
    rows = {r["passage_id"]: (r["terms"], r["tfs"]) for r in sparse.collect()}
    none = ([], [])
    assert rows == {1: ([0, 1, 2], [2, 1, 1]), 2: none, 3: none, 4: ([1, 3], [50, 49]), 5: ([1], [1]), 6: ([1], [1])}


def test_empty_index(spark, new_path):
    none = spark.createDataFrame([], "passage_id long, text string")
    postings.write(none, new_path("index"))
    index = postings.read(spark, new_path("index"))
    asked = spark.createDataFrame([(1, "w1 w2")], "query_id long, text string")
    assert lexical.lexical_topk(asked, None, index=index).count() == 0


def test_blocks_without_a_chance_are_left_out(spark):
    """A query whose best rows beat a block's largest weights is not scored against it."""
    chunk = lexical._Chunk(
        np.array([7, 8]), np.array([0, 1, 3]), np.array([1, 2, 0]), np.array([0, 0, 1]), np.ones(3),
        np.array([True, True, False]), np.ones(3, bool), np.array([0.6, 0.8, 1.0]))
    term, weight, row = np.array([0, 1, 1]), np.array([0.1, 0.2, 0.5]), np.array([0, 0, 1])
    worst = -np.array([600_000, 400_000])
    assert lexical._may_enter(term, weight, chunk, worst).tolist() == [1]
    assert lexical._may_enter(term, weight, chunk, -np.array([460_000, 400_000])) is None
    whole = lexical._dots(row, term, weight, chunk, 2)
    assert np.allclose(whole, [[0.22, 0.4], [0.2, 0.5]])
    assert np.allclose(lexical._dots(row, term, weight, chunk, 2, np.array([1])), whole[1:])


@pytest.mark.parametrize("max_terms", [None, 60, 15])
def test_own_pool_in_parts(spark, data, max_terms):
    queries, passages = data
    q, p = frames(spark, queries, passages)
    pairs = spark.createDataFrame([(a, b) for a in queries for b in passages if (a + b) % 5], "query_id long, passage_id long")
    rows = lexical.own_pool_scores(q, pairs, p, max_terms=max_terms).collect()
    expected = brute_force(queries, passages, len(passages), 800, 500_000)
    whole = {(a, b): s for a, hits in expected.items() for s, b in hits}
    got = {(r["query_id"], r["passage_id"]): r["score"] for r in rows}
    assert got == pytest.approx({key: s for key, s in whole.items() if sum(key) % 5})


def test_a_cut_chunk_shares_no_pass(spark, data):
    """The first chunk is cut, and the second would fit beside its last part."""
    queries, passages = frames(spark, *data)
    terms = lexical.query_terms(lexical.with_chunk(queries, "query_id", 19))
    passes, split = lexical._plan_passes(lexical._query_parts(terms, 150), 150)
    assert split == {0}
    assert [len(p) for p in passes] == [1] * len(passes) and passes[-1] == [(1, 0)]


def test_does_not_depend_on_partitioning(spark, data, monkeypatch):
    whole = found(lexical.lexical_topk(*frames(spark, *data, parts=1), k=10))
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 50)
    assert found(lexical.lexical_topk(*frames(spark, *data, parts=7), k=10)) == whole


def test_fill_and_few_passages(spark):
    queries = {1: "w1 w2", 2: "nothing shared"}
    passages = {7: "w1", 4: "w9", 5: "w8 w2"}
    q, p = frames(spark, queries, passages)
    filled = found(lexical.lexical_topk(q, p, k=10))
    assert [len(hits) for hits in filled.values()] == [3, 3]
    assert filled[2] == [(0.0, 4), (0.0, 5), (0.0, 7)]
    bare = found(lexical.lexical_topk(q, p, k=10, fill_to_k=False))
    assert 2 not in bare and {p for _, p in bare[1]} == {5, 7}


def test_scores_above_zero_equal_brute_force(spark, data):
    queries, passages = data
    expected = brute_force(queries, passages, len(passages), 800, 500_000)
    rows = lexical.tfidf_scores(*frames(spark, queries, passages)).collect()
    got = {(r["query_id"], r["passage_id"]): r["score"] for r in rows}
    assert got == pytest.approx(
        {(q, p): s for q, hits in expected.items() for s, p in hits if s > 0}
    )


def test_many_copies_of_one_text(spark):
    """A third of all passages are one text; ties go by id and nothing is dropped."""
    passages = {i: ("w1 w2" if i % 3 == 0 else f"w{i % 30} w5") for i in range(600)}
    hits = found(lexical.lexical_topk(*frames(spark, {1: "w1 w2"}, passages, 8), k=10))[1]
    assert [p for _, p in hits] == [3 * i for i in range(10)]


def test_context_is_best_first(spark):
    passages = spark.createDataFrame([(1, "é"), (2, "two")], "passage_id long, text string")
    ranked = spark.createDataFrame(
        [(9, 1, 0.5, 2), (9, 2, 0.1, 1)], "query_id long, rank long, score double, passage_id long"
    )
    context = lexical.assemble_context(lexical.with_texts(ranked, passages)).first()["context"]
    assert context == "two\né\n"
    questions = spark.createDataFrame([(9,), (10,)], "id long")
    contexts = spark.createDataFrame([(9, context)], "id long, context string")
    joined = lexical.attach_context(questions, contexts, "id").orderBy("id").collect()
    assert [r["context"] for r in joined] == [context, ""]


def test_own_pool_scores_given_pairs_alone(spark, data):
    """Equal to the block search over the same pool, for the pairs asked for."""
    queries, passages = data
    q, p = frames(spark, queries, passages)
    everything = [(a, b) for a in queries for b in passages]
    pairs = spark.createDataFrame(everything, "query_id long, passage_id long")
    whole = found(lexical.lexical_topk(q, p, k=10))
    assert found(lexical.own_pool_topk(q, pairs, p, 10)) == whole
    few = spark.createDataFrame(everything[::7], "query_id long, passage_id long")
    rows = lexical.own_pool_scores(q, few, p).collect()
    assert sorted((r["query_id"], r["passage_id"]) for r in rows) == sorted(everything[::7])


@pytest.mark.parametrize("max_terms", [None, 60, 15])
def test_own_pool_without_pairs_is_every_passage(spark, data, max_terms):
    """No partner is dropped, nor one that shares no term or holds none."""
    queries, passages = data
    q, p = frames(spark, queries, passages | {1000: None})
    rows = lexical.own_pool_scores(q, None, p, max_terms=max_terms).collect()
    expected = brute_force(queries, passages | {1000: ""}, len(passages) + 1, 800, 500_000)
    got = {(r["query_id"], r["passage_id"]): r["score"] for r in rows}
    assert len(rows) == len(got) == len(queries) * (len(passages) + 1)
    assert got == pytest.approx({(a, b): s for a, hits in expected.items() for s, b in hits})
    assert 0.0 in got.values() and all(str(s) != "-0.0" for s in got.values())


def test_scores_do_not_depend_on_other_queries_number(spark, data):
    queries, passages = data
    q, p = frames(spark, queries, passages)
    one = lexical.with_chunk(q).select("chunk").distinct().collect()
    assert [r["chunk"] for r in one] == [0]


def test_counts_meet_the_vocabulary_after_counting(spark):
    passages = spark.createDataFrame([(1, "w1 w2 w1"), (2, "w3"), (3, "")], "passage_id long, text string")
    vocab = spark.createDataFrame([("w1",), ("w1 w2",), ("w9",)], "term string")
    got = {tuple(r) for r in lexical.term_counts(passages, vocab).collect()}
    assert got == {(1, "w1", 2), (1, "w1 w2", 1)}


def test_other_terms_go_where_they_are_cut(spark, monkeypatch):
    """A small vocabulary is sent to the tasks, so that only its terms are counted and shuffled; a
    larger one is joined. No list of terms is sorted."""
    passages = spark.createDataFrame([(1, "w1 w2 w1"), (2, "w3"), (3, ""), (4, None), (5, "w1")], "passage_id long, text string")
    vocab = spark.createDataFrame([(0, "w1"), (1, "w1"), (0, "w1 w2"), (0, "w9")], "chunk long, term string")
    counted = lexical.term_counts(passages, vocab)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "broadcast" in plan
    assert plan.index("Aggregate [passage_id") < plan.index("Join LeftSemi") < plan.index("Generate explode")
    expected = {(1, "w1", 2), (1, "w1 w2", 1), (5, "w1", 1)}
    assert {tuple(r) for r in counted.collect()} == expected
    monkeypatch.setattr(lexical, "SENT_BYTES", 0)
    counted = lexical.term_counts(passages, vocab)
    assert counted.columns == ["passage_id", "term", "tf"] and {tuple(r) for r in counted.collect()} == expected


def test_steps_of_all_words_at_once():
    """The words of a block are turned into steps together, not one by one."""
    places = [[0, 3, 9], [1], [2, 7], [0, 4, 4, 8]]
    steps = postings._steps(np.concatenate(places), np.cumsum([len(p) for p in places]))
    assert [postings._places(s.as_py()).tolist() for s in steps] == places
    tokens = [["b", "a", "b"], [], None, ["a", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 10]), pa.array(tokens, pa.list_(pa.string()))], names=["passage_id", "tokens"])
    found = [r for out in postings._invert(iter([batch, batch.slice(1, 2), batch.slice(0, 0)]), 9, 4) for r in out.to_pylist()]
    rows = [(r["word"], postings._places(r["steps"]).tolist(), r["ids"] and np.frombuffer(r["ids"], "<i8").tolist()) for r in found]
    assert rows == [
        ("b", [0, 2], None), ("a", [1], None), (None, [0, 3, 3], [7, 8, 9]),
        ("a", [0], None), ("c", [1], None), (None, [0], [10]), (None, [0, 0], [8, 9]),
    ]
