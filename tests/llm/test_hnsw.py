import numpy as np
import pytest

from quizloom.llm import hnsw, queries


def brute(rows, asked, k):
    """rows: (id, vector). Candidates are distinct (id, vector)."""
    out = {}
    for own, query in asked:
        seen = {(i, tuple(v)) for i, v in rows if i != own and len(v) == len(query)}
        far = sorted((float(np.sqrt(((np.array(v) - query) ** 2).sum())), i) for i, v in seen)
        out[own] = far[:k]
    return out


def test_graph_finds_neighbours():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 24))
    graph = hnsw.build(vectors)
    hits = 0
    for query in vectors[::50]:
        exact = np.argsort(((vectors - query) ** 2).sum(axis=1))[:10]
        hits += len(set(exact.tolist()) & set(graph.nearest(query, 200)[:10]))
    assert hits >= 0.95 * 300
    assert all(len(layer.neighbours) == len(layer.nodes) for layer in graph.layers)


def test_rows_with_copies_and_faults(spark, new_path):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(60, 4)).round(3).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(200 + i, vectors[5]) for i in range(80)] + [(7, vectors[7]), (7, vectors[8]),
             *[(30, (np.array(vectors[30]) + 0.001 * i).tolist()) for i in range(25)], (400, [-0.0, 1.0, 0.0, 0.0]),
             (401, [0.0, 1.0, 0.0, 0.0]), (500, [1.0, 2.0]), (600, [1.0, 2.5])]
    bad = [(None, vectors[3]), (701, None), (702, []), (703, [0.0] * 4), (704, [1.0, None, 1.0, 1.0]),
           (800, [float("nan"), 1.0, 1.0, 1.0]), (900, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    valid = hnsw.valid_rows(df, "vec_id", "embedding")
    folder = new_path("index")
    hnsw.build_index(valid, shard_rows=8).write.parquet(folder)
    index = spark.read.parquet(folder)
    assert index.count() > 3
    asked_ids = [0, 5, 30, 200, 279, 400, 500]
    asked = valid.where(valid["id"].isin(asked_ids + [800]))
    for block, width in ((100, hnsw.SEARCH_WIDTH), (2, 3)):
        got = hnsw.search(spark, index, valid, asked, 10, block=block, width=max(width, 10)).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
            found.setdefault(r.query_id, []).append((r.distance, r.id))
        # Of several vectors of an id the least one asks.
        expected = brute(rows, [(i, np.array(min(v for j, v in rows if j == i))) for i in asked_ids], 10)
        assert found.keys() == expected.keys()
        for own, pairs in expected.items():
            assert [i for _, i in found[own]] == [i for _, i in pairs], own
            assert [d for d, _ in found[own]] == pytest.approx([d for d, _ in pairs])


def test_empty_table(spark, new_path):
    df = hnsw.valid_rows(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    hnsw.build_index(df).write.parquet(new_path("none"))
    index = spark.read.schema(hnsw.INDEX_SCHEMA).parquet(new_path("none"))
    assert hnsw.search(spark, index, df, df, 3).count() == 0


def test_recall_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = {}
    for r in queries.op9_hnsw_search(spark, sf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for own, ranks in got.items():
        far = np.sqrt(((vectors - vectors[ids == own]) ** 2).sum(axis=1))
        far[ids == own] = np.inf
        exact = ids[np.lexsort((ids, far))[:10]]
        hits += len(set(exact.tolist()) & {v for v, _ in ranks.values()})
        assert sorted(ranks) == list(range(1, 11))
        for v, score in ranks.values():
            assert score == pytest.approx(far[ids == v][0], rel=1e-12)
    assert hits >= 0.95 * 10 * len(got)
