import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom.operators import blocks, dense


@pytest.fixture(scope="module")
def vectors():
    make = np.random.default_rng(4)
    rows = make.normal(size=(300, 8))
    rows[50:150] = rows[50]  # a third of all rows are copies
    return rows, make.normal(size=(12, 8))


def frames(spark, rows, queries, parts=4):
    passages = spark.createDataFrame(
        [(int(i % 3), int(i), [float(x) for x in v]) for i, v in enumerate(rows)],
        "shard int, passage_id long, v array<double>",
    ).repartition(parts)
    asked = spark.createDataFrame(
        [(int(i), [float(x) for x in v]) for i, v in enumerate(queries)],
        "query_id long, v array<double>",
    )
    return asked, passages


def brute_force(rows, queries, k):
    result = {}
    for shard in range(3):
        ids = [i for i in range(len(rows)) if i % 3 == shard]
        for q, query in enumerate(queries):
            near = sorted((round(float(((rows[i] - query) ** 2).sum()), 6), i) for i in ids)
            result[shard, q] = near[:k]
    return result


def found(df):
    result = {}
    for r in df.orderBy("shard", "query_id", "rank").collect():
        hit = (r["distance"], r["passage_id"])
        result.setdefault((r["shard"], r["query_id"]), []).append(hit)
    return result


def assert_same(got, expected):
    assert got.keys() == expected.keys()
    for key, hits in expected.items():
        assert [p for _, p in got[key]] == [p for _, p in hits]
        assert [d for d, _ in got[key]] == pytest.approx([d for d, _ in hits], abs=2e-6)


def test_exact_search(spark, vectors):
    got = found(dense.topk_per_shard(*frames(spark, *vectors), k=15))
    assert_same(got, brute_force(*vectors, 15))


def test_small_blocks_and_states_change_nothing(spark, vectors, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 30)
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 7)
    found_blocks = list(dense.vector_blocks(frames(spark, *vectors)[0]))
    assert len(found_blocks) > 1
    assert sorted(i for ids, _ in found_blocks for i in ids) == list(range(12))
    got = found(dense.topk_per_shard(*frames(spark, *vectors, parts=9), k=6))
    assert_same(got, brute_force(*vectors, 6))


def test_large_keys_are_ranked_exactly(spark):
    state = blocks.RunningTopK(1, 2)
    keys = np.array([[2**61, 5, 5, 2**61 - 1]])
    state.push(keys, np.array([1, 2, 3, 4]))
    state.push(np.array([[5]]), np.array([0]))
    assert state.ids.tolist() == [[0, 2]]


def test_all_cells_give_the_exact_result(spark, vectors):
    asked, passages = frames(spark, *vectors)
    centres = dense.train_centroids(passages, 10)
    cells = dense.assign_cells(passages, centres)
    got = found(dense.ivf_topk(asked, cells, centres, k=15, nprobe=10))
    assert_same(got, brute_force(*vectors, 15))


def test_centres_in_several_blocks(spark, vectors, monkeypatch):
    asked, passages = frames(spark, *vectors)
    centres = dense.train_centroids(passages, 10)
    whole = dense.assign_cells(passages, centres)
    near = found(dense.ivf_topk(asked, whole, centres, k=5, nprobe=3))
    cells = {r["passage_id"]: r["cell"] for r in whole.collect()}
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 4)
    split = dense.assign_cells(passages, centres)
    assert {r["passage_id"]: r["cell"] for r in split.collect()} == cells
    assert found(dense.ivf_topk(asked, split, centres, k=5, nprobe=3)) == near


def test_recall_grows_with_cells(spark, vectors):
    asked, passages = frames(spark, *vectors)
    exact = {(k, p) for k, hits in brute_force(*vectors, 5).items() for _, p in hits}
    centres = dense.train_centroids(passages, 10)
    cells = dense.assign_cells(passages, centres)
    recalls = []
    for nprobe in (1, 4, 10):
        got = found(dense.ivf_topk(asked, cells, centres, k=5, nprobe=nprobe))
        recalls.append(len(exact & {(k, p) for k, hits in got.items() for _, p in hits}))
    assert recalls == sorted(recalls) and recalls[-1] == len(exact)


def test_cells_are_pruned_on_disk(spark, vectors, new_path):
    from quizloom.sources import writers

    asked, passages = frames(spark, *vectors)
    centres = dense.train_centroids(passages, 6)
    writers.write_shards(dense.assign_cells(passages, centres), new_path("cells"))
    stored = spark.read.parquet(new_path("cells"))
    result = dense.ivf_topk(asked, stored, centres, k=5, nprobe=6)
    assert_same(found(result), brute_force(*vectors, 5))
    plan = result._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan


def test_passages_are_not_shuffled(spark, vectors):
    asked, passages = frames(spark, *vectors)
    plan = dense.topk_per_shard(asked, passages, 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert "NestedLoop" not in plan


def test_fewer_passages_than_k(spark):
    asked, passages = frames(spark, np.eye(3), np.eye(3)[:1])
    got = found(dense.topk_per_shard(asked, passages, k=15))
    assert {k: len(v) for k, v in got.items()} == {(0, 0): 1, (1, 0): 1, (2, 0): 1}


def test_normalise_and_pool(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<float>")
    assert [r["v"] for r in dense.normalise(df).orderBy("id").collect()] == [[0.6, 0.8], [0, 0]]
    near = spark.createDataFrame([(1, 5), (2, 5), (1, 7), (1, 9)], "query_id long, passage_id long")
    texts = spark.createDataFrame(
        [(5, "x"), (7, "x"), (9, "y"), (11, "z")], "passage_id long, text string"
    )
    pool = dense.candidate_pool(near, texts).orderBy("passage_id").collect()
    assert [tuple(r) for r in pool] == [(5, "x"), (9, "y")]


def test_row_batches(spark):
    df = spark.range(10).withColumn("id", 100 - F.col("id"))
    rows = dense.row_batches(df, ["id"], 4).orderBy("id").collect()
    assert [r["batch"] for r in rows] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
