import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dense import assert_same, brute_force, found, frames

from quizloom.operators import blocks, cells, dense


@pytest.fixture(scope="module")
def grouped():
    """Vectors in 60 groups, a third of all rows one vector, and queries near the groups."""
    make = np.random.default_rng(8)
    centres = make.normal(size=(60, 16))
    rows = centres[make.integers(60, size=1500)] + 0.15 * make.normal(size=(1500, 16))
    rows[500:1000] = centres[50]
    return rows, centres[:9] + 0.15 * make.normal(size=(9, 16))  # none near the copies


@pytest.fixture(scope="module")
def stored(spark, grouped, tmp_path_factory):
    asked, passages = frames(spark, *grouped)
    rows, own = cells.learn(passages, cell_rows=30)
    path = str(tmp_path_factory.mktemp("cells") / "stored")
    cells.store(rows, path)
    return asked, rows, own, cells.read(spark, path), path


def sizes(rows):
    return {(r["shard"], r["cell"]): r["count"] for r in rows.groupBy("shard", "cell").count().collect()}


def test_cells_are_bounded_and_hold_all(grouped, stored):
    _, rows, own, blocks_, _ = stored
    counts = sizes(rows)
    assert sum(counts.values()) == 1500 and set(counts) == set(zip(own.shards.tolist(), own.cells.tolist()))
    whole = {r["cell"] for r in rows.where("passage_id between 500 and 999").select("cell").distinct().collect()}
    assert all(n <= 30 or cell in whole for (_, cell), n in counts.items())
    held = [np.frombuffer(r["ids"], "<i8") for r in blocks_.collect()]
    assert sorted(np.concatenate(held).tolist()) == list(range(1500))
    vectors = {r["passage_id"]: r for r in rows.collect()}
    for shard, cell, centre, radius in zip(own.shards, own.cells, own.centres, own.radius):
        inside = [r["v"] for r in vectors.values() if (r["shard"], r["cell"]) == (shard, cell)]
        assert max(((np.array(inside) - centre) ** 2).sum(axis=1)) <= radius + 1e-9


def test_few_cells_find_most(grouped, stored):
    asked, rows, own, blocks_, _ = stored
    probes = 2
    assert probes <= 0.1 * len(own.cells) / 3
    got, expected = found(cells.search(asked, blocks_, own, k=4, nprobe=probes)), brute_force(*grouped, 4)
    hits = sum(len({i for _, i in got[key]} & {i for _, i in near}) for key, near in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))
    counts = sizes(rows)
    read = cells._nearest_cells(asked, own, probes).select("shard", "cell").distinct().collect()
    assert sum(counts[r["shard"], r["cell"]] for r in read) <= 0.4 * 1500


@pytest.mark.parametrize("nprobe", [1, 3])
def test_exact_is_the_full_search(grouped, stored, nprobe):
    asked, _, own, blocks_, _ = stored
    assert_same(found(cells.search(asked, blocks_, own, k=15, nprobe=nprobe, exact=True)), brute_force(*grouped, 15))


def test_exact_leaves_cells_out(grouped, stored):
    asked, rows, own, blocks_, _ = stored
    near = cells.search(asked, blocks_, own, k=10, nprobe=2).withColumn("distance_key", (F.col("distance") * blocks.SCALE).cast("long"))
    more = cells._open_cells(asked, own, near, 10, 2).count()
    assert more <= 0.5 * 9 * len(own.cells)


def test_folders_are_pruned_and_cells_meet_their_queries(stored):
    asked, _, own, blocks_, _ = stored
    plan = cells.search(asked, blocks_, own, nprobe=1)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "Cartesian" not in plan and "NestedLoop" not in plan


def test_small_blocks_change_nothing(spark, grouped, stored, monkeypatch, new_path):
    asked, rows, own, _, _ = stored
    monkeypatch.setattr(cells, "BLOCK_ROWS", 4)
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 30)
    monkeypatch.setattr(blocks, "MERGE_GROUPS", 3)
    path = new_path("small")
    cells.store(rows, path, by=("cell",))
    got = found(cells.search(asked.repartition(3), cells.read(spark, path), own, k=15, nprobe=2, exact=True))
    assert_same(got, brute_force(*grouped, 15))


def test_given_centres_search_as_before(spark, grouped, new_path):
    asked, passages = frames(spark, *grouped)
    centres = dense.train_centroids(passages, 10)
    rows = dense.assign_cells(passages, centres)
    path = new_path("given")
    cells.store(rows, path, by=("cell",))
    own = cells.given(rows, centres)
    got = found(cells.search(asked, cells.read(spark, path), own, k=6, nprobe=3))
    assert_same(got, found(dense.ivf_topk(asked, rows, centres, k=6, nprobe=3)))


def test_nulls_and_empty_tables(spark, new_path):
    passages = spark.createDataFrame(
        [(0, 1, [0.0, 1.0]), (0, 2, None), (1, 3, [2.0, 2.0]), (1, 4, [2.0, 2.0])], "shard int, passage_id long, v array<double>")
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id long, v array<double>")
    rows, own = cells.learn(passages, 1)
    cells.store(rows, new_path("few"))
    got = found(cells.search(asked, cells.read(spark, new_path("few")), own, k=3, nprobe=1, exact=True))
    assert got == {(0, 1): [(1.0, 1)], (1, 1): [(8.0, 3), (8.0, 4)]}
    none = cells.search(asked.limit(0), cells.read(spark, new_path("few")), own, k=3, exact=True)
    assert none.count() == 0
    rows, own = cells.learn(passages.limit(0))
    cells.store(rows, new_path("none"))
    assert cells.search(asked, cells.read(spark, new_path("none")), own, exact=True).count() == 0
