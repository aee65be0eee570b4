import random

import pytest

from quizloom.llm import components


@pytest.fixture
def written(monkeypatch):
    """The plans, as they ran, of the tables that are written on the way."""
    plans, write = [], components.materialise

    def recorded(df):
        out = write(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(components, "materialise", recorded)
    return plans


def found(df):
    rows = components.connected_components(df).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.root for r in rows}


def brute_roots(edges):
    parent = {}

    def find(node):
        parent.setdefault(node, node)
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {node: find(node) for node in list(parent) if find(node) != node}


LEAST, MOST = -1 << 63, (1 << 63) - 1


@pytest.mark.parametrize("shape", ["empty", "loops", "repeated", "chain", "hub above", "private minima", "tree", "extremes"])
def test_roots_match_union_find(spark, shape):
    rng = random.Random(7)
    nodes = list(range(-150, 150))
    rng.shuffle(nodes)
    edges = {
        "empty": [], "loops": [(1, 1), (4, 4)], "repeated": [(1, 2), (2, 1), (1, 2), (2, 2), (8, 9)],
        "chain": list(zip(nodes, nodes[1:])), "hub above": [(n, 900) for n in nodes],
        "private minima": [(n, 1000 + n) for n in nodes] + [(500, 1000 + n) for n in nodes],
        "tree": [(nodes[i], nodes[rng.randrange(i)]) for i in range(1, 300)],
        "extremes": [(LEAST, MOST), (0, LEAST), (7, 8)],
    }[shape]
    df = spark.createDataFrame(edges, "a long, b long")
    assert found(df) == brute_roots(edges)


def test_a_round_is_written_once(spark, written):
    # Stars of 20 around a chain of 8: the links, three rounds that move some, and one that moves none.
    edges = [(100 * i, 100 * i + j) for i in range(1, 9) for j in range(1, 21)]
    edges += [(100 * i, 100 * i + 100) for i in range(1, 8)]
    assert found(spark.createDataFrame(edges, "a long, b long")) == brute_roots(edges)
    assert len(written) <= 5
    assert sum(plan.split("== Initial Plan ==")[0].count(" Exchange ") for plan in written) <= 12


def test_links_to_a_hub_are_split(spark, written):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        links = spark.range(1, 200_001, 1, 8).selectExpr(
            "abs(xxhash64(id)) AS a", "IF(id % 2 = 0, 0, abs(xxhash64(id + 1))) AS b")
        roots = components.connected_components(links)
        assert roots.where("root = 0").count() == roots.select("node").distinct().count() == 200_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    joins = [plan for plan in written if "SortMergeJoin" in plan]
    assert joins and all("skew=true" in plan for plan in joins)
