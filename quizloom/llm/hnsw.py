"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards; each shard's graph is stored as a row of flat arrays (the
vectors, each layer's nodes, and their neighbours in rows of fixed width). A search walks every
shard's graph, takes exact distances in double precision of all it found there, and merges the
shards' best.

Equal vectors are one node, so that a vector that a third of the rows share is neither a shard of
its own nor a graph of zero distances; results name the rows of a node by way of a membership
table, of which a search for k needs the k + 1 smallest ids a node. Nodes all of whose rows have
the query's own id are no candidates; where they crowd out others, a walk is repeated wider.

Defined results: a vector that is null, empty, zero, or has a null or non-finite component takes
no part, nor does a row with a null id. Distances are Euclidean, between vectors of equal length
only. Rows repeated with id and vector are one candidate; all rows with the query's id are its
own. Of several vectors under a query id the smallest is asked for. Ties go to the smaller id.
Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizloom.llm.tables import one_per_task

NEIGHBOURS = 16
BUILD_WIDTH = 100
SEARCH_WIDTH = 200
SHARD_ROWS = 4096
QUERY_BLOCK = 20_000

INDEX_SCHEMA = (
    "shard string, dim int, h1 array<long>, h2 array<long>, least array<long>, most array<long>, vectors binary, "
    "layers array<struct<nodes: binary, neighbours: binary, width: int>>"
)
HIT_SCHEMA = "query_id long, h1 long, h2 long, least long, distance double"


@dataclass
class Layer:
    """Nodes of a layer, ascending, and their neighbours, -1 where there are fewer."""

    nodes: np.ndarray
    neighbours: np.ndarray
    row: np.ndarray | None = None

    def of(self, node: int) -> np.ndarray:
        found = self.neighbours[node if self.row is None else self.row[node]]
        return found[found >= 0]


class Graph:
    """Layers from the lowest, which has every node, to the highest."""

    def __init__(self, vectors: np.ndarray, layers: list[Layer]):
        self.vectors, self.layers = vectors, layers
        self._seen, self._turn = np.zeros(len(vectors), np.int64), 0
        for layer in layers[1:]:
            layer.row = np.full(len(vectors), -1, np.int32)
            layer.row[layer.nodes] = np.arange(len(layer.nodes))

    def _far(self, query: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        apart = self.vectors[nodes] - query
        return np.einsum("ij,ij->i", apart, apart)

    def walk(self, query: np.ndarray, start: list[int], width: int, layer: Layer) -> list[tuple[float, int]]:
        """The ``width`` nearest that a best-first walk meets, nearest first."""
        self._turn += 1
        first = np.array(start, np.int64)
        self._seen[first] = self._turn
        ahead = [(float(d), int(n)) for d, n in zip(self._far(query, first), first)]
        kept = [(-d, n) for d, n in ahead]
        heapq.heapify(ahead)
        heapq.heapify(kept)
        while ahead:
            distance, node = heapq.heappop(ahead)
            if len(kept) >= width and distance > -kept[0][0]:
                break
            around = layer.of(node)
            around = around[self._seen[around] != self._turn]
            if not len(around):
                continue
            self._seen[around] = self._turn
            apart = self._far(query, around)
            if len(kept) >= width:
                closer = apart < -kept[0][0]
                around, apart = around[closer], apart[closer]
            for d, n in zip(apart.tolist(), around.tolist()):
                if len(kept) < width:
                    heapq.heappush(kept, (-d, n))
                elif d < -kept[0][0]:
                    heapq.heapreplace(kept, (-d, n))
                else:
                    continue
                heapq.heappush(ahead, (d, n))
        return sorted((-d, n) for d, n in kept)

    def nearest(self, query: np.ndarray, width: int) -> list[int]:
        start = [int(self.layers[-1].nodes[0])]
        for layer in self.layers[:0:-1]:
            start = [self.walk(query, start, 1, layer)[0][1]]
        return [n for _, n in self.walk(query, start, width, self.layers[0])]


def _spread(vectors: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """Up to ``most`` neighbours, nearest first; one that is nearer to a chosen one than to the
    node itself is taken only where room is left."""
    if len(found) <= most:
        return [n for _, n in found]
    nodes = np.array([n for _, n in found])
    own = vectors[nodes]
    size = np.einsum("ij,ij->i", own, own)
    between = size[:, None] + size[None] - 2 * own @ own.T
    closest = np.full(len(nodes), np.inf)
    chosen, rest = [], []
    for i, (distance, node) in enumerate(found):
        if distance < closest[i]:
            chosen.append(node)
            if len(chosen) == most:
                return chosen
            np.minimum(closest, between[i], out=closest)
        else:
            rest.append(node)
    return chosen + rest[:most - len(chosen)]


def build(vectors: np.ndarray, m: int = NEIGHBOURS, width: int = BUILD_WIDTH, seed: int = 7) -> Graph:
    """Inserts the vectors one by one; a node's highest layer is drawn with chances 1 / m each."""
    n = len(vectors)
    draws = np.random.default_rng(seed).random(n)
    tops = np.floor(-np.log(np.maximum(draws, 1e-300)) / math.log(m)).astype(int)
    tops[0] = tops.max(initial=0)  # the first node is the way in at every layer
    layers = []
    for level in range(int(tops[0]) + 1):
        nodes = np.flatnonzero(tops >= level).astype(np.int32)
        layers.append(Layer(nodes, np.full((len(nodes), 2 * m if level == 0 else m), -1, np.int32)))
    graph = Graph(vectors, layers)
    for node in range(1, n):
        query, start = vectors[node], [0]
        for level in range(len(layers) - 1, -1, -1):
            layer = layers[level]
            if level > tops[node]:
                start = [graph.walk(query, start, 1, layer)[0][1]]
                continue
            found = graph.walk(query, start, width, layer)
            chosen = _spread(vectors, found, m)
            own = node if layer.row is None else layer.row[node]
            layer.neighbours[own, :len(chosen)] = chosen
            for other in chosen:
                row = layer.neighbours[other if layer.row is None else layer.row[other]]
                free = int((row >= 0).sum())
                if free < len(row):
                    row[free] = node
                else:
                    all_ = np.append(row, np.int32(node))
                    far = graph._far(vectors[other], all_)
                    kept = _spread(vectors, sorted(zip(far.tolist(), all_.tolist())), len(row))
                    row[:] = kept
            start = [n for _, n in found]
    return graph


# ---------------------------------------------------------------- jobs


def _vector(column: str) -> Column:
    """Components as doubles, -0 as 0; null if the vector takes no part."""
    parts = F.transform(F.col(column), lambda x: x.cast("double") + F.lit(0.0))
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad & F.exists(parts, lambda x: x != 0), parts)


def valid_rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, h1, h2): rows that take part; the two hashes name the vector."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), _vector(vector_col).alias("v"))
    return rows.where("id is not null and v is not null").withColumns({
        "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v"),
    })


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per shard graph (see ``INDEX_SCHEMA``). Write it as a table once, and read that."""
    nodes = rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.first("v").alias("v"))
    shards = max(1, math.ceil(rows.select("h1", "h2").distinct().count() / shard_rows))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def close(dim: int) -> pa.RecordBatch:
            own = waiting.pop(dim)
            vectors = np.array([v for *_, v in own])
            graph = build(vectors)
            h1, h2, least, most = zip(*(r[:4] for r in own))
            return pa.RecordBatch.from_pylist([{
                "shard": f"{dim}-{h1[0]}-{h2[0]}", "dim": dim, "h1": h1, "h2": h2, "least": least, "most": most,
                "vectors": vectors.tobytes(),
                "layers": [{
                    "nodes": x.nodes.tobytes(), "neighbours": x.neighbours.tobytes(),
                    "width": x.neighbours.shape[1],
                } for x in graph.layers],
            }], _INDEX_ARROW)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("h1", "h2", "least", "most", "v"))):
                own = waiting.setdefault(len(row[4]), [])
                own.append(row)
                if len(own) >= 2 * shard_rows:
                    yield close(len(row[4]))
        for dim in list(waiting):
            yield close(dim)

    dealt = nodes.repartition(shards, "h1", "h2").sortWithinPartitions("h1", "h2")
    return dealt.select("h1", "h2", "least", "most", "v").mapInArrow(index, INDEX_SCHEMA)


_INDEX_ARROW = pa.schema([
    ("shard", pa.string()), ("dim", pa.int32()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())),
    ("least", pa.list_(pa.int64())), ("most", pa.list_(pa.int64())), ("vectors", pa.binary()),
    ("layers", pa.list_(pa.struct([("nodes", pa.binary()), ("neighbours", pa.binary()), ("width", pa.int32())]))),
])


def load(row: dict) -> Graph:
    vectors = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
    layers = [
        Layer(np.frombuffer(x["nodes"], np.int32), np.frombuffer(x["neighbours"], np.int32).reshape(-1, x["width"]))
        for x in row["layers"]
    ]
    return Graph(vectors, layers)


def _search_block(index: DataFrame, ids: list[int], vectors: list[list[float]], k: int, width: int) -> DataFrame:
    asked = index.sparkSession.sparkContext.broadcast((ids, [np.array(v) for v in vectors]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                graph = load(row)
                h1, h2, least, most = (np.array(row[c], np.int64) for c in ("h1", "h2", "least", "most"))
                hits = []
                for own, query in zip(*asked.value):
                    if len(query) != row["dim"]:
                        continue
                    nodes, wide = np.zeros(0, np.int64), max(width, k)
                    while wide:
                        nodes = np.array(graph.nearest(query, wide))
                        more = len(nodes) == wide < len(least)
                        # Nodes that are all the query's own are no candidates.
                        nodes = nodes[(least[nodes] != own) | (most[nodes] != own)]
                        wide = 2 * wide if more and len(nodes) < k else 0
                    far = np.sqrt(((graph.vectors[nodes] - query) ** 2).sum(axis=1))
                    best = np.lexsort((least[nodes], far))[:k]
                    hits.append((np.full(len(best), own), nodes[best], far[best]))
                if hits:
                    own, nodes, far = map(np.concatenate, zip(*hits))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64()), *(pa.array(x[nodes]) for x in (h1, h2, least)), pa.array(far)],
                        names=["query_id", "h1", "h2", "least", "distance"],
                    )

    return one_per_task(index, "shard").mapInArrow(search, HIT_SCHEMA)


def query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[list, list]]:
    """Ids and vectors of the queries in lists of about ``block`` at most."""
    one = queries.groupBy("id").agg(F.min("v").alias("v"))
    count = one.count()
    # Blocks are dealt by hash; half of the bound leaves room for uneven shares.
    blocks = math.ceil(2 * count / block) if count > block else min(count, 1)
    for number in range(blocks):
        rows = one.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow()
        yield rows["id"].to_pylist(), rows["v"].to_pylist()


def search(
    spark: SparkSession, index: DataFrame, rows: DataFrame, queries: DataFrame, k: int, *,
    width: int = SEARCH_WIDTH, block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest found of each query. ``rows`` and ``queries``
    are as of ``valid_rows``; queries go to the tasks in blocks, each a pass over the index."""
    found = spark.createDataFrame([], HIT_SCHEMA)
    for ids, vectors in query_blocks(queries, block):
        found = found.unionByName(_search_block(index, ids, vectors, k, width))
    nearest = Window.partitionBy("query_id").orderBy("distance", "least", "h1", "h2")
    best = found.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k)
    ids = Window.partitionBy("h1", "h2").orderBy("id")
    members = rows.select("h1", "h2", "id").distinct().withColumn("_n", F.row_number().over(ids))
    members = members.where(F.col("_n") <= k + 1).drop("_n")
    named = best.drop("_n", "least").join(members, ["h1", "h2"]).where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("distance", "id", "h1", "h2")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance")
