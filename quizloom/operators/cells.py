"""Vector search over stored cells.

``learn`` makes a tree of cells for every shard: a node with more rows than a cell may hold is
divided by k-means of a sample of its rows, again and again, so cells are bounded in size wherever
the rows differ. ``store`` writes the rows in blocks, a folder per shard and cell. ``search`` makes
a table of probes, (query, cell), from the queries where they lie, packs it by cell and joins it
to the stored blocks: a cell meets its own queries only, folders that no query probes are pruned at run time, and
a block of rows meets a block of queries as two matrices in one task. No vector goes to the
driver but the cells' centres, whose number is bounded.

With ``exact`` a second set of probes follows: the cells that may still hold one of the k nearest,
as their centre is no further than the k-th distance found plus the cell's radius. The
result is then that of a full search, whatever the vectors; how many cells that leaves out
depends on how well the vectors fall into groups.

Null vectors take no part. Ids tell the rows of a shard apart. Equal distances go by id. Rows that
are copies of one vector cannot be divided and stay one cell, which lies in many blocks and files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.functions import vectors as V
from quizloom.operators import blocks as B
from quizloom.runtime import materialise

CELL_ROWS = 4096
# Rows of a node from which its division is learnt, and most parts of one division.
SAMPLE_ROWS = 16_384
FAN = 64
ROUNDS = 9
ITERATIONS = 8
# Rows of a stored block, and queries of a block of probes.
BLOCK_ROWS = 1024
_SAMPLE_RANGE = 1_000_000_000

_ROWS = "shard int, cell long, passage_id long, v array<double>, gap double"
_BLOCKS = "shard int, cell long, ids binary, vectors binary"


@dataclass(frozen=True)
class Cells:
    """Centres by (shard, cell), with the largest squared distance of a cell's rows to its centre."""

    shards: np.ndarray
    cells: np.ndarray
    centres: np.ndarray
    radius: np.ndarray

    def of_shard(self, shard: int) -> slice:
        """Rows are in order of shard."""
        return slice(*np.searchsorted(self.shards, [shard, shard + 1]).tolist())


def _usable(passages: DataFrame) -> DataFrame:
    return passages.where(F.col("v").isNotNull()).select(
        F.col("shard").cast("int").alias("shard"), "passage_id", V.as_double(F.col("v")).alias("v"))


def _kmeans(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most ``k`` centres, begun at rows chosen far from those before."""
    make = np.random.default_rng(seed)
    centres = rows[make.integers(len(rows))][None, :]
    gap = ((rows - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and gap.max() > 1e-12:
        centres = np.vstack([centres, rows[make.choice(len(rows), p=gap / gap.sum())]])
        gap = np.minimum(gap, ((rows - centres[-1]) ** 2).sum(axis=1))
    for _ in range(ITERATIONS):
        own = ((centres**2).sum(axis=1)[None, :] - 2.0 * (rows @ centres.T)).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        count = np.bincount(own, minlength=len(centres))
        centres = sums[count > 0] / count[count > 0, None]
    return centres


def _divide(rows: DataFrame, nodes: DataFrame, cell_rows: int, seed: int) -> list:
    """(shard, cell, centres) of the parts of each node, learnt in a task per node."""
    limit = F.least(F.lit(1.0), F.lit(float(SAMPLE_ROWS)) / F.col("rows")) * _SAMPLE_RANGE
    place = F.pmod(F.xxhash64("passage_id", F.lit(seed)), F.lit(_SAMPLE_RANGE))
    sample = rows.join(nodes, ["shard", "cell"]).where(place < limit).select("shard", "cell", "rows", "v")

    def learn(group: pa.Table) -> pa.Table:
        parts = min(FAN, -(-2 * group["rows"][0].as_py() // cell_rows))
        found = _kmeans(B.matrix(group["v"].combine_chunks()), parts, seed)
        return group.slice(0, 1).select(["shard", "cell"]).append_column("centres", pa.array([found.ravel().tolist()]))

    schema = "shard int, cell long, centres array<double>"
    return sample.groupBy("shard", "cell").applyInArrow(learn, schema).collect()


def _move(rows: DataFrame, parts: list, dim: int) -> DataFrame:
    """Rows of divided nodes in the nearest part, map-side; ties go to the lower part."""
    listed = {(r["shard"], r["cell"]): np.array(r["centres"]).reshape(-1, dim) for r in parts}
    shared = rows.sparkSession.sparkContext.broadcast(listed)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = B.matrix(batch["v"])
            shard, cell = (batch[c].to_numpy() for c in ("shard", "cell"))
            cell, gap = cell.copy(), batch["gap"].to_numpy().copy()
            for key, at in _runs(shard, cell):
                centres = shared.value.get(key)
                if centres is not None:
                    near = np.stack([((matrix[at] - c) ** 2).sum(axis=1) for c in centres], axis=1)
                    best = near.argmin(axis=1)
                    cell[at], gap[at] = key[1] * (FAN + 1) + 1 + best, near[np.arange(len(at)), best]
            yield pa.RecordBatch.from_arrays(
                [batch["shard"], pa.array(cell), batch["passage_id"], batch["v"], pa.array(gap)], names=batch.schema.names)

    return rows.mapInArrow(move, _ROWS)


def _runs(*keys: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
    """The places of each distinct key, keys in ascending order."""
    if not len(keys[0]):
        return
    order = np.lexsort(keys[::-1])
    border = np.zeros(len(order) - 1, bool)
    for key in keys:
        border |= np.diff(key[order]) != 0
    for at in np.split(order, np.flatnonzero(border) + 1):
        yield tuple(key[at[0]].item() for key in keys), at


def learn(passages: DataFrame, cell_rows: int = CELL_ROWS, seed: int = 42) -> tuple[DataFrame, Cells]:
    """Rows with their cells, (shard, cell, passage_id, v), written once, and the cells.

    Cells are larger than ``cell_rows`` where their centres would not fit a block of
    ``MAX_BLOCK_VALUES`` numbers, which is what goes to the tasks.
    """
    rows = materialise(_usable(passages).select(
        "shard", F.lit(0).cast("long").alias("cell"), "passage_id", "v", F.lit(0.0).alias("gap")))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = total["dim"] or 1
    cell_rows = max(cell_rows, -(-8 * total["n"] * dim // B.MAX_BLOCK_VALUES))
    centres: dict[tuple[int, int], np.ndarray] = {}
    whole: set[tuple[int, int]] = set()  # nodes of copies, which no division parts
    for number in range(ROUNDS):
        nodes = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("rows"))
        if number:
            nodes = nodes.where(F.col("rows") > cell_rows)
            if whole:
                done = rows.sparkSession.createDataFrame(sorted(whole), "shard int, cell long")
                nodes = nodes.join(done, ["shard", "cell"], "left_anti")
        parts = _divide(rows, nodes, cell_rows, seed + number)
        whole |= {(r["shard"], r["cell"]) for r in parts if number and len(r["centres"]) == dim}
        parts = [r for r in parts if (r["shard"], r["cell"]) not in whole]
        if not parts:
            break
        for r in parts:
            for i, centre in enumerate(np.array(r["centres"]).reshape(-1, dim)):
                centres[r["shard"], r["cell"] * (FAN + 1) + 1 + i] = centre
        rows = materialise(_move(rows, parts, dim))
    sizes = rows.groupBy("shard", "cell").agg(F.max("gap").alias("gap")).collect()
    found = sorted((r["shard"], r["cell"], r["gap"]) for r in sizes)
    return rows.drop("gap"), Cells(
        np.array([s for s, _, _ in found], np.int64), np.array([c for _, c, _ in found], np.int64),
        np.array([centres[s, c] for s, c, _ in found]).reshape(len(found), dim), np.array([g for _, _, g in found]),
    )


def given(rows: DataFrame, centroids: DataFrame) -> Cells:
    """Cells of given centres (cell, v), the same in every shard of ``rows`` (shard, cell, …); radii
    are not known."""
    listed = centroids.select("cell", V.as_double(F.col("v")).alias("v")).limit(B.MAX_BLOCK_ROWS + 1).toArrow()
    matrix = B.matrix(listed["v"].combine_chunks())
    if len(matrix) > B.MAX_BLOCK_ROWS or matrix.size > B.MAX_BLOCK_VALUES:
        raise ValueError("more centres than a block holds")
    ids = listed["cell"].to_numpy().astype(np.int64)
    order = np.argsort(ids)
    shards = sorted(r["shard"] for r in rows.select("shard").distinct().collect())
    return Cells(
        np.repeat(np.array(shards, np.int64), len(ids)), np.tile(ids[order], len(shards)),
        np.tile(matrix[order], (len(shards), 1)), np.full(len(ids) * len(shards), np.inf),
    )


def _packed(rows: DataFrame, id_column: str) -> DataFrame:
    """Neighbouring rows of a cell as one block: ids and vectors as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix, ids = B.matrix(batch["v"]), batch[id_column].to_numpy()
            out = []
            for (shard, cell), at in _runs(*(batch[c].to_numpy() for c in ("shard", "cell"))):
                for first in range(0, len(at), BLOCK_ROWS):
                    own = at[first:first + BLOCK_ROWS]
                    out.append((shard, cell, ids[own].astype("<i8").tobytes(), matrix[own].astype("<f8").tobytes()))
            columns = zip(*out)
            yield pa.RecordBatch.from_arrays([
                pa.array(values, kind) for values, kind in
                zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))
            ], names=["shard", "cell", "ids", "vectors"])

    keys = [F.col("shard").cast("int").alias("shard"), F.col("cell").cast("long").alias("cell")]
    return rows.select(*keys, id_column, "v").mapInArrow(pack, _BLOCKS)


def store(rows: DataFrame, path: str, by: tuple[str, ...] = ("shard", "cell")) -> None:
    """Rows with cells in blocks, a folder per shard and cell, or per cell if all shards have the same ones.
    Rows of a folder are brought together first; adaptive execution deals a large one's rows to
    several tasks."""
    placed = rows.hint("rebalance", *by).sortWithinPartitions(*by, "passage_id")
    _packed(placed, "passage_id").write.partitionBy(*by).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ids binary, vectors binary, shard int, cell long").parquet(path)


_PROBES = "shard int, cell long, query_id long, v array<double>, rank int"


def _nearest_cells(queries: DataFrame, cells: Cells, nprobe: int) -> DataFrame:
    """(shard, cell, query_id, v, rank): the cells nearest to each query in every shard."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = B.matrix(batch["v"])
            for shard in np.unique(own.shards).tolist():
                at = own.of_shard(shard)
                for part in B.row_slices(len(matrix), at.stop - at.start):
                    keys = B.distance_keys(matrix[part], own.centres[at])
                    order = np.argsort(keys, axis=1, kind="stable")[:, :nprobe]
                    yield _probe_rows(batch.slice(part.start, len(keys)), shard, own.cells[at][order])

    return queries.select("query_id", V.as_double(F.col("v")).alias("v")).mapInArrow(probe, _PROBES)


def _probe_rows(batch: pa.RecordBatch, shard: int, cells: np.ndarray) -> pa.RecordBatch:
    """A row per query and cell; ``cells`` has a line for each row of the batch."""
    count, width = cells.shape
    take = pa.array(np.repeat(np.arange(count), width))
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(cells.size, shard, np.int32)), pa.array(cells.ravel()), batch["query_id"].take(take),
        batch["v"].take(take), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
    ], names=["shard", "cell", "query_id", "v", "rank"])


def _open_cells(queries: DataFrame, cells: Cells, found: DataFrame, k: int, nprobe: int) -> DataFrame:
    """Further probes of the cells that may hold one of the k nearest of a (shard, query)."""
    last = found.groupBy("shard", "query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("distance_key").alias("key")
    ).where(F.col("n") >= k).groupBy("query_id").agg(F.collect_list(F.struct("shard", "key")).alias("last"))
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = B.matrix(batch["v"])
            known = [{one["shard"]: one["key"] for one in row or ()} for row in batch["last"].to_pylist()]
            for shard in np.unique(own.shards).tolist():
                at = own.of_shard(shard)
                bound = np.array([row.get(shard, np.iinfo(np.int64).max) for row in known], np.float64)
                for part in B.row_slices(len(matrix), at.stop - at.start):
                    keys = B.distance_keys(matrix[part], own.centres[at])
                    probed = np.argsort(keys, axis=1, kind="stable")[:, :nprobe]
                    least = np.maximum(np.sqrt(keys / B.SCALE) - np.sqrt(own.radius[at]) - 2e-3, 0.0) ** 2
                    open_ = least * B.SCALE <= bound[part][:, None] + 2
                    np.put_along_axis(open_, probed, False, axis=1)
                    query, cell = np.nonzero(open_)
                    rows = batch.slice(part.start, len(keys)).take(pa.array(query))
                    yield _probe_rows(rows, shard, own.cells[at][cell][:, None])

    asked = queries.select("query_id", V.as_double(F.col("v")).alias("v")).join(last, "query_id", "left")
    return asked.select("query_id", "v", "last").mapInArrow(probe, _PROBES)


def _scored(stored: DataFrame, probes: DataFrame, queries: int, k: int) -> DataFrame:
    """Partial neighbours of the probes: blocks of rows joined to blocks of queries by cell."""
    share = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries // BLOCK_ROWS))))
    placed = probes.repartition("shard", "cell", share).sortWithinPartitions("shard", "cell", share, "query_id")
    asked = _packed(placed, "query_id").select(
        "shard", "cell", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    both = stored.join(asked, ["shard", "cell"]).select("shard", "ids", "vectors", "query_ids", "query_vectors")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                found = [_best_of_pair(shard.as_py(), *(v.as_buffer() for v in packed), k)
                         for shard, *packed in zip(*(c.slice(first, 64) for c in batch.columns))]
                shard, query, passage, key = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((passage, key, query, shard))
                shard, query, passage, key = (c[order] for c in (shard, query, passage, key))
                start = np.ones(len(order), bool)
                start[1:] = (np.diff(shard) != 0) | (np.diff(query) != 0)
                starts = np.flatnonzero(start)
                rank = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
                keep = rank < k
                columns = (shard.astype(np.int32), query, passage, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[keep]) for c in columns], names=["shard", "query_id", "passage_id", "distance_key"])

    return both.mapInArrow(score, B.NEIGHBOUR_SCHEMA)


def _best_of_pair(
    shard: int, ids: pa.Buffer, vectors: pa.Buffer, query_ids: pa.Buffer, query_vectors: pa.Buffer, k: int
):
    row_ids, asked = np.frombuffer(ids, "<i8"), np.frombuffer(query_ids, "<i8")
    rows = np.frombuffer(vectors, "<f8").reshape(len(row_ids), -1)
    wanted = np.frombuffer(query_vectors, "<f8").reshape(len(asked), -1)
    state = B.RunningTopK(len(asked), k)
    for part in B.row_slices(len(rows), len(asked)):
        state.push(B.distance_keys(wanted, rows[part]), row_ids[part])
    query, passage, key = state.rows()
    return np.full(len(query), shard, np.int64), asked[query], passage, key


def search(
    queries: DataFrame, stored: DataFrame, cells: Cells, k: int = K.DENSE_K, nprobe: int = K.NPROBE,
    exact: bool = False,
) -> DataFrame:
    """The ``k`` nearest rows per (shard, query) of the ``nprobe`` cells nearest to the query, and with
    ``exact`` of all rows: (shard, query_id, passage_id, distance, rank).

    ``queries`` is (query_id, v); ``stored`` is what ``read`` gives.
    """
    queries = materialise(queries.where(F.col("v").isNotNull()).select("query_id", "v"))
    number = queries.count()
    # The condition on the rank is what tells the optimiser that probes select folders.
    probes = materialise(_nearest_cells(queries, cells, nprobe)).where(F.col("rank") <= nprobe)
    place = ["shard", "query_id"], ["distance_key", "passage_id"], k
    found = B.merge_ranked(_scored(stored, probes, number, k), *place)
    if exact:
        found = materialise(found.drop("rank"))
        more = materialise(_open_cells(queries, cells, found, k, nprobe)).where(F.col("rank") <= 1)
        found = B.merge_ranked(found.unionByName(_scored(stored, more, number, k)), *place)
    distance = (F.col("distance_key") / F.lit(float(B.SCALE))).alias("distance")
    return found.select("shard", "query_id", "passage_id", distance, "rank")
