"""Dense retrieval: exact and cell-pruned nearest neighbours, candidate pool, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.functions import vectors as V
from quizloom.operators import blocks as B
from quizloom.runtime import dense_row_id, materialise


def normalise(df: DataFrame, column: str = "v") -> DataFrame:
    return df.withColumn(column, V.l2_normalise(V.as_double(F.col(column))))


def _bounded(df: DataFrame, id_column: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and matrix in id order, or None if there are more vectors than a block may hold."""
    table = df.select(id_column, "v").limit(B.MAX_BLOCK_ROWS + 1).toArrow()
    ids = table.column(id_column).to_numpy()
    vectors = B.matrix(table.column("v").combine_chunks())
    if table.num_rows > B.MAX_BLOCK_ROWS or vectors.size > B.MAX_BLOCK_VALUES:
        return None
    order = np.argsort(ids)
    return ids[order], vectors[order]


def vector_blocks(
    vectors: DataFrame, id_column: str = "query_id"
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors in blocks of bounded size. Sizes are counted before a vector is fetched. Usually
    there is one block; a larger table is split by hash, and a part that is still too large is
    split again."""
    vectors = materialise(_usable(vectors))
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    limit = max(1, min(B.MAX_BLOCK_ROWS, B.MAX_BLOCK_VALUES // (sizes["dim"] or 1)))
    if sizes["n"] <= limit:
        yield _bounded(vectors, id_column)
        return
    parts = -(-5 * sizes["n"] // (4 * limit))
    pending = [(part, parts) for part in range(parts)]
    while pending:
        part, of = pending.pop(0)
        block = vectors.where(F.pmod(F.xxhash64(id_column), F.lit(of)) == part)
        found = _bounded(block, id_column)
        if found is None:
            pending += [(part, 2 * of), (part + of, 2 * of)]
        else:
            yield found


def _usable(df: DataFrame) -> DataFrame:
    return df.where(F.col("v").isNotNull())


def _search(passages: DataFrame, query_ids, query_matrix, k: int, probes=None) -> DataFrame:
    """Partial neighbours of one query block per task.

    ``probes`` maps a cell to the positions of the queries that look into it; without it
    every query meets every row. The running state is kept per shard.
    """
    shared = passages.sparkSession.sparkContext.broadcast((query_ids, query_matrix, probes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, matrix_q, cells = shared.value
        states: dict[int, B.RunningTopK] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for shard, state in states.items():
                query, ids, keys = state.rows()
                if ids.size:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(ids.size, shard, dtype=np.int32)),
                            pa.array(ids_q[query]),
                            pa.array(ids),
                            pa.array(keys),
                        ],
                        names=["shard", "query_id", "passage_id", "distance_key"],
                    )
            states.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            ids = batch.column("passage_id").to_numpy(zero_copy_only=False)
            rows = B.matrix(batch.column("v"))
            cell = 0 * shards
            if cells is not None:
                cell = batch.column("cell").to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, cell, shards))
            border = (np.diff(shards[order]) != 0) | (np.diff(cell[order]) != 0)
            for at in np.split(order, np.flatnonzero(border) + 1):
                who = None if cells is None else cells.get(int(cell[at[0]]))
                if cells is not None and who is None:
                    continue
                wanted = matrix_q if who is None else matrix_q[who]
                shard = int(shards[at[0]])
                if shard not in states:
                    if (len(states) + 1) * ids_q.size * k > B.MAX_STATE_ENTRIES:
                        yield from flush()
                    states[shard] = B.RunningTopK(ids_q.size, k)
                for part in B.row_slices(at.size, len(wanted)):
                    chosen = at[part]
                    states[shard].push(B.distance_keys(wanted, rows[chosen]), ids[chosen], who)
        yield from flush()

    if probes is None:
        rows = passages.select("shard", "passage_id", "v")
    else:
        # A sort inside the partitions, no shuffle: rows of a cell are scored together.
        rows = passages.select("shard", "passage_id", "v", "cell").sortWithinPartitions(
            "shard", "cell"
        )
    return rows.mapInArrow(search, B.NEIGHBOUR_SCHEMA)


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    best = B.merge_ranked(
        B.union_all(parts), ["shard", "query_id"], ["distance_key", "passage_id"], k
    )
    return best.select(
        "shard", "query_id", "passage_id",
        (F.col("distance_key") / F.lit(float(B.SCALE))).alias("distance"), "rank",
    )


def topk_per_shard(queries: DataFrame, passages: DataFrame, k: int = K.DENSE_K) -> DataFrame:
    """The exact ``k`` nearest passages per (shard, query) by squared distance.

    ``queries`` is (query_id, v), ``passages`` is (shard, passage_id, v). Passages are read
    once per query block and not shuffled; equal distances go by passage_id.
    """
    passages = _usable(passages)
    parts = []
    for ids, matrix in vector_blocks(queries):
        if ids.size:
            parts.append(_search(passages, ids, matrix, k))
    if not parts:
        parts = [passages.sparkSession.createDataFrame([], B.NEIGHBOUR_SCHEMA)]
    return _ranked(parts, k)


def train_centroids(
    passages: DataFrame, cells: int, seed: int = 42, iterations: int = 20
) -> DataFrame:
    """Cell centres (cell, v) by distributed k-means."""
    points = passages.select(array_to_vector(V.as_double(F.col("v"))).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=iterations).fit(points)
    rows = [(i, [float(x) for x in centre]) for i, centre in enumerate(model.clusterCenters())]
    return passages.sparkSession.createDataFrame(rows, "cell int, v array<double>")


_CELL_SCHEMA = "shard int, passage_id long, v array<double>, cell int, distance_key long"


def assign_cells(passages: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add the nearest cell to every passage, map-side; ties go to the lower cell.

    Centres beyond one block are compared block after block. Write the result partitioned by
    ``cell`` and a search reads only the cells it probes.
    """
    rows = _usable(passages).select(
        F.col("shard").cast("int").alias("shard"), "passage_id",
        V.as_double(F.col("v")).alias("v"), F.lit(-1).alias("cell"),
        F.lit(np.iinfo(np.int64).max).alias("distance_key"),
    )
    for block in vector_blocks(centroids, "cell"):
        rows = rows.mapInArrow(_nearest_cell(passages, *block), _CELL_SCHEMA)
    return rows.drop("distance_key")


def _nearest_cell(passages: DataFrame, cell_ids: np.ndarray, centres: np.ndarray):
    """Batch function that keeps the better of the cell so far and those of one block."""
    shared = passages.sparkSession.sparkContext.broadcast((cell_ids.astype(np.int32), centres))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = B.matrix(batch.column("v"))
            cell = batch.column("cell").to_numpy(zero_copy_only=False).copy()
            best = batch.column("distance_key").to_numpy(zero_copy_only=False).copy()
            for part in B.row_slices(len(rows), len(matrix)):
                keys = B.distance_keys(matrix, rows[part])
                first = keys.argmin(axis=0)
                key, name = keys[first, np.arange(first.size)], names[first]
                wins = (key < best[part]) | ((key == best[part]) & (name < cell[part]))
                cell[part] = np.where(wins, name, cell[part])
                best[part] = np.where(wins, key, best[part])
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("passage_id"), batch.column("v"),
                 pa.array(cell), pa.array(best)],
                names=["shard", "passage_id", "v", "cell", "distance_key"],
            )

    return nearest


def ivf_topk(
    queries: DataFrame,
    cell_passages: DataFrame,
    centroids: DataFrame,
    k: int = K.DENSE_K,
    nprobe: int = K.NPROBE,
) -> DataFrame:
    """Nearest passages among the ``nprobe`` cells nearest to each query.

    ``cell_passages`` is the output of ``assign_cells``. The filter on ``cell`` prunes
    partitions of a table written by cell. A cell that holds a large share of all rows is
    spread over the tasks like any other rows, since nothing is grouped by cell.
    """
    cell_passages = _usable(cell_passages)
    parts = []
    for ids, matrix in vector_blocks(queries):
        near = B.RunningTopK(ids.size, nprobe)
        for cell_ids, centres in vector_blocks(centroids, "cell"):
            for part in B.row_slices(cell_ids.size, ids.size):
                keys = B.distance_keys(matrix, centres[part])
                near.push(keys, cell_ids[part].astype(np.int64))
        query, cell, _ = near.rows()
        order = np.lexsort((query, cell))
        groups = np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if cell.size else []
        probes = {int(cell[at[0]]): query[at] for at in groups}
        if probes:
            wanted = cell_passages.where(F.col("cell").isin(*probes))
            parts.append(_search(wanted, ids, matrix, k, probes))
    if not parts:
        parts = [queries.sparkSession.createDataFrame([], B.NEIGHBOUR_SCHEMA)]
    return _ranked(parts, k)


def keep_nearest(neighbours: DataFrame, keep: int = K.DENSE_KEEP) -> DataFrame:
    return neighbours.where(F.col("rank") <= keep)


def candidate_pool(neighbours: DataFrame, passages: DataFrame) -> DataFrame:
    """Distinct texts over all shards and queries, each with its smallest passage_id.

    The ids shrink to a distinct set, written once, before any text is read; Spark sends it out
    if it is small. ``min`` is combined before the shuffle, so many copies of one text do not
    meet in one task.
    """
    wanted = materialise(neighbours.select("passage_id").distinct())
    return (
        passages.join(wanted, "passage_id", "left_semi")
        .groupBy("text")
        .agg(F.min("passage_id").alias("passage_id"))
        .select("passage_id", "text")
    )


def align_texts(vectors: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of a shard joined to its vectors' ids by row number."""
    ids = vectors.select("shard", "row_no", "passage_id")
    return ids.join(texts.select("shard", "row_no", "text"), ["shard", "row_no"])


def row_batches(df: DataFrame, order_by: list, n: int = K.ENCODE_BATCH) -> DataFrame:
    """Batch number of every row, ``n`` rows to a batch in the given order."""
    return dense_row_id(df, order_by, "row_id").withColumn(
        "batch", F.floor(F.col("row_id") / F.lit(n)).cast("long")
    )
