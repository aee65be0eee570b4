"""Helpers for searching a large table block by block against a bounded query block.

Spark partitions the large table; each task keeps only the k best rows per query, so the
query-by-row pairs never become table rows. The partial results meet in one ranking window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Scores are compared after rounding to six places, as whole numbers.
SCALE = 1_000_000
_NONE = np.iinfo(np.int64).max

# Upper bounds for one query block on the driver and in each task: vectors, their components,
# and term counts.
MAX_BLOCK_ROWS = 50_000
MAX_BLOCK_VALUES = 16_000_000
MAX_BLOCK_TERMS = 4_000_000
# Cells of one dense score block inside a task.
BLOCK_CELLS = 1_000_000
# Entries of lists, such as tokens, that a task takes on at a time.
RUN_ENTRIES = 1 << 18
# Groups of tasks whose results are merged before all are.
MERGE_GROUPS = 256
# Entries of running results a task may hold before it hands them on.
MAX_STATE_ENTRIES = 8_000_000


NEIGHBOUR_SCHEMA = "shard int, query_id long, passage_id long, distance_key long"


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column of equal-length vectors as a matrix."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if lengths.size and lengths.min() != lengths.max():
        raise ValueError("vectors of different length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


def distance_keys(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared L2 distances (queries x rows) as whole numbers of the sixth place."""
    square = (
        (queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None, :]
        - 2.0 * (queries @ rows.T)
    )
    return np.rint(np.maximum(square, 0.0) * SCALE).astype(np.int64)


class RunningTopK:
    """The k smallest (key, id) per query over all blocks seen so far."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.keys = np.full((n_queries, k), _NONE, dtype=np.int64)
        self.ids = np.full((n_queries, k), _NONE, dtype=np.int64)

    def push(self, keys: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Take in ``keys`` (queries x rows) for row ``ids`` in ascending order."""
        rows, width = keys.shape
        if rows == 0 or width == 0:
            return
        at = np.arange(len(self.ids)) if queries is None else queries
        better = keys.min(axis=1) <= self.keys[at, -1]
        if not better.all():
            keys, at = keys[better], at[better]
            if at.size == 0:
                return
        take = min(self.k, width)
        if take < width:
            best = self._smallest(keys, take)
            keys = np.take_along_axis(keys, best, axis=1)
            ids = ids[best]
        else:
            ids = np.broadcast_to(ids, keys.shape)
        keys = np.concatenate([self.keys[at], keys], axis=1)
        ids = np.concatenate([self.ids[at], ids], axis=1)
        order = np.lexsort((ids, keys), axis=-1)[:, : self.k]
        self.keys[at] = np.take_along_axis(keys, order, axis=1)
        self.ids[at] = np.take_along_axis(ids, order, axis=1)

    @staticmethod
    def _smallest(keys: np.ndarray, take: int) -> np.ndarray:
        width = keys.shape[1]
        if np.abs(keys).max() < (1 << 62) // width:
            unique = keys * width + np.arange(width)
            return np.argpartition(unique, take - 1, axis=1)[:, :take]
        return np.argsort(keys, axis=1, kind="stable")[:, :take]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query position, id and key of every filled entry."""
        query, place = np.nonzero(self.ids != _NONE)
        return query, self.ids[query, place], self.keys[query, place]


def row_slices(n_rows: int, n_queries: int) -> Iterator[slice]:
    """Slices of a batch whose score block stays within ``BLOCK_CELLS``."""
    step = max(1, BLOCK_CELLS // max(1, n_queries))
    for start in range(0, n_rows, step):
        yield slice(start, min(start + step, n_rows))


def entry_runs(lengths: np.ndarray, most_entries: int, most_rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of rows whose lists hold ``most_entries`` entries at most together; a longer
    list is a run of its own."""
    first, entries = 0, 0
    for i, length in enumerate(lengths.tolist()):
        if i > first and (entries + length > most_entries or i - first == most_rows):
            yield first, i
            first, entries = i, 0
        entries += length
    if len(lengths) > first:
        yield first, len(lengths)


def list_runs(batches: Iterator[pa.RecordBatch], lists: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, ``RUN_ENTRIES`` entries of a list column at a time: what a task works
    out from them is then bounded, whatever the lengths of the lists."""
    for batch in batches:
        lengths = batch.column(lists).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for first, end in entry_runs(lengths, RUN_ENTRIES):
            yield batch.slice(first, end - first)


def keep_ranked(
    df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank"
) -> DataFrame:
    """Rank inside ``by`` and keep the first ``k``; Spark cuts partial groups early."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def merge_ranked(
    df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank"
) -> DataFrame:
    """``keep_ranked`` of the partial results of many tasks in two steps: tasks are dealt to
    ``MERGE_GROUPS`` groups, of which each keeps its first ``k``, and those are ranked. A ranking
    so meets the rows of a share of the tasks, and then ``k`` rows per group."""
    dealt = df.withColumn("_group", F.spark_partition_id() % F.lit(MERGE_GROUPS))
    return keep_ranked(keep_ranked(dealt, [*by, "_group"], order, k, rank).drop("_group", rank), by, order, k, rank)


def union_all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
