"""An inverted index of passages: where every word stands, written once and read by word.

Passages are tokenised once. Some thousand of them, in the order in which they are read, make a
block, and a row of the index is a word in a block: the word's places, counted through the words
of all its passages without stop words, as steps from one to the next. A further row of the block
holds its passages' ids and first places. Word pairs are not stored, as places that follow
one another in a passage tell them. The rows lie in folders by the hash of the word, sorted by word, so
a search reads the folders of its words, keeps their rows, and brings the rows of a block
together; texts are not read again.

Defined results: a null text has no words; ids tell passages apart; copies are passages of their
own. A block ends at ``BLOCK_TOKENS`` words or ``BLOCK_PASSAGES`` passages; a longer passage is a
block of its own.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.functions import text as T
from quizloom.operators.blocks import entry_runs

BLOCK_PASSAGES = 4096
BLOCK_TOKENS = 1 << 19
FOLDERS = 64
_BLOCK_FOLDER = -1  # of the rows of ids
# Words of a search that are sent to the tasks; more are joined by a shuffle. The rows are the same.
SENT_BYTES = 8 << 20

_ROWS = "word string, block long, ids binary, steps binary"


def _folder(word: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(folders)).cast("int")


def _steps(places: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The places of all words, word after word, as one entry of steps a word; a word's places end at
    ``ends``."""
    steps = np.diff(places, prepend=0).astype("<i4")
    starts = np.concatenate([[0], ends[:-1]])
    starts = starts[starts < ends]
    steps[starts] = places[starts]
    offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(steps)])


def _places(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, "<i4"), dtype=np.int64)


def _invert(
    batches: Iterator[pa.RecordBatch], most_passages: int, most_tokens: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch["tokens"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, last in entry_runs(lengths, most_tokens, most_passages):
            block = batch.slice(first, last - first)
            size = lengths[first:last]
            words = block["tokens"].flatten().dictionary_encode()
            code = words.indices.to_numpy()
            # The row of ids comes last, with the first places of the passages.
            places = np.concatenate([np.argsort(code, kind="stable"), np.cumsum(size) - size])
            ends = np.cumsum([*np.bincount(code, minlength=len(words.dictionary)), len(size)])
            ids = block["passage_id"].to_numpy().astype("<i8").tobytes()
            name = uuid.uuid4().int >> 65
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([words.dictionary, pa.nulls(1, pa.string())]),
                pa.array(np.full(len(ends), name, np.int64)),
                pa.concat_arrays([pa.nulls(len(ends) - 1, pa.binary()), pa.array([ids], pa.binary())]),
                _steps(places, ends),
            ], names=["word", "block", "ids", "steps"])


@dataclass(frozen=True)
class Postings:
    """A stored index: ``rows`` (word, block, ids, steps, folder)."""

    rows: DataFrame
    folders: int

    @property
    def passages(self) -> DataFrame:
        """(passage_id) of all passages, from the blocks' rows of ids."""

        def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch["ids"]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row.as_py(), "<i8"))], names=["passage_id"])

        return self.rows.where(F.col("folder") == _BLOCK_FOLDER).select("ids").mapInArrow(ids, "passage_id long")

    def of_words(self, words: list[str]) -> DataFrame:
        """The rows of the given words, with ``code``, a word's number in the list."""
        spark = self.rows.sparkSession
        listed = spark.createDataFrame(
            pa.table({"word": pa.array(words, pa.string()), "code": pa.array(range(len(words)), pa.int32())}))
        if sum(map(len, words)) + 48 * len(words) <= SENT_BYTES:
            listed = F.broadcast(listed)
        folders = spark.createDataFrame(pa.table({"word": pa.array(words, pa.string())})).select(
            _folder(F.col("word"), self.folders).alias("folder")).distinct().collect()
        read = self.rows.where(F.col("folder").isin(*sorted(r["folder"] for r in folders)))
        return read.join(listed, "word").select("block", "code", "ids", "steps")

    def sparse_rows(self, words: list[str], pairs: np.ndarray) -> DataFrame:
        """(passage_id, terms, tfs) of all passages: the numbers of the words of the list that they
        hold, and behind them of ``pairs`` (first number * number of words + second, ascending), and
        how often each occurs."""
        shared = self.rows.sparkSession.sparkContext.broadcast(pairs)
        n_words = len(words)

        def of_block(table: pa.Table) -> pa.Table:
            table = table.sort_by("code")  # the row of ids comes first
            ids = np.frombuffer(table["ids"][0].as_py(), "<i8")
            listed = [_places(x) for x in table["steps"].to_pylist()]
            starts, found = listed[0], listed[1:]
            sizes = np.array([len(x) for x in found], np.int64)
            code = np.repeat(table["code"].to_numpy()[1:], sizes).astype(np.int64)
            place = np.concatenate([np.zeros(0, np.int64), *found])
            order = np.argsort(place)
            place, code = place[order], code[order]
            row = np.searchsorted(starts, place, "right") - 1  # passages without words end where they start
            return _sparse(ids, row, place, code, n_words, shared.value)

        whole = self.rows.where(F.col("folder") == _BLOCK_FOLDER).select("block", F.lit(-1).alias("code"), "ids", "steps")
        return self.of_words(words).unionByName(whole).groupBy("block").applyInArrow(
            of_block, "passage_id long, terms array<int>, tfs array<int>")


def _sparse(ids, row, place, code, n_words: int, pairs: np.ndarray) -> pa.Table:
    """Counts of words and pairs by passage, from words in order of passage and place."""
    n_terms = n_words + len(pairs)
    cells = [row * n_terms + code]
    if len(pairs) and len(code) > 1:
        next_ = (row[:-1] == row[1:]) & (place[1:] == place[:-1] + 1)
        key = code[:-1][next_] * n_words + code[1:][next_]
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        hit = pairs[at] == key
        cells.append(row[:-1][next_][hit] * n_terms + n_words + at[hit])
    cell, tf = np.unique(np.concatenate(cells), return_counts=True)
    of_row, term = np.divmod(cell, max(1, n_terms))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of_row, minlength=len(ids)))]), pa.int32())
    return pa.table({
        "passage_id": pa.array(ids, pa.int64()), "terms": pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
        "tfs": pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())),
    })


def write(passages: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Index of (passage_id, text) below ``path``. Tokens are cut in the JVM and inverted where they
    are; what is shuffled are rows of the index, to their folders."""
    tokens = passages.select(
        F.col("passage_id").cast("long").alias("passage_id"),
        T.drop_stop_words(T.tokenise(T.scoring_text(F.col("text")))).alias("tokens"),
    )
    folder = F.coalesce(F.when(F.col("word").isNotNull(), _folder(F.col("word"), folders)), F.lit(_BLOCK_FOLDER))
    sizes = {"most_passages": BLOCK_PASSAGES, "most_tokens": BLOCK_TOKENS}
    rows = tokens.mapInArrow(functools.partial(_invert, **sizes), _ROWS).withColumn("folder", folder)
    placed = rows.hint("rebalance", "folder").sortWithinPartitions("folder", "word")
    placed.write.partitionBy("folder").parquet(path)


def read(spark: SparkSession, path: str, folders: int = FOLDERS) -> Postings:
    return Postings(spark.read.schema(f"{_ROWS}, folder int").parquet(path), folders)
