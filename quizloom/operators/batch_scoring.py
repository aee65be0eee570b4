"""Hooks for user models, and a stand-in text encoder that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quizloom.functions import text as T
from quizloom.operators import blocks as B

BatchFunction = Callable[[pd.DataFrame], pd.DataFrame]


def apply_batches(
    df: DataFrame, make_function: Callable[[], BatchFunction], schema: str
) -> DataFrame:
    """Run a model over a table batch by batch.

    ``make_function`` is called once per task, so that a model is loaded once, and returns
    the function applied to every batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        function = make_function()
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def hashed_vectors(df: DataFrame, text: str = "text", out: str = "v", dim: int = 64) -> DataFrame:
    """Replace ``text`` by unit-length token counts in ``dim`` (at most 256) buckets.

    A token's bucket is the first byte of its MD5. Tokens are cut in the JVM; of a batch some
    rows at a time are taken, as many as hold ``B.RUN_ENTRIES`` tokens, and hash every distinct
    token once.
    """
    rest = [c for c in df.columns if c != text]
    tokens = df.select(*rest, T.tokenise(F.col(text)).alias(out))
    fields = [df.schema[c] for c in rest] + [StructField(out, ArrayType(DoubleType()))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.list_runs(batches, out):
            n = batch.num_rows
            column = batch.column(out)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            coded = column.flatten().dictionary_encode()
            bucket = np.array(
                [hashlib.md5(t.encode()).digest()[0] % dim for t in coded.dictionary.to_pylist()],
                dtype=np.int64,
            )
            row = np.repeat(np.arange(n), lengths)
            place = coded.indices.to_numpy(zero_copy_only=False)
            cell = row * dim + (bucket[place] if bucket.size else place)
            counts = np.bincount(cell, minlength=n * dim).reshape(n, dim).astype(np.float64)
            length = np.sqrt((counts**2).sum(axis=1, keepdims=True))
            unit = counts / np.where(length == 0, 1.0, length)
            offsets = pa.array(np.arange(0, (n + 1) * dim, dim), pa.int32())
            vectors = pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in rest] + [vectors], names=[*rest, out]
            )

    return tokens.mapInArrow(encode, StructType(fields))
