"""Input tables and shared settings of the queries."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.runtime import ship_packages

PACKAGE = Path(__file__).resolve().parents[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """The column of this very name, dots and back quotes included."""
    return df["`" + name.replace("`", "``") + "`"]


def for_arrow(df: DataFrame, kept: list[str], **own: Column) -> DataFrame:
    """The kept columns under plain names in front, as tasks over Arrow batches need them, and
    computed ones by their names behind."""
    return df.select(
        *[column(df, c).alias(f"_k{i}") for i, c in enumerate(kept)], *[c.alias(name) for name, c in own.items()]
    )


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(parts)


def is_fold(key: str, parts: int, number: int) -> Column:
    return F.coalesce(fold(key, parts) == number, F.lit(False))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    ship_packages(spark, PACKAGE)


MOST_TASKS = 50_000


def one_per_task(df: DataFrame, key: str) -> DataFrame:
    """Deals the few rows of ``df``, each standing for much work, over as many tasks. The hash
    keeps the plan from taking a partitioning by the key, which may be merged, for this one."""
    return df.repartition(max(1, min(df.count(), MOST_TASKS)), F.xxhash64(key))


def cut_batch(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of whole rows with about ``most`` bytes of a text or binary column."""
    sizes = np.array([len(v.as_buffer() or b"") for v in batch[column]], np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def pack(df: DataFrame, *keep: str, **computed: Column) -> DataFrame:
    """The named and computed columns, and all others as one column ``_own``, so that a step's own columns
    cannot clash with them; ``unpacked`` names them for a ``select`` that brings the rows back."""
    rest = [column(df, c) for c in df.columns if c not in keep]
    own = F.struct(*rest) if rest else F.lit(None)
    return df.select(*keep, own.alias("_own"), *[c.alias(name) for name, c in computed.items()])


def unpacked(columns: list[str], *keep: str) -> list[Column]:
    """The columns of a packed table in their first order."""
    return [F.col(c) if c in keep else F.col(f"_own.`{c}`").alias(c) for c in columns]
