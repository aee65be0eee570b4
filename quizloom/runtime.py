"""Where intermediate tables go, and row numbering that stays distributed."""

from __future__ import annotations

import atexit
import io
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

# monotonically_increasing_id keeps the position inside a partition in its low 33 bits.
_POSITION_BITS = 33


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, taken from the session.

    Only a local session without the setting gets a folder, below its warehouse, which goes when
    the driver ends; on a cluster a machine-local folder would not survive the loss of an
    executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    folder = f"{warehouse}/_intermediate/{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, urlparse(folder).path, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[tuple[str, ...]] = set()


def ship_packages(spark: SparkSession, *folders: Path) -> None:
    """Send Python packages to the workers once per application, by way of the shared folder, so
    that they need not be installed there nor lie in the working folder."""
    context = spark.sparkContext
    key = (context.applicationId, *map(str, folders))
    if key in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for folder in folders:
            for path in sorted(folder.rglob("*.py")):
                out.write(path, path.relative_to(folder.parent))
    folder = scratch_path(spark, "packages")
    target = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{uuid.uuid4().hex}.zip")
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(target.toString())
    _shipped.add(key)


def materialise(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared folder, and cut the lineage there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def dense_row_id(df: DataFrame, order_by: list[str | Column], out: str = "row_id") -> DataFrame:
    """Number rows 0, 1, 2, … by ``order_by`` without bringing them into one task.

    Rows are range-partitioned and sorted; a row's number is its position in its partition
    plus the sizes of the partitions before. Sampling may place the range limits elsewhere
    in a second run, so the sorted rows are written once before the sizes are taken. Only
    the sizes, one row per partition, pass through a single task. ``order_by`` has to tell
    rows apart, which also lets equal leading keys spread over partitions.
    """
    placed = materialise(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", _POSITION_BITS)
    position = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_offset") + position).cast("long"))
        .drop("_part", "_place", "_offset")
    )


# Bins of one round of a selection, and rows that a selection may list at its end.
SELECT_BINS = 1 << 12
SELECT_ROWS = 10_000
_TEXT_BYTES = 6


def _codes(key: Column, kind: str) -> Iterator[Column]:
    """Numbers in the order of the key: one for numbers and truth values, one for every six bytes of
    a text, the last of which is followed by None."""
    if kind != "string":
        yield key.cast("double" if kind in ("float", "double") or kind.startswith("decimal") else "long")
        return
    size, start = F.octet_length(key), 0
    while True:
        piece = F.rpad(F.hex(F.substring(F.encode(key, "UTF-8"), start + 1, _TEXT_BYTES)), 2 * _TEXT_BYTES, "0")
        # Behind the bytes stands whether they are all of the text, as a shorter text comes first.
        shorter = F.least(F.greatest(size - start, F.lit(0)), F.lit(_TEXT_BYTES + 1))
        yield F.conv(piece, 16, 10).cast("long") * (_TEXT_BYTES + 2) + shorter
        start += _TEXT_BYTES


def nth_key(keys: DataFrame, n: int):
    """The row at place ``n``, counted from 1, in the order of all columns (nulls first), or None past the
    end.

    Rows are not sorted. Each round counts the rows in some thousand bins of equal width between the
    least and the largest of what is left, and keeps the bin that holds the place; rows of
    one value go on by the next column. A few rows that are left at the end are listed.
    """
    left, place = keys, n
    total = left.count()
    if not 1 <= n <= total:
        return None
    for name, kind in keys.dtypes:
        key = F.col(f"`{name}`")
        nulls = left.where(key.isNull()).count()
        if place <= nulls:
            left, total = left.where(key.isNull()), nulls
            continue
        left, place, total = left.where(key.isNotNull()), place - nulls, total - nulls
        for code in _codes(key, kind):
            low, high = left.agg(F.min(code), F.max(code)).first()
            while total > SELECT_ROWS and low < high:
                width = (high - low) / SELECT_BINS if isinstance(low, float) else -(-(high - low + 1) // SELECT_BINS)
                step = F.floor((code - low) / width) if isinstance(low, float) else F.call_function("div", code - low, F.lit(width))
                bins = left.groupBy(F.least(step, F.lit(SELECT_BINS - 1)).cast("int").alias("bin")).agg(
                    F.count(F.lit(1)).alias("n"), F.min(code).alias("low"), F.max(code).alias("high"))
                for row in sorted(bins.collect()):
                    if place <= row["n"]:
                        break
                    place -= row["n"]
                low, high, total = row["low"], row["high"], row["n"]
                left = left.where((code >= F.lit(low)) & (code <= F.lit(high)))
            if total <= SELECT_ROWS:
                listed = left.agg(F.array_sort(F.collect_list(F.struct(*keys.columns)))).first()[0]
                return listed[place - 1]
            if kind == "string" and left.agg(F.max(key) == F.min(key)).first()[0]:
                break
    return left.first()


def first_rows(df: DataFrame, keys: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows by ascending ``keys``, which have to tell rows apart.

    The last key that belongs is found by counting; nothing is sorted or shuffled, and the rows
    are filtered where they are.
    """
    if n <= 0:
        return df.limit(0)
    names = [f"_{i}" for i in range(len(keys))]
    listed = df.select(*[(F.col(k) if isinstance(k, str) else k).alias(c) for k, c in zip(keys, names)])
    last = nth_key(listed, n)
    if last is None:
        return df
    key = F.struct(*[(F.col(k) if isinstance(k, str) else k).alias(c) for k, c in zip(keys, names)])
    limit = F.struct(*[F.lit(last[c]).cast(listed.schema[c].dataType).alias(c) for c in names])
    return df.where(key <= limit)
