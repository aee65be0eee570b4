"""Passage files to stored, sharded vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.operators import dense
from quizloom.runtime import first_rows


def number_passages(
    texts: DataFrame,
    order_by: list[str],
    cap: int | None = None,
    batch_rows: int = K.ENCODE_BATCH,
) -> DataFrame:
    """(shard, row_no, passage_id, text): the texts in the given order, with a shard for every
    ``batch_rows`` of them; with a ``cap`` only the first so many.

    Only the keys in ``order_by``, which have to tell rows apart and be without nulls, are
    sorted; texts then join their numbers.
    """
    chosen = texts if cap is None else first_rows(texts, order_by, cap)
    numbers = dense.row_batches(chosen.select(*order_by), order_by, batch_rows)
    numbered = chosen.join(numbers, order_by)
    return numbered.select(
        F.col("batch").cast("int").alias("shard"),
        (F.col("row_id") % batch_rows).alias("row_no"),
        F.col("row_id").alias("passage_id"),
        "text",
    )


def encode_passages(
    passages: DataFrame, encode: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(shard, row_no, passage_id, v) of unit length. ``encode`` turns ``text`` into ``v``."""
    return dense.normalise(encode(passages.select("shard", "row_no", "passage_id", "text")))


MANIFEST_SCHEMA = "shard int, name string, rows long"


def _finished(spark: SparkSession, folder: str) -> DataFrame:
    """The listed batches; of a shard listed twice, by two runs at a time, one counts."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    listed = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")
    return listed.groupBy("shard").agg(F.min_by("name", "name").alias("name"), F.min_by("rows", "name").alias("rows"))


def _jobs(shards: list[int], rows: dict[int, int], job_rows: int | None) -> Iterator[list[int]]:
    """Neighbouring shards with ``job_rows`` rows at most, or a shard each."""
    job: list[int] = []
    size = 0
    for shard in shards:
        if job and (job_rows is None or size + rows[shard] > job_rows):
            yield job
            job, size = [], 0
        job.append(shard)
        size += rows[shard]
    if job:
        yield job


def encode_batches(
    passages: DataFrame, encode: Callable[[DataFrame], DataFrame], folder: str, most: int | None = None,
    job_rows: int | None = None,
) -> list[int]:
    """Encodes the shards of ``number_passages`` that ``folder`` does not list yet, one after the
    other and ``most`` of them at most, and returns their numbers. Shards too small for a job of
    their own go together, up to ``job_rows`` rows to a job.

    The shards of a job are written under a fresh name and listed when they are whole; what a run
    that was stopped left behind is not listed and not read. Read ``passages`` from a table stored
    by shard, so that a job reads its own texts.
    """
    spark = passages.sparkSession
    done = {r["shard"] for r in _finished(spark, folder).select("shard").collect()}
    every = {r["shard"]: r["rows"] for r in passages.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).collect()}
    pending = [shard for shard in sorted(every) if shard not in done][:most]
    for job in _jobs(pending, every, job_rows):
        name = uuid.uuid4().hex
        path = f"{folder}/vectors/{name}"
        encode_passages(passages.where(F.col("shard").isin(*job)), encode).write.parquet(path)
        written = spark.read.parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).collect()
        rows = {r["shard"]: r["rows"] for r in written}
        listed = spark.createDataFrame([(shard, name, rows.get(shard, 0)) for shard in job], MANIFEST_SCHEMA)
        listed.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return pending


def read_encoded(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, row_no, passage_id, v) of the listed shards."""
    listed = _finished(spark, folder).select("shard", "name")
    names = sorted(r["name"] for r in listed.select("name").distinct().collect())
    schema = "shard int, row_no long, passage_id long, v array<double>"
    if not names:
        return spark.createDataFrame([], schema)
    # Of a job some shards may be listed, and the others by another run.
    found = spark.read.schema(schema).parquet(*[f"{folder}/vectors/{name}" for name in names])
    named = found.withColumn("name", F.element_at(F.split("_metadata.file_path", "/"), -2))
    return named.join(F.broadcast(listed), ["shard", "name"], "left_semi").drop("name")
