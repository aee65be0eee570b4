"""Readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quizloom import constants as K


def _strings(*names: str) -> list[StructField]:
    return [StructField(name, StringType()) for name in names]


QUESTION_SCHEMA = StructType(_strings("prompt", *K.LETTERS, "answer"))
SCORED_SCHEMA = StructType([*QUESTION_SCHEMA.fields, StructField("mAP", DoubleType())])
CONTEXT_SCHEMA = StructType(_strings("prompt", "context", *K.LETTERS, "answer"))


def read_parquet_except(
    spark: SparkSession,
    folder: str,
    exclude: list[str],
    schema: StructType | str | None = None,
    nested: bool = False,
) -> DataFrame:
    """All parquet files of a folder but the named ones.

    The filter on the file name is applied when files are listed, so excluded files are
    not opened. ``nested`` also takes files in folders below.
    """
    reader = spark.read.option("recursiveFileLookup", str(nested).lower())
    if schema is not None:
        reader = reader.schema(schema)
    files = reader.option("pathGlobFilter", "*.parquet").parquet(folder)
    return files.where(~F.col("_metadata.file_name").isin(*exclude))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; quotes inside a field are doubled, line breaks are allowed.

    A field without text is null and "" is an empty string: with the default null mark both
    would be null.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "\0")
        .csv(path)
    )


def read_split(
    spark: SparkSession, path: str, split: str, schema: StructType | str | None = None
) -> DataFrame:
    """One named split of a table partitioned by ``split``; other splits are not listed."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).where(F.col("split") == split)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One shard of a table partitioned by ``shard``."""
    return spark.read.parquet(path).where(F.col("shard") == shard)


def shard_of_name(name: Column) -> Column:
    """The first run of digits in a file name as the shard number, null without digits."""
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return digits.try_cast("long")


def read_sharded(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Files of a folder and below with the shard number of their names."""
    files = (
        spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    )
    return files.withColumn("shard", shard_of_name(F.col("_metadata.file_name")).cast("int"))
