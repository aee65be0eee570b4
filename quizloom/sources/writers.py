"""Writers. Output is a folder of files, written by all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quizloom import constants as K

OUTPUT_COLUMNS = ("prompt", "context", *K.LETTERS, "answer")


def write_csv(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists"
) -> None:
    """CSV with a header. Blanks at both ends are kept, inner quotes are doubled, and an
    empty string is written as "" so that it differs from null."""
    writer = (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_parquet(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists"
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_contexts(df: DataFrame, path: str, **options) -> None:
    """Questions with context, columns in output order."""
    write_csv(df.select(*OUTPUT_COLUMNS), path, **options)


def write_split(df: DataFrame, path: str, **options) -> None:
    """A folder per split."""
    write_csv(df, path, partition_by=("split",), **options)


def write_folds(df: DataFrame, path: str, **options) -> None:
    """A folder per fold and split."""
    write_csv(df, path, partition_by=("fold", "split"), **options)


def write_shards(df: DataFrame, path: str, **options) -> None:
    """A folder per shard, and per cell where passages have one. Rows of a folder are brought
    together first, so that it gets few files; adaptive execution cuts a large folder's rows
    into several tasks."""
    by = ("shard", "cell") if "cell" in df.columns else ("shard",)
    write_parquet(df.hint("rebalance", *by), path, partition_by=by, **options)
