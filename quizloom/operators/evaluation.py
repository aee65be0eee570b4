"""Scoring of answered questions and statistics over the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.functions import metrics as M
from quizloom.runtime import materialise

RESULT_COLUMNS = (
    "prompt", "answer", "prediction-1", "prediction-2", "prediction-3", "mAP", *K.LETTERS,
)


def with_top3(df: DataFrame, scores: str = "s") -> DataFrame:
    """Add the three best letters as ``top3``, null without scores."""
    best = F.when(F.col(scores).isNotNull(), M.ranked_letters(F.col(scores), 3))
    return df.withColumn("top3", best)


def evaluation_table(questions: DataFrame, scores: DataFrame, id_column: str = "id") -> DataFrame:
    """One row per question with its three predictions and its average precision; a question
    without scores has null predictions and a null average precision."""
    joined = with_top3(questions.join(scores, id_column, "left"))
    precision = M.average_precision(F.array("answer"), F.col("top3"), 3)
    return joined.select(
        id_column, "prompt", "answer",
        *[F.get("top3", F.lit(i)).alias(f"prediction-{i + 1}") for i in range(3)],
        F.when(F.col("top3").isNotNull(), precision).alias("mAP"),
        *K.LETTERS,
    )


def mean_of(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.agg(F.avg(column).alias(out))


def map_at_3_strings(df: DataFrame, predictions: str, truth: str) -> DataFrame:
    """Mean over rows of the summed precision of blank-separated predictions."""
    return df.agg(
        F.avg(M.precision_sum_at_3(F.col(predictions), F.col(truth))).alias("map_at_3")
    )


def map_at_3_scores(df: DataFrame, scores: str = "s", label: str = "label") -> DataFrame:
    """Mean reciprocal rank of the label within the three best of five scores."""
    return df.agg(
        F.avg(M.reciprocal_rank_at_3(F.col(scores), F.col(label))).alias("map_at_3")
    )


def argmax_accuracy(df: DataFrame, scores: str = "s", answer: str = "answer") -> DataFrame:
    """Score of a single predicted letter per row, which is plain accuracy."""
    return df.agg(
        F.avg(M.precision_sum_at_3(M.argmax_letter(F.col(scores)), F.col(answer)))
        .alias("accuracy")
    )


def map_distribution(df: DataFrame, column: str = "mAP") -> DataFrame:
    """Share of rows per value, most frequent first, nulls left out. The input is read once: the
    total is taken from the counts of the distinct values."""
    counts = materialise(
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.select(column, "n", (F.col("n") / total).alias("share")).orderBy(
        F.desc("n"), column
    )


def fold_stats(df: DataFrame, column: str = "mAP") -> DataFrame:
    """Summed score, the rest of the rows, and both shares in percent, per fold and split."""
    sums = df.groupBy("fold", "split").agg(
        F.coalesce(F.sum(column), F.lit(0.0)).alias("positive"),
        F.count(F.lit(1)).alias("n"),
    )
    return sums.select(
        "fold", "split", "n", "positive", (F.col("n") - F.col("positive")).alias("negative"),
        (100 * F.col("positive") / F.col("n")).alias("positive_percent"),
        (100 - 100 * F.col("positive") / F.col("n")).alias("negative_percent"),
    )


def with_difficulty(df: DataFrame, column: str = "mAP", limit: float = K.HARD_LIMIT) -> DataFrame:
    """hard up to the limit, simple above it; rows without a score stay unmarked."""
    return df.withColumn(
        "difficulty",
        F.when(F.col(column) <= limit, "hard").when(F.col(column) > limit, "simple"),
    )
