"""Scored questions to train/validation splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.operators import splits
from quizloom.runtime import materialise


def single_split(runs: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Keep the last row per prompt and split by score."""
    return splits.train_validation(splits.dedupe_keep_last(runs), threshold)


def fold_table(
    runs: DataFrame, n_folds: int = 4, threshold: float = 0.5, seed: int = K.FOLD_SEED
) -> DataFrame:
    """Keep the last row per prompt and build the sets of every fold: rows from the
    threshold on are folded by answer letter with even score classes."""
    unique = materialise(splits.dedupe_keep_last(runs))
    bias = unique.where(F.col("mAP") >= threshold)
    groups = splits.group_folds(bias, "answer", "mAP", n_folds, seed)
    folds = splits.with_folds(bias, groups, "answer").select("row_no", "fold")
    return splits.fold_sets(unique, folds, n_folds, "row_no", threshold)
