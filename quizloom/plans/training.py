"""Questions with context to padded training batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quizloom import constants as K
from quizloom.operators import prep


def training_pairs(questions: DataFrame, budget: int = K.TRAIN_TOKENS) -> DataFrame:
    """Pairs for fitting: missing options are filled, rows need a prompt and an answer."""
    usable = prep.keep_trainable(prep.fill_options(questions))
    return prep.cut_choices(prep.choice_lists(usable), budget)


def evaluation_pairs(questions: DataFrame, budget: int = K.EVAL_TOKENS) -> DataFrame:
    """Pairs for scoring: only rows with all fields."""
    usable = prep.keep_evaluable(questions)
    return prep.cut_choices(prep.choice_lists(usable), budget)


def training_batches(questions: DataFrame, budget: int = K.TRAIN_TOKENS) -> DataFrame:
    """Padded batches of the usable questions, without a row per option on the way."""
    usable = prep.keep_trainable(prep.fill_options(questions))
    return prep.pad_choices(prep.choice_lists(usable), budget)
