"""Question files to a table of predictions and their mean score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quizloom import constants as K
from quizloom.operators import batch_scoring, evaluation, prep
from quizloom.runtime import materialise

SCORE_SCHEMA = "id long, s array<double>"


def score_questions(
    questions: DataFrame,
    make_scorer: Callable[[], batch_scoring.BatchFunction],
    template: str = K.SCORING_PROMPT,
) -> DataFrame:
    """Result table of a model that scores the five letters.

    The scorer gets batches of (id, text) and returns (id, s) with five scores. It runs once
    per question, so the table is written before it is used again.
    """
    texts = prep.with_scoring_prompt(questions, template).select("id", "text")
    scores = batch_scoring.apply_batches(texts, make_scorer, SCORE_SCHEMA)
    return materialise(evaluation.evaluation_table(questions, scores))


def mean_score(table: DataFrame) -> DataFrame:
    return evaluation.mean_of(table, "mAP", "map_at_3")
