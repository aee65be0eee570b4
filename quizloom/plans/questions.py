"""Model replies to a question file."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quizloom.operators import generation
from quizloom.runtime import materialise
from quizloom.sources import writers


def build_questions(
    pages: DataFrame, replies: DataFrame, seen: DataFrame | None = None
) -> DataFrame:
    """Questions of all pages not seen before, in competition format with page columns."""
    if seen is not None:
        pages = generation.unseen_pages(pages, seen)
    return generation.competition_format(generation.question_records(replies), pages)


def write_questions(questions: DataFrame, raw_path: str, path: str, **options) -> None:
    """The table with page columns and the one without, computed once."""
    kept = materialise(questions)
    writers.write_csv(kept, raw_path, **options)
    writers.write_csv(generation.without_page_columns(kept), path, **options)
