"""Questions to contexts: dense pool, lexical rerank, context, output columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.operators import dense, lexical, prep
from quizloom.runtime import materialise
from quizloom.sources.writers import OUTPUT_COLUMNS

Encoder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class RetrievalSettings:
    """Sizes of the stages; the defaults are the published ones.

    Scores do not depend on a chunk of questions or a prefix of passages unless
    ``query_chunk`` or ``idf_sample`` ask for it. With ``per_query_pool`` each question is
    scored against its own neighbours and not against those of all questions; that is the
    form whose work grows in proportion to the questions.
    """

    dense_k: int = K.DENSE_K
    dense_keep: int = K.DENSE_KEEP
    nprobe: int = K.NPROBE
    lexical_k: int = K.LEXICAL_K
    query_chunk: int | None = None
    idf_sample: int | None = None
    per_query_pool: bool = False
    strip_instruction: bool = False
    fill_to_k: bool = True


def prepare_questions(questions: DataFrame, settings: RetrievalSettings) -> DataFrame:
    """Fill missing fields and add ``full_text`` and ``query_text``."""
    filled = prep.with_retrieval_text(prep.fill_missing(questions))
    return prep.with_lexical_query(filled, settings.strip_instruction)


def find_neighbours(
    queries: DataFrame,
    passages: DataFrame,
    settings: RetrievalSettings,
    centroids: DataFrame | None = None,
) -> DataFrame:
    """The nearest passages kept per (shard, query); cells are probed if centres are given."""
    if centroids is None:
        found = dense.topk_per_shard(queries, passages, settings.dense_k)
    else:
        cells = passages
        if "cell" not in passages.columns:
            cells = dense.assign_cells(passages, centroids)
        found = dense.ivf_topk(queries, cells, centroids, settings.dense_k, settings.nprobe)
    return dense.keep_nearest(found, settings.dense_keep)


def answer_contexts(
    questions: DataFrame,
    passages: DataFrame,
    encode: Encoder,
    settings: RetrievalSettings | None = None,
    passage_vectors: DataFrame | None = None,
    centroids: DataFrame | None = None,
) -> DataFrame:
    """Questions with the context found for them.

    ``questions`` is (id, prompt, A-E, answer), ``passages`` is (shard, passage_id, text).
    ``encode`` adds a vector column ``v`` from a column ``text``. Stored vectors (shard,
    passage_id, v) may be given in place of encoding the passages here.
    """
    settings = settings or RetrievalSettings()
    asked = materialise(prepare_questions(questions, settings))
    queries = encode(asked.select(F.col("id").alias("query_id"), F.col("full_text").alias("text")))
    if passage_vectors is None:
        passage_vectors = encode(passages.select("shard", "passage_id", "text"))
    near = find_neighbours(queries, passage_vectors, settings, centroids)
    lexical_queries = asked.select(F.col("id").alias("query_id"), F.col("query_text").alias("text"))
    if settings.per_query_pool:
        near = materialise(near)
        pool = passages.select("passage_id", "text")
        ranked = lexical.own_pool_topk(
            lexical_queries, near, pool, settings.lexical_k, settings.fill_to_k
        )
        contexts = lexical.assemble_context(lexical.with_texts(materialise(ranked), pool))
        found = contexts.withColumnRenamed("query_id", "id")
        return lexical.attach_context(asked, found, "id").select("id", *OUTPUT_COLUMNS)
    pool = materialise(dense.candidate_pool(near, passages))
    ranked = lexical.lexical_topk(
        lexical_queries,
        pool,
        settings.lexical_k,
        settings.fill_to_k,
        query_chunk=settings.query_chunk,
        idf_sample=settings.idf_sample,
    )
    contexts = lexical.assemble_context(lexical.with_texts(ranked, pool))
    found = contexts.withColumnRenamed("query_id", "id")
    return lexical.attach_context(asked, found, "id").select("id", *OUTPUT_COLUMNS)
