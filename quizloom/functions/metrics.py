"""Ranking metrics as column expressions on one question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.functions import text as T


def ranked_letters(scores: Column, n: int = 3) -> Column:
    """The ``n`` best letters by score; of equal scores the later letter comes first."""
    listed = F.transform(
        scores,
        lambda s, i: F.struct(
            s.alias("score"), F.get(F.array(*[F.lit(x) for x in K.LETTERS]), i).alias("letter")
        ),
    )
    best = F.slice(F.reverse(F.array_sort(listed)), 1, n)
    return F.transform(best, lambda o: o["letter"])


def _precision_sum(hits: Column) -> Column:
    """Sum of precision at every hit of a list of 0/1."""
    start = F.struct(
        F.lit(0).alias("seen"), F.lit(0).alias("right"), F.lit(0.0).alias("total")
    )

    def step(acc: Column, hit: Column) -> Column:
        seen, right = acc["seen"] + 1, acc["right"] + hit
        return F.struct(
            seen.alias("seen"), right.alias("right"),
            (acc["total"] + F.when(hit == 1, right / seen).otherwise(0.0)).alias("total"),
        )

    return F.aggregate(hits, start, step, lambda acc: acc["total"])


def average_precision(actual: Column, predicted: Column, k: int = 10) -> Column:
    """AP@k. An item counts at its first place only; no actual items give 0."""
    top = F.slice(predicted, 1, k)
    hits = F.transform(
        top,
        lambda p, i: F.when(
            F.coalesce(F.array_contains(actual, p), F.lit(False))
            & (F.array_position(top, p) == i + 1),
            1,
        ).otherwise(0),
    )
    size = F.size(actual)
    return F.when(size == 0, 0.0).otherwise(_precision_sum(hits) / F.least(size, F.lit(k)))


def precision_at_k(hits: Column, k: Column) -> Column:
    """Share of hits among the first ``k`` of a list of 0/1; k must be 1 … length."""
    right = F.aggregate(F.slice(hits, F.lit(1), k), F.lit(0), lambda acc, x: acc + x)
    bad = F.raise_error(F.lit("k must lie between 1 and the list length"))
    return F.when((k < 1) | (k > F.size(hits)), bad.cast("double")).otherwise(right / k)


def precision_sum_at_3(predictions: Column, truth: Column) -> Column:
    """Summed precision at the hits among the first three blank-separated predictions.

    A repeated prediction counts again.
    """
    hits = F.transform(
        F.slice(T.words(predictions), 1, 3), lambda p: F.when(p == truth, 1).otherwise(0)
    )
    return _precision_sum(hits)


def reciprocal_rank_at_3(scores: Column, label: Column) -> Column:
    """1/rank of the labelled option if it is among the three best, else 0; of equal
    scores the lower index comes first."""
    mine = F.get(scores, label)
    ahead = F.filter(scores, lambda s, i: (s > mine) | ((s == mine) & (i < label)))
    rank = F.size(ahead) + 1
    return F.when(rank <= 3, 1.0 / rank).otherwise(0.0)


def argmax_letter(scores: Column) -> Column:
    """Letter of the first highest score."""
    place = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    return F.get(F.array(*[F.lit(x) for x in K.LETTERS]), place)
