import random

import pytest
from pyspark.sql import functions as F

from quizloom.functions import metrics as M
from quizloom.operators import evaluation

PICK = random.Random(3)


def value(spark, df, expression):
    return [r[0] for r in df.orderBy("id").select(expression).collect()]


def python_ap(actual, predicted, k):
    if not actual:
        return 0.0
    right, total, before = 0, 0.0, set()
    for place, item in enumerate(predicted[:k], start=1):
        if item in actual and item not in before:
            right += 1
            total += right / place
        before.add(item)
    return total / min(len(actual), k)


def test_average_precision(spark):
    cases = [([], ["A"]), (["A"], []), ([None], ["A", "B", "C"])]
    for _ in range(60):
        letters = "ABCDEFG"
        actual = PICK.sample(letters, PICK.randint(1, 4))
        cases.append((actual, [PICK.choice(letters) for _ in range(PICK.randint(0, 8))]))
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)], "id int, a array<string>, p array<string>"
    )
    for k in (1, 3, 10):
        got = value(spark, df, M.average_precision(F.col("a"), F.col("p"), k))
        assert got == pytest.approx([python_ap(a, p, k) for a, p in cases])


def test_ties_go_to_the_later_letter(spark):
    df = spark.createDataFrame(
        [(1, [0.5, 0.9, 0.5, 0.1, 0.9]), (2, [0.0] * 5)], "id int, s array<double>"
    )
    got = value(spark, df, M.ranked_letters(F.col("s"), 3))
    assert got == [["E", "B", "C"], ["E", "D", "C"]]


def test_precision_at_k(spark):
    df = spark.createDataFrame([(1, [1, 0, 1])], "id int, r array<int>")
    got = [value(spark, df, M.precision_at_k(F.col("r"), F.lit(k)))[0] for k in (1, 2, 3)]
    assert got == pytest.approx([1, 1 / 2, 2 / 3])
    for k in (0, 4):
        with pytest.raises(Exception, match="k must lie"):
            value(spark, df, M.precision_at_k(F.col("r"), F.lit(k)))


def test_repeated_predictions_count_again(spark):
    rows = [(1, "A B A", "A"), (2, "", "A"), (3, "  B  A ", "A"), (4, "C D E A", "A")]
    df = spark.createDataFrame(rows, "id int, p string, t string")
    got = value(spark, df, M.precision_sum_at_3(F.col("p"), F.col("t")))
    assert got == pytest.approx([1 + 2 / 3, 0, 1 / 2, 0])
    mean = evaluation.map_at_3_strings(df, "p", "t").first()[0]
    assert mean == pytest.approx(sum(got) / 4)


def test_map_at_3_of_scores(spark):
    rows = [(1, [0.1, 0.5, 0.5, 0.2, 0.0], 2), (2, [0.5, 0.4, 0.3, 0.2, 0.1], 3),
            (3, [0.5, 0.4, 0.3, 0.2, 0.1], 2), (4, [0.0, 0.0, 0.0, 0.0, 1.0], 4)]
    df = spark.createDataFrame(rows, "id int, s array<double>, label int")
    got = value(spark, df, M.reciprocal_rank_at_3(F.col("s"), F.col("label")))
    assert got == pytest.approx([1 / 2, 0, 1 / 3, 1])
    assert evaluation.map_at_3_scores(df).first()[0] == pytest.approx(sum(got) / 4)


def test_argmax_is_accuracy(spark):
    rows = [(1, [0.1, 0.7, 0.7, 0.0, 0.0], "B"), (2, [0.1, 0.7, 0.7, 0.0, 0.0], "C")]
    df = spark.createDataFrame(rows, "id int, s array<double>, answer string")
    assert value(spark, df, M.argmax_letter(F.col("s"))) == ["B", "B"]
    assert evaluation.argmax_accuracy(df).first()[0] == 0.5


def test_evaluation_table(spark):
    questions = spark.createDataFrame(
        [(1, "q", "a", "b", "c", "d", "e", "B"), (2, "r", "a", "b", "c", "d", "e", None)],
        "id int, prompt string, A string, B string, C string, D string, E string, answer string",
    )
    scores = spark.createDataFrame(
        [(1, [0.9, 0.8, 0.0, 0.1, 0.2]), (2, [0.9, 0.8, 0.0, 0.1, 0.2])],
        "id int, s array<double>",
    )
    table = evaluation.evaluation_table(questions, scores)
    assert table.columns == ["id", *evaluation.RESULT_COLUMNS]
    rows = table.orderBy("id").collect()
    assert [r["mAP"] for r in rows] == [0.5, 0.0]
    assert rows[0]["prediction-1"] == "A" and rows[0]["prediction-3"] == "E"
    assert evaluation.mean_of(table, "mAP", "m").first()[0] == 0.25


def test_distribution_and_difficulty(spark):
    rows = [(x,) for x in (0.0, 1.0, 1.0, None, 0.6)]
    df = spark.createDataFrame(rows, "mAP double")
    shares = [tuple(r) for r in evaluation.map_distribution(df).collect()]
    assert shares == [(1.0, 2, 0.5), (0.0, 1, 0.25), (0.6, 1, 0.25)]
    marked = evaluation.with_difficulty(df).groupBy("difficulty").count().collect()
    assert {r[0]: r[1] for r in marked} == {"hard": 2, "simple": 2, None: 1}
