import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom.operators import evaluation, splits
from quizloom.plans import splitting
from registry import fixtures as X


@pytest.fixture(scope="module")
def runs(spark, sf_dir):
    return X.eval_runs(spark, sf_dir).cache()


def test_last_row_of_a_prompt_stays(spark):
    rows = [(3, "p", 0.3), (9, "p", 0.9), (1, None, 0.1), (5, None, None), (2, "q", 0.2)]
    df = spark.createDataFrame(rows, "row_no long, prompt string, mAP double").repartition(3)
    kept = splits.dedupe_keep_last(df)
    assert kept.columns == df.columns
    assert sorted(r["row_no"] for r in kept.collect()) == [2, 5, 9]


def test_a_third_of_all_rows_with_one_prompt(spark):
    df = spark.range(3000).select(
        F.col("id").alias("row_no"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("prompt"),
    )
    kept = splits.dedupe_keep_last(df)
    assert kept.count() == 2001
    assert kept.where("prompt = 'same'").first()["row_no"] == 2997


def test_classes_by_first_appearance(spark):
    rows = [(5, 0.5), (2, None), (1, 1.0), (7, 0.5), (9, 0.0)]
    df = spark.createDataFrame(rows, "row_no long, mAP double").repartition(4)
    codes = {r["mAP"]: r["code"] for r in splits.class_codes(df).collect()}
    assert codes == {1.0: 0, None: 1, 0.5: 2, 0.0: 3}


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumn("label", F.substring(F.lit("STEM"), F.col("id").cast("int") % 4 + 1, 1))
    plain = {r["id"] for r in splits.seeded_sample(df, 40, "id", seed=1).collect()}
    again = {r["id"] for r in splits.seeded_sample(df.repartition(7), 40, "id", seed=1).collect()}
    other = {r["id"] for r in splits.seeded_sample(df, 40, "id", seed=2).collect()}
    assert len(plain) == 40 and plain == again and plain != other
    everything = splits.weighted_sample(df, 500, "id", "label", {"S": 1, "T": 2, "E": 1, "M": 1})
    assert everything.count() == 500


def test_weights_shift_the_sample(spark):
    df = spark.range(4000).withColumn("label", F.when(F.col("id") % 4 == 0, "T").otherwise("S"))
    drawn = splits.weighted_sample(df, 400, "id", "label", {"S": 1.0, "T": 3.0})
    heavy = drawn.where("label = 'T'").count()
    assert 260 < heavy < 340


def test_training_size():
    assert splits.training_size() == 1316


def test_train_validation_and_parts(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, None), (4, 0.2)], "row_no long, mAP double")
    split = {r["row_no"]: r["split"] for r in splits.train_validation(df, 1.0).collect()}
    assert split == {1: "validation", 2: "train", 3: "train", 4: "train"}
    part = {r["row_no"]: r["part"] for r in splits.bias_partition(df, 0.5).collect()}
    assert part == {1: "bias", 2: "bias", 3: None, 4: "remainder"}


def assert_whole_groups(assigned, group):
    rows = assigned.groupBy(group).agg(F.countDistinct("fold").alias("n")).collect()
    assert {r["n"] for r in rows} == {1}


def test_group_folds_keep_groups_whole(spark, runs):
    bias = runs.where("mAP >= 0.5")
    assigned = splits.with_folds(bias, splits.group_folds(bias, "answer", "mAP", 4), "answer")
    assert assigned.count() == bias.count()
    assert_whole_groups(assigned, "answer")
    assert {r["fold"] for r in assigned.select("fold").distinct().collect()} == {0, 1, 2, 3}


def test_group_folds_are_even(spark):
    """Many groups, one of them a third of all rows; the same from any partitioning."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "big").otherwise((F.col("id") % 211).cast("string")).alias("g"),
        (F.col("id") % 2).alias("c"),
    )
    folds = splits.group_folds(df, "g", "c", 3)
    assert folds.count() == folds.select("g").distinct().count() == 212
    assigned = splits.with_folds(df, folds, "g")
    assert assigned.count() == 3000
    assert_whole_groups(assigned, "g")
    sizes = {r["fold"]: r["count"] for r in assigned.groupBy("fold").count().collect()}
    assert set(sizes) == {0, 1, 2}
    # The largest group and an even share of the others.
    assert max(sizes.values()) <= 1000 + 2000 / 3 + 30
    again = splits.group_folds(df.repartition(5), "g", "c", 3)
    assert sorted(again.collect()) == sorted(folds.collect())


def class_rows(assigned):
    rows = assigned.groupBy("fold", "c").count().collect()
    return {(r["fold"], r["c"]): r["count"] for r in rows}


def test_mixed_groups_are_even(spark):
    """Groups that hold several classes: every class differs by less than the largest group."""
    rng = random.Random(3)
    rows = []
    for g in range(40):
        a, b = rng.choice([(60, 40), (55, 45), (90, 10), (30, 30)]), rng.choice("ABC")
        other = {"A": "B", "B": "C", "C": "A"}[b]
        rows += [(f"g{g}", b)] * a[0] + [(f"g{g}", other)] * a[1]
    df = spark.createDataFrame(rows, "g string, c string")
    assigned = splits.with_folds(df, splits.group_folds(df, "g", "c", 4), "g")
    assert_whole_groups(assigned, "g")
    found = class_rows(assigned)
    for c in "ABC":
        of_class = [found.get((fold, c), 0) for fold in range(4)]
        assert max(of_class) - min(of_class) <= 90  # most rows of a class in one group


def test_equal_groups_are_dealt_in_rounds(spark):
    df = spark.range(9000).select((F.col("id") % 300).cast("string").alias("g"), (F.col("id") % 3).alias("c"))
    found = class_rows(splits.with_folds(df, splits.group_folds(df, "g", "c", 4), "g"))
    assert all(found.get((fold, c), 0) == 750 for fold in range(4) for c in range(3))


def test_light_groups_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(splits, "PLACED_GROUPS", 10)
    rows = [(f"g{g}", f"c{g % 3}") for g in range(120) for _ in range(1 + g % 17)] + [(None, "c1")] * 5 + [("n", None)] * 3
    df = spark.createDataFrame(rows, "g string, c string")
    folds = splits.group_folds(df, "g", "c", 4)
    assert folds.count() == 122 and folds.select("g").distinct().count() == 122
    assigned = splits.with_folds(df, folds, "g")
    assert assigned.count() == len(rows)
    found = class_rows(assigned)
    for c in ("c0", "c1", "c2"):
        of_class = [found.get((fold, c), 0) for fold in range(4)]
        assert max(of_class) - min(of_class) <= 2 * 17
    assert splits.group_folds(df.limit(0), "g", "c", 4).count() == 0


@pytest.mark.parametrize("folds", [2, 3])
def test_placing_takes_the_least_spread(folds):
    vectors = np.array([[9, 0], [0, 8], [5, 5], [4, 1], [0, 2]])
    held, total = np.zeros((folds, 2)), vectors.sum(axis=0)
    for vector, fold in zip(vectors, splits.place_groups(vectors, folds)):
        spread = []
        for i in range(folds):
            tried = held.copy()
            tried[i] += vector
            spread.append((tried / total).var(axis=0).sum())
        assert spread[fold] <= min(spread) + 1e-12
        held[fold] += vector


def test_fold_sets_invariants(spark, runs):
    table = splitting.fold_table(runs, 4).cache()
    unique = splits.dedupe_keep_last(runs).where("mAP IS NOT NULL")
    ids = {r[0] for r in unique.select("row_no").collect()}
    bias = {r[0] for r in unique.where("mAP >= 0.5").select("row_no").collect()}
    validation = {}
    for fold in range(4):
        rows = table.where(F.col("fold") == fold).select("row_no", "split").collect()
        train = [r[0] for r in rows if r[1] == "train"]
        held = [r[0] for r in rows if r[1] == "validation"]
        assert not set(train) & set(held)
        assert sorted(train + held) == sorted(ids)
        validation[fold] = held
    everything = [x for held in validation.values() for x in held]
    assert sorted(everything) == sorted(bias)
    stats = evaluation.fold_stats(table).collect()
    assert len(stats) == 8
    assert all(r["n"] == pytest.approx(r["positive"] + r["negative"]) for r in stats)


def test_single_split(spark, runs):
    split = splitting.single_split(runs, 1.0)
    assert split.where("split = 'validation' AND mAP <> 1").count() == 0
    assert split.count() == splits.dedupe_keep_last(runs).count()


def test_top_n(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 1)], "id long, score int")
    assert [r["id"] for r in splits.top_n(df, "score", "id", 3).collect()] == [2, 3, 1]


def test_keep_last_takes_null_orders_and_ties(spark):
    rows = [("p", None, "x"), ("p", None, "a"), ("q", 1, "b"), ("q", None, "z"), ("r", 2, "m"), ("r", 2, "n")]
    df = spark.createDataFrame(rows, "prompt string, row_no long, A string")
    kept = {tuple(r) for r in splits.dedupe_keep_last(df).collect()}
    assert kept == {("p", None, "x"), ("q", 1, "b"), ("r", 2, "n")}
