"""Deduplication, sampling and train/validation splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quizloom import constants as K
from quizloom.runtime import dense_row_id, first_rows, materialise


def dedupe_keep_last(df: DataFrame, key: str = "prompt", order: str = "row_no") -> DataFrame:
    """The last row of every key, nulls counting as one key. A null order comes first; rows of
    equal order are told apart by their other columns, in column order.

    An aggregate in place of a ranking window: copies of a very frequent key are reduced
    to one row before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    place = F.struct(order, *rest)
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("_last"))
    return last.select(key, "_last.*").select(*df.columns)


def class_codes(df: DataFrame, column: str = "mAP", order: str = "row_no") -> DataFrame:
    """(value, code): distinct values, null included, coded by first appearance."""
    seen = df.groupBy(column).agg(F.min(order).alias("first_row"))
    return dense_row_id(seen, ["first_row", column], "code").select(column, "code")


def hash_order(id_column: str, seed: int) -> Column:
    """Sort key that depends on seed and id only, not on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_column).cast("string")))


def hash_uniform(id_column: str, seed: int) -> Column:
    """A number in (0, 1] from seed and id."""
    digits = F.conv(F.substring(hash_order(id_column, seed), 1, 13), 16, 10).cast("double")
    return (digits + 1) / F.lit(float(1 << 52))


def seeded_sample(df: DataFrame, n: int, id_column: str, seed: int = 0) -> DataFrame:
    """A fixed-size random sample that only depends on seed and ids."""
    keyed = df.withColumn("_key", hash_order(id_column, seed))
    return first_rows(keyed, ["_key", id_column], n).drop("_key")


def training_size(
    validation_rows: int = K.VALIDATION_ROWS,
    train_share: float = K.LEVERAGE_TRAIN,
    validation_share: float = K.LEVERAGE_VALIDATION,
) -> int:
    """Rows of the training set that go with a validation set of the given size."""
    return round(validation_rows * train_share / validation_share)


def weighted_sample(
    df: DataFrame, n: int, id_column: str, label: str, weights: dict[str, float], seed: int = 0
) -> DataFrame:
    """``n`` rows without replacement, drawn by label weight and evenly inside a label.

    Every row gets the key -ln(u)/w with u from its hash and w its share of the label's
    weight; the smallest keys win, so no pass over the data depends on another.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weight = F.try_element_at(table, F.col(label)) / F.col("_size")
    keyed = (
        df.join(F.broadcast(sizes.where(F.col(label).isin(*weights))), label)
        .withColumn("sample_key", F.round(-F.log(hash_uniform(id_column, seed)) / weight, 6))
        .drop("_size")
    )
    return first_rows(keyed, ["sample_key", id_column], n)


def top_n(df: DataFrame, score: str, id_column: str, n: int = 100) -> DataFrame:
    """The ``n`` rows of highest score, then lowest id; rows without a score come last."""
    keys = [F.col(score).isNull().alias("n"), (-F.col(score)).alias("s"), F.col(id_column)]
    return first_rows(df, keys, n).orderBy(*keys)


def train_validation(df: DataFrame, threshold: float = 0.5, column: str = "mAP") -> DataFrame:
    """``split`` is validation where the score equals the threshold, train elsewhere, also
    where there is no score."""
    is_validation = F.coalesce(F.col(column) == threshold, F.lit(False))
    return df.withColumn("split", F.when(is_validation, "validation").otherwise("train"))


def bias_partition(df: DataFrame, threshold: float = 0.5, column: str = "mAP") -> DataFrame:
    """``part`` is bias from the threshold on, remainder below it, null without a score."""
    return df.withColumn(
        "part",
        F.when(F.col(column) >= threshold, "bias").when(F.col(column) < threshold, "remainder"),
    )


# Groups that are placed one by one, and classes of a vector.
PLACED_GROUPS = 20_000
MOST_CLASSES = 1_000


def place_groups(vectors: np.ndarray, folds: int, held: np.ndarray | None = None) -> list[int]:
    """The fold of each group, a line of class counts, taken in the given order: the one after
    which the folds' shares of the classes differ least, then the one with fewest rows, then the
    first. ``held`` are the counts that the folds hold already, a line for each."""
    held = np.zeros((folds, vectors.shape[1])) if held is None else held.astype(float)
    total = np.maximum(held.sum(axis=0) + vectors.sum(axis=0), 1)
    found = []
    for vector in vectors:
        tried = held[None] + np.eye(folds)[:, :, None] * vector
        spread = np.round((tried / total).var(axis=1).sum(axis=1), 12)
        fold = min(range(folds), key=lambda i: (spread[i], held[i].sum(), i))
        held[fold] += vector
        found.append(fold)
    return found


def group_folds(
    df: DataFrame, group: str, stratum: str, folds: int = 4, seed: int = K.FOLD_SEED
) -> DataFrame:
    """(group, fold): whole groups in folds with even class shares, for any number of groups.

    A group is the vector of its rows per class (``MOST_CLASSES`` at most). Of groups with equal
    vectors, numbered by hash, every ``folds`` go to the folds one each, which leaves the
    shares as they are. What remains, fewer than ``folds`` groups of a vector, is placed one
    by one in the order of falling spread, size and hash, each where the folds' shares then differ
    least. Of more than ``PLACED_GROUPS`` the heaviest are placed so; the lighter ones are dealt
    back and forth by main class and falling rows of it: of what lighter groups of one main class
    hold of that class, the folds get the same but for the rows of one such group.
    """
    spark = df.sparkSession
    counts = materialise(df.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("n")))
    listed = counts.select(stratum).distinct().limit(MOST_CLASSES + 1).collect()
    if len(listed) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    classes = sorted((r[0] for r in listed), key=lambda c: (c is not None, c))
    own = [F.sum(F.when(F.col(stratum).eqNullSafe(F.lit(c)), F.col("n")).otherwise(0)) for c in classes]
    vectors = counts.groupBy(group).agg(F.array(*own).alias("_v"), F.sum("n").alias("_size"))
    vectors = vectors.withColumn("_key", hash_order(group, seed))
    numbered = materialise(dense_row_id(vectors, ["_v", "_key", group], "_row"))
    types = numbered.groupBy(F.col("_v").alias("_type")).agg(F.min("_row").alias("_start"), F.count(F.lit(1)).alias("_of"))
    rows = numbered.join(types, F.col("_v") == F.col("_type")).withColumn("_step", F.col("_row") - F.col("_start"))
    whole = F.col("_step") < F.col("_of") - F.col("_of") % folds
    dealt = rows.where(whole).select(group, (F.col("_step") % folds).cast("int").alias("fold"))

    mean = F.col("_size") / F.lit(max(1, len(classes)))
    spread = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    rest = materialise(rows.where(~whole).select(group, "_v", "_size", "_key", F.round(spread, 6).alias("_spread")))
    order = [(-F.col("_spread")).alias("s"), (-F.col("_size")).alias("z"), F.col("_key"), F.col(group)]
    heavy = first_rows(rest, order, PLACED_GROUPS).orderBy(*order).select(group, "_v").collect()
    placed = place_groups(np.array([r["_v"] for r in heavy], float).reshape(len(heavy), len(classes)), folds)
    schema = StructType([df.schema[group], StructField("fold", IntegerType())])
    found = dealt.unionByName(spark.createDataFrame([(r[0], f) for r, f in zip(heavy, placed)], schema))
    if rest.count() > len(heavy):
        light = rest.join(found.select(F.col(group).alias("_g")), F.col(group).eqNullSafe(F.col("_g")), "left_anti")
        light = light.withColumns({"_most": F.array_max("_v"), "_main": F.array_position("_v", F.array_max("_v"))})
        turns = materialise(dense_row_id(light, ["_main", F.desc("_most"), "_key", group], "_row"))
        first = turns.groupBy("_main").agg(F.min("_row").alias("_first"))
        turn = (F.col("_row") - F.col("_first")) % (2 * folds)
        found = found.unionByName(turns.join(first, "_main").select(
            group, F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn).cast("int").alias("fold")))
    return found


def with_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Add the fold of each row's group; nulls are a group of their own."""
    other = folds.withColumnRenamed(group, "_g")
    return df.join(other, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def fold_sets(
    df: DataFrame, folds: DataFrame, n_folds: int, id_column: str, threshold: float = 0.5
) -> DataFrame:
    """Train and validation rows of every fold, labelled ``fold`` and ``split``.

    Validation is the fold's rows from the threshold on; train is the rows below it and
    the other folds' rows. Rows without a score are in neither. ``folds`` is (id, fold)
    for the rows from the threshold on; it is joined once, and each row is then copied once
    per fold.
    """
    scored = bias_partition(df, threshold).where(F.col("part").isNotNull())
    own = folds.select(id_column, F.col("fold").alias("_own"))
    copies = scored.join(own, id_column, "left").withColumn(
        "fold", F.explode(F.array(*[F.lit(i) for i in range(n_folds)]))
    )
    is_validation = F.coalesce(F.col("_own") == F.col("fold"), F.lit(False))
    return copies.withColumn(
        "split", F.when(is_validation, "validation").otherwise("train")
    ).drop("_own", "part")
