"""Question, passage, page and score tables derived from the given tables in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.constants import LETTERS, OPTION_KEYS
from quizloom.functions import vectors as V
from quizloom.operators.batch_scoring import hashed_vectors

LOWER = "abcdefghijklmnopqrstuvwxyz"
LABEL_ROOTS = {
    "S": ("Category:Region_0",),
    "T": ("Category:Region_1",),
    "E": ("Category:Region_2",),
    "M": ("Category:Region_3", "Category:Region_4"),
}
EXCLUDED = ("Category:Nation 5",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _segment(words: str, step: Column, i: int) -> Column:
    return F.array_join(F.slice(words, (step * i + 1).cast("int"), step.cast("int")), " ")


def _questions(df: DataFrame, id_column: str) -> DataFrame:
    """A question from the words of a whole text: one sixth asks, five sixths are options."""
    split = df.select(
        F.col(id_column).alias("id"), "text", F.split("text", "[ \n]+").alias("w")
    )
    step = F.ceil(F.size("w") / F.lit(6))
    kind = F.length("text") % 4
    opening = (
        F.when(kind == 0, "What is ")
        .when(kind == 1, "Which of the following statements ")
        .when(kind == 2, "Which of the following is ")
        .otherwise("")
    )
    parts = split.select(
        "id", opening.alias("o"), *[_segment("w", step, i).alias(f"s{i}") for i in range(6)]
    )
    options = [F.nullif(F.col(f"s{i + 1}"), F.lit("")).alias(x) for i, x in enumerate(LETTERS)]
    return parts.select(
        "id",
        F.concat("o", "s0", F.lit("?")).alias("prompt"),
        *options,
        F.substring(F.lit("ABCDE"), (F.floor(F.col("id") / 5) % 5 + 1).cast("int"), F.lit(1))
        .alias("answer"),
    )


def _null_where(df: DataFrame, column: str, condition: Column) -> DataFrame:
    return df.withColumn(column, F.when(~condition, F.col(column)))


def mcq_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _questions(table(spark, sf_dir, "benchmark"), "item_id")
    return _null_where(df, "E", F.col("id") % 7 == 0)


def mcq_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _questions(table(spark, sf_dir, "documents"), "doc_id")
    df = _null_where(df, "E", F.col("id") % 7 == 0)
    df = _null_where(df, "B", F.col("id") % 13 == 0)
    df = _null_where(df, "answer", F.col("id") % 11 == 10)
    return _null_where(df, "prompt", F.col("id") % 17 == 16)


def mcq_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document questions with the document itself as context."""
    contexts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("context")
    )
    return mcq_docs(spark, sf_dir).join(contexts, "id")


def eval_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("id") % 5
    score = (
        F.when(kind == 0, 0.0).when(kind == 1, 1.0 / 3).when(kind == 2, 0.5).when(kind == 3, 1.0)
    )
    return mcq_docs(spark, sf_dir).select(
        F.col("id").alias("row_no"), "prompt", *LETTERS, "answer", score.alias("mAP")
    )


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bias = eval_runs(spark, sf_dir).where(F.col("mAP") >= 0.5)
    fold = F.coalesce(F.ascii("answer") % 4, F.lit(0)).cast("int")
    return bias.select("row_no", fold.alias("fold"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct document texts in five shards."""
    distinct = (
        table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("passage_id"))
    )
    return distinct.select(
        (F.col("passage_id") % 5).cast("int").alias("shard"), "passage_id", "text"
    )


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text) of the lexical stage."""
    from quizloom.plans.retrieval import RetrievalSettings, prepare_questions

    asked = prepare_questions(mcq_bench(spark, sf_dir), RetrievalSettings())
    return asked.select(F.col("id").alias("query_id"), F.col("query_text").alias("text"))


def encode_hashed(df: DataFrame) -> DataFrame:
    """Stand-in encoder of the column ``text``."""
    return hashed_vectors(df)


def shard_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 5).cast("int").alias("shard"),
        F.floor(F.col("vec_id") / 5).alias("row_no"),
        F.col("vec_id").alias("passage_id"),
        V.as_double(F.col("embedding")).alias("v"),
    )


def _mean_vectors(df: DataFrame, key: str) -> DataFrame:
    """Mean vector per key; sums are formed per component before rows meet."""
    means = (
        df.select(key, F.posexplode("v").alias("pos", "x"))
        .groupBy(key, "pos").agg(F.avg("x").alias("x"))
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    )
    return means.select(key, F.col("p.x").alias("v"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the unit-length mean of its vectors."""
    labelled = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("query_id"),
        V.as_double(F.col("embedding")).alias("v"),
    )
    means = _mean_vectors(labelled, "query_id")
    return means.withColumn("v", V.l2_normalise(F.col("v")))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of every sign pattern of the first six components."""
    signs = [F.when(F.get("v", F.lit(i)) > 0, 1 << i).otherwise(0) for i in range(6)]
    cell = signs[0]
    for sign in signs[1:]:
        cell = cell + sign
    vectors = shard_vectors(spark, sf_dir).select(cell.cast("int").alias("cell"), "v")
    return _mean_vectors(vectors, "cell")


def option_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five scores per vector, each the sum of every fifth component."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", V.as_double(F.col("embedding")).alias("v")
    )

    def score(i: int) -> Column:
        own = F.filter("v", lambda _, at: at % 5 == i)
        return F.round(F.aggregate(own, F.lit(0.0), lambda a, x: a + x), 9)

    return vectors.select(
        F.col("vec_id").alias("id"), F.array(*[score(i) for i in range(5)]).alias("s"),
        (F.col("label") % 5).cast("int").alias("label"),
    )


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("page_title"),
        F.trim(F.regexp_replace("html", "<[^>]*>", " ")).alias("wiki_text"),
        F.substring(F.lit("STEM"), (F.col("page_id") % 4 + 1).cast("int"), F.lit(1)).alias(
            "stem_label"
        ),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three model replies per page from its words: right, cut, four records, wrong key."""
    split = page_text(spark, sf_dir).select(
        "page_id", F.split("wiki_text", "[ \n]+").alias("w")
    )
    step = F.ceil(F.size("w") / F.lit(30))

    def record(j: int, last: str) -> Column:
        parts = [_segment("w", step, 6 * j + p) for p in range(6)]
        if j % 2:
            answer = F.translate(parts[j % 5 + 1], LOWER, LOWER.upper())
        else:
            answer = F.lit(OPTION_KEYS[j % 5])
        names = ("question", *OPTION_KEYS, last)
        return F.struct(*[c.alias(n) for c, n in zip([*parts, answer], names, strict=True)])

    full = F.to_json(F.array(*[record(j, "answer") for j in range(5)]))
    short = F.to_json(F.array(*[record(j, "answer") for j in range(4)]))
    other = F.to_json(F.array(*[record(j, "solution") for j in range(5)]))
    written = split.select("page_id", full.alias("f"), short.alias("s"), other.alias("o"))
    tried = written.select(
        "*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt")
    )
    kind = (F.col("page_id") + F.col("attempt")) % 4
    half = F.substring(F.col("f"), F.lit(1), F.floor(F.length("f") / 2).cast("int"))
    reply = (
        F.when(kind == 0, F.concat(F.lit("\n "), F.col("f"), F.lit(" \n")))
        .when(kind == 1, half).when(kind == 2, F.col("s")).otherwise(F.col("o"))
    )
    return tried.select("page_id", "attempt", reply.alias("reply"))


def category_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    down = nation.select(
        F.concat(F.lit("Category:Region_"), F.col("n_regionkey")).alias("parent"),
        F.concat(F.lit("Category:Nation_"), F.col("n_nationkey")).alias("child"),
    )
    leaves = customer.select(
        F.concat(F.lit("Category:Nation "), F.col("c_nationkey")).alias("parent"),
        F.col("c_name").alias("child"),
    )
    back = nation.where(F.col("n_nationkey") == 0).select(
        F.lit("Category:Nation 0").alias("parent"),
        F.concat(F.lit("Category:Region_"), F.col("n_regionkey")).alias("child"),
    )
    return down.unionByName(leaves).unionByName(back)
