"""Whole jobs, with other partitionings and with cells in place of the exact search."""

from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quizloom.operators import dense
from quizloom.plans import encoding, retrieval, scoring, training
from registry import fixtures as X


def run(spark, sf_dir, passages, **options):
    rows = retrieval.answer_contexts(
        X.mcq_bench(spark, sf_dir), passages, X.encode_hashed, **options
    ).collect()
    return {r["id"]: r["context"] for r in rows}


def test_contexts_do_not_depend_on_partitioning(spark, sf_dir):
    passages = X.passages(spark, sf_dir)
    whole = run(spark, sf_dir, passages)
    assert run(spark, sf_dir, passages.repartition(13, F.rand(1))) == whole
    vectors = X.encode_hashed(passages)
    centres = dense.train_centroids(vectors, 8)
    settings = replace(retrieval.RetrievalSettings(), nprobe=8)
    found = run(
        spark, sf_dir, passages, settings=settings, passage_vectors=vectors, centroids=centres
    )
    assert found == whole


def test_training_and_evaluation_rows(spark, sf_dir):
    questions = X.mcq_context(spark, sf_dir)
    usable = questions.where("prompt IS NOT NULL AND answer IS NOT NULL").count()
    pairs = training.training_pairs(questions, 50)
    assert pairs.count() == 5 * usable
    longest = pairs.select(F.max(F.size("first") + F.size("second"))).first()[0]
    assert longest == 50
    complete = questions.dropna().count()
    assert 0 < complete < usable
    assert training.evaluation_pairs(questions).count() == 5 * complete


def test_a_scorer_is_called_once_per_question(spark, sf_dir):
    def make():
        def score(batch):
            last = [text.count("\n") % 5 for text in batch["text"]]
            s = [[1.0 if i == n else 0.5 - i / 10 for i in range(5)] for n in last]
            return pd.DataFrame({"id": batch["id"], "s": s})

        return score

    questions = X.mcq_bench(spark, sf_dir)
    table = scoring.score_questions(questions, make)
    assert table.count() == questions.count()
    values = [r["mAP"] for r in table.collect()]
    assert scoring.mean_score(table).first()[0] == pytest.approx(sum(values) / len(values))
    assert {round(v, 6) for v in values} <= {0.0, 0.333333, 0.5, 1.0}


def test_passages_are_numbered_capped_and_encoded(spark):
    texts = spark.createDataFrame([(i, f"t{i} a b") for i in range(25)], "n int, text string")
    passages = encoding.number_passages(texts.repartition(4), ["n"], cap=20, batch_rows=8)
    rows = passages.orderBy("passage_id").collect()
    assert [r["passage_id"] for r in rows] == list(range(20))
    assert [(r["shard"], r["row_no"]) for r in rows] == [(i // 8, i % 8) for i in range(20)]
    assert rows[9]["text"] == "t9 a b"
    vectors = encoding.encode_passages(passages, X.encode_hashed)
    assert vectors.columns == ["shard", "row_no", "passage_id", "v"] and vectors.count() == 20
    aligned = dense.align_texts(vectors, passages)
    assert {(r["passage_id"], r["text"]) for r in aligned.collect()} == {
        (r["passage_id"], r["text"]) for r in rows
    }


def test_encoding_resumes(spark, new_path):
    """No batch runs twice, and what a stopped run left behind is not read."""
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(23)], "doc_id long, text string")
    passages = encoding.number_passages(texts, ["doc_id"], batch_rows=5)
    ran = []

    def encode(df):
        ran.append(sorted(r["shard"] for r in df.select("shard").distinct().collect()))
        return df.withColumn("v", F.array(F.length("text").cast("double"), F.lit(2.0)))

    def broken(df):
        raise RuntimeError("stopped")

    folder = new_path("encoded")
    assert encoding.read_encoded(spark, folder).count() == 0
    assert encoding.encode_batches(passages, encode, folder, most=2) == [0, 1]
    with pytest.raises(RuntimeError):
        encoding.encode_batches(passages, broken, folder)
    spark.range(3).selectExpr("9 as shard", "id as row_no", "id as passage_id", "array(1D) as v").write.parquet(f"{folder}/vectors/left")
    assert encoding.read_encoded(spark, folder).count() == 10
    assert encoding.encode_batches(passages, encode, folder) == [2, 3, 4]
    assert encoding.encode_batches(passages, encode, folder) == []
    assert ran == [[0], [1], [2], [3], [4]]
    got = encoding.read_encoded(spark, folder).orderBy("passage_id").collect()
    assert [r["passage_id"] for r in got] == list(range(23)) and all(abs(r["v"][0] ** 2 + r["v"][1] ** 2 - 1) < 1e-9 for r in got)


def test_small_batches_are_encoded_together(spark, new_path):
    """A job takes many small batches; a batch that two runs have listed is read once."""
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(43)], "doc_id long, text string")
    passages = encoding.number_passages(texts, ["doc_id"], batch_rows=2).cache()
    ran = []

    def encode(df):
        ran.append(sorted(r["shard"] for r in df.select("shard").distinct().collect()))
        return df.withColumn("v", F.array(F.length("text").cast("double"), F.lit(2.0)))

    folder = new_path("encoded")
    assert encoding.encode_batches(passages, encode, folder, most=3, job_rows=20) == [0, 1, 2]
    assert encoding.read_encoded(spark, folder).count() == 6
    assert encoding.encode_batches(passages, encode, folder, job_rows=20) == list(range(3, 22))
    assert ran == [[0, 1, 2], list(range(3, 13)), list(range(13, 22))]
    listed = spark.read.parquet(f"{folder}/manifest").collect()
    assert {r["shard"]: r["rows"] for r in listed} == {i: 2 if i < 21 else 1 for i in range(22)}
    again = passages.where("shard BETWEEN 5 AND 6").withColumn("v", F.array(F.lit(0.6).cast("double"), F.lit(0.8).cast("double")))
    again.select("shard", "row_no", "passage_id", "v").write.parquet(f"{folder}/vectors/0again")
    spark.createDataFrame([(5, "0again", 2)], encoding.MANIFEST_SCHEMA).write.mode("append").parquet(f"{folder}/manifest")
    got = encoding.read_encoded(spark, folder).orderBy("passage_id").collect()
    assert [r["passage_id"] for r in got] == list(range(43))
    assert [r["shard"] for r in got if r["v"] == [0.6, 0.8]] == [5, 5]
