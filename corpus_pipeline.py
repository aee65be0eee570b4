"""Documents made ready for training: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with their columns;
the last one returns their token ids.

1. toxicity: documents with a score of 0.5 or more go. Learnt from the labelled documents of the
   stage's input outside the held-out fold.
2. near_duplicates: of each group of linked fingerprints the document with the smallest id stays.
3. decontamination: documents that are contaminated by the benchmark go; others stay as they are,
   few hits included.
4. secrets: found spans, of private keys the whole block, are replaced by ``[secret]``; ``n_chars`` follows the text. All stay.
5. byte_bpe: ids of the texts, their number and digest, and the digest of the bytes decoded from
   them.

Null texts are ordinary, have no words and no secrets, and one of them stays in stage 2. Extra
columns of the documents pass through stages 1 to 4. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm import decontaminate, queries, secrets, simhash, toxicity
from quizloom.llm.tables import pack, ship_package, table, unpacked
from quizloom.runtime import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.add_score(pack(docs, "text"), model)
    return scored.where(F.col("score") < 0.5).select(*unpacked(docs.columns, "text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = decontaminate.find_hits(pack(docs, "text"), table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.is_contaminated()).select(*unpacked(docs.columns, "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = pack(docs, "text").withColumn("spans", secrets.find_secrets(F.col("text"), secrets.REDACTION_RULES))
    found = found.withColumn("redacted", secrets.redact(F.col("text"), F.col("spans")))
    changed = {"text": F.col("redacted").alias("text")}
    if "n_chars" in docs.columns:
        count = F.when(F.size("spans") > 0, F.length("redacted")).otherwise(F.col("_own.n_chars"))
        changed["n_chars"] = count.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*[
        changed.get(c, old) for c, old in zip(docs.columns, unpacked(docs.columns, "text"))
    ])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return queries.encoded_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]

# Scores of language models, Hamming links and merges are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
