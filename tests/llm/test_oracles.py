"""Queries beside their SQL, on the smallest tables and on rows with secrets."""

import random

import compare
import duckdb
import pytest
from test_secrets import PARTS

from quizloom.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    connection = compare.connect(sf_dir)
    assert compare.compare(spark, connection, sf_dir, queries.queries()[name], oracle.oracle_sql()[name]) is None


def test_secrets_match_sql_on_dense_rows(spark, new_path):
    rng, folder = random.Random(12), new_path("tables")
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(30))) for _ in range(500)] + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    sql = oracle.oracle_sql()["op6_secret_scan"]
    assert compare.compare(spark, connection, folder, queries.op6_secret_scan, sql) is None
