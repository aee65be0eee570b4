"""Every registered query beside its SQL, on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import compare
import pytest

import __spark_entry__ as entry
from registry import oracle as registry_oracle
from registry import queries as registry_queries

QUERIES = registry_queries.queries()
SQL = registry_oracle.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, connection, sf_dir, name):
    assert compare.compare(spark, connection, sf_dir, QUERIES[name], SQL[name]) is None


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_scores_of_every_question_and_passage(spark, connection, sf_dir):
    """Not of the nearest passages alone."""
    pairs = connection.execute("SELECT (SELECT count(*) FROM benchmark) * (SELECT count(DISTINCT text) FROM documents)")
    assert QUERIES["tfidf_scores"](spark, sf_dir).count() == pairs.fetchone()[0]


def test_entry_has_contexts(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 40
    assert all(row["context"].endswith("\n") for row in rows)


ELSEWHERE = """
import sys
sys.path.append(sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.remove(sys.argv[1])
import importlib.util
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
print("rows", entry.queries()["dense_topk_per_shard"](spark, sys.argv[2]).count())
"""


def test_runs_from_another_folder(sf_dir, tmp_path):
    """Python workers find the packages although the working folder is elsewhere."""
    root = str(Path(entry.__file__).parent)
    done = subprocess.run(
        [sys.executable, "-c", ELSEWHERE, root, sf_dir],
        cwd=tmp_path, capture_output=True, text=True, timeout=300,
    )
    assert "rows 750" in done.stdout, done.stderr[-2000:]
