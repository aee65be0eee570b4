import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quizloom.operators import batch_scoring, blocks
from quizloom.runtime import checkpoint_root
from quizloom.sources import readers, writers

AWKWARD = ['say "x"', "two\nlines", " blanks ", "a,b", "", None, "back\\slash", 'end"', "é"]


def test_csv_keeps_every_field(spark, new_path):
    rows = [(i, text, text) for i, text in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    writers.write_csv(df, new_path("csv"))
    back = readers.read_csv(spark, new_path("csv"), df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_excluded_files_are_not_read(spark, new_path):
    base = new_path("folder")
    spark.range(3).write.parquet(base + "/a")
    spark.range(5).write.parquet(base + "/b")
    nested = readers.read_parquet_except(spark, base, [], "id long", nested=True)
    assert nested.count() == 8
    name = nested.select("_metadata.file_name", "_metadata.file_path").where(
        F.col("file_path").contains("/b/")
    ).select("file_name").distinct().collect()
    left = readers.read_parquet_except(spark, base, [r[0] for r in name], "id long", nested=True)
    assert left.count() == 3


def test_splits_folds_and_shards_are_pruned(spark, new_path):
    df = spark.range(20).select(
        "id", F.when(F.col("id") % 4 == 0, "validation").otherwise("train").alias("split"),
        (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 5).cast("int").alias("shard"),
    )
    writers.write_parquet(df, new_path("t"), partition_by=("split",))
    part = readers.read_split(spark, new_path("t"), "validation")
    assert part.count() == 5
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().toString()
    writers.write_folds(df, new_path("f"))
    assert spark.read.csv(new_path("f"), header=True).where("fold = 1 AND split = 'train'").count()
    writers.write_split(df, new_path("s"))
    assert spark.read.csv(new_path("s"), header=True).count() == 20
    writers.write_shards(df, new_path("h"))
    assert readers.read_shard(spark, new_path("h"), 3).count() == 4


def test_shard_number_of_a_name(spark):
    names = [("batch12_of_30.index",), ("none.index",), ("7",), (None,)]
    df = spark.createDataFrame(names, "name string")
    got = [r[0] for r in df.select(readers.shard_of_name(F.col("name"))).collect()]
    assert got == [12, None, 7, None]


def test_sharded_files(spark, new_path):
    spark.range(4).write.parquet(new_path("x"))
    rows = readers.read_sharded(spark, new_path("x"), "id long").collect()
    assert sorted(r["id"] for r in rows) == [0, 1, 2, 3]
    assert all(r["shard"] is not None for r in rows)


class Session:
    """Just enough of a session to ask where intermediate tables go."""

    def __init__(self, master, configured=None):
        self.sparkContext = self
        self.conf = {"spark.sql.warehouse.dir": "file:/warehouse"}
        if configured:
            self.conf["spark.checkpoint.dir"] = configured
        self.master, self.folder = master, None

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_intermediate_tables_go_where_the_session_says():
    session = Session("spark://host", "hdfs://shared/folder")
    assert checkpoint_root(session) == session.folder == "hdfs://shared/folder"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session("spark://host"))
    local = Session("local[2]")
    assert checkpoint_root(local) == local.folder == checkpoint_root(local)
    assert local.folder.startswith("file:/warehouse/")


def test_batches_and_hashed_vectors(spark):
    def make():
        calls = []

        def function(batch):
            calls.append(len(batch))
            return batch.assign(n=batch["text"].str.len())[["id", "n"]]

        return function

    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, text string")
    known = df.where("text IS NOT NULL")
    got = batch_scoring.apply_batches(known, make, "id long, n long").collect()
    assert {r["id"]: r["n"] for r in got} == {1: 5, 2: 0}
    vectors = {r["id"]: r["v"] for r in batch_scoring.hashed_vectors(df, dim=16).collect()}
    assert len(vectors[1]) == 16 and sum(vectors[2]) == sum(vectors[3]) == 0
    assert sum(x * x for x in vectors[1]) == pytest.approx(1)
    assert max(vectors[1]) == pytest.approx(2 / 5**0.5)


def test_lists_are_taken_some_entries_at_a_time(monkeypatch):
    """Nothing that a task works out grows with the batch; a longer list stands alone."""
    monkeypatch.setattr(blocks, "RUN_ENTRIES", 10)
    lists = [["a"] * n for n in (4, 6, 1, 25, 0, 3)] + [None, ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.string()))], names=["id", "t"])
    runs = list(blocks.list_runs(iter([batch, batch.slice(0, 0), batch.slice(2)]), "t"))
    assert [r["id"].to_pylist() for r in runs] == [[0, 1], [2], [3], [4, 5, 6, 7], [2], [3], [4, 5, 6, 7]]
    assert [len(r["t"].flatten()) for r in runs] == [10, 1, 25, 4, 1, 25, 4]


def test_vectors_of_texts_longer_than_a_run(spark):
    texts = ["a " * (blocks.RUN_ENTRIES + 5), "a b", "b " * (blocks.RUN_ENTRIES - 1), None, "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r["id"]: [round(x, 6) for x in r["v"]] for r in batch_scoring.hashed_vectors(df).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[2] == got[4] and max(got[0]) == 1.0 and sum(got[3]) == 0
    assert got[1] == [round((x + y) / 2**0.5, 6) for x, y in zip(got[0], got[4])]
