import json

from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.operators import generation
from quizloom.plans import questions as plan


def record(answer="option_2", **other):
    base = {"question": "q", **{k: f"text {k[-1]}" for k in K.OPTION_KEYS}, "answer": answer}
    return {**base, **other}


def reply(records):
    return json.dumps(records)


def test_kinds_and_traversal(spark):
    edges = spark.createDataFrame(
        [
            ("Category:Root_one", "Category:Sub a"), ("Category:Root_one", "page 1"),
            ("Category:Sub_a", "page 2"), ("Category:Sub a", "Category:Root_one"),
            ("Category:Sub_a", "Category:Left_out"), ("Category:Left out", "page 3"),
            ("Category:Sub_a", "Category:Deep"), ("Category:Deep", "page 1"),
            ("Category:Deep", "page 4"), ("Category:Other", "page 2"),
        ],
        "parent string, child string",
    )
    roots = {"S": ("Category:Root_one",), "T": ("Category:Other", "Category:Deep")}
    left_out = ("Category:Left out",)
    found = generation.category_pages(edges, roots, left_out).collect()
    assert sorted(tuple(r) for r in found) == [
        ("S", "page 1", 1), ("S", "page 2", 2), ("S", "page 4", 3),
        ("T", "page 1", 1), ("T", "page 2", 1), ("T", "page 4", 1),
    ]
    flat = generation.category_pages(edges, roots, left_out, max_depth=1).collect()
    assert ("S", "page 2", 2) not in {tuple(r) for r in flat}
    assert generation.category_pages(edges, roots, left_out, max_depth=0).count() == 0
    kinds = generation.split_members(edges, "child", left_out)
    assert kinds.where("kind = 'excluded'").count() == 1
    assert kinds.where("kind = 'page'").count() == 6


def test_validity(spark):
    replies = [
        reply([record()] * 5), reply([record()] * 4), reply([record(extra="x")] * 5),
        reply([record()] * 4 + [{"question": "q"}]), "no json", "", None,
        "  \n" + reply([record()] * 5) + "\n ", reply([record()] * 5)[:-40], "[]", "{}",
        reply([record()] * 6),
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "id int, reply string")
    rows = generation.with_validity(df).orderBy("id").collect()
    assert [r["id"] for r in rows if r["valid"]] == [0, 7]
    assert all(r["valid"] is not None for r in rows)


def test_first_valid_attempt(spark):
    good, bad = reply([record()] * 5), "bad"
    rows = [
        (1, 1, bad), (1, 2, good), (1, 3, bad), (2, 1, bad), (2, 2, bad), (2, 3, bad),
        (3, 1, good), (4, 1, bad), (4, 2, bad), (4, 3, bad), (4, 4, good),
    ]
    df = spark.createDataFrame(rows, "page_id long, attempt int, reply string")
    got = generation.first_valid_replies(df).orderBy("page_id").collect()
    assert [(r["page_id"], r["attempt"], r["failed_attempts"]) for r in got] == [
        (1, 2, 1), (2, None, 3), (3, 1, 0), (4, None, 3),
    ]
    assert len(got[0]["records"]) == 5 and got[1]["records"] is None


def test_answer_repair(spark):
    rows = [("option_3",), ("TEXT 4",), ("nothing",), (None,), ("Text 1",)]
    df = spark.createDataFrame(rows, "answer string")
    options = F.array(*[F.lit(f"text {i}") for i in range(1, 6)])
    got = [r[0] for r in df.select(generation.repair_answer(F.col("answer"), options)).collect()]
    assert got == ["option_3", "option_4", None, None, "option_1"]


def test_question_file(spark, new_path):
    pages = spark.createDataFrame(
        [("t1", 1, "one", "S"), ("t2", 2, "two", "M"), ("t3", 3, "three", "E")],
        "wiki_text string, page_id long, page_title string, stem_label string",
    )
    replies = spark.createDataFrame(
        [(1, 1, reply([record()] * 5)), (2, 1, "bad"), (2, 2, reply([record("TEXT 5")] * 5)),
         (3, 1, reply([record()] * 5))],
        "page_id long, attempt int, reply string",
    )
    seen = spark.createDataFrame([(3,)], "page_id long")
    table = plan.build_questions(pages, replies, seen)
    rows = table.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(10))
    assert [r["answer"] for r in rows] == ["B"] * 5 + ["E"] * 5
    assert rows[9]["page_title"] == "two" and rows[0]["A"] == "text 1"
    plan.write_questions(table, new_path("raw"), new_path("final"))
    assert set(spark.read.csv(new_path("raw"), header=True).columns) >= {"wiki_text", "prompt"}
    final = spark.read.csv(new_path("final"), header=True)
    assert final.columns == ["id", "prompt", *"ABCDE", "answer"] and final.count() == 10


def test_messages(spark):
    df = spark.createDataFrame([("body",)], "wiki_text string")
    system, user = generation.with_messages(df).first()["messages"]
    assert system["role"] == "system" and "5 dict objects" in system["content"]
    assert user["content"] == "####body####"


def test_unseen(spark):
    pages = spark.createDataFrame([(1,), (2,), (None,)], "page_id long")
    seen = spark.createDataFrame([(2,), (2,)], "page_id long")
    assert {r[0] for r in generation.unseen_pages(pages, seen).collect()} == {1, None}


def test_replies_as_python_prints_them(spark):
    """Single quotes, double quotes around an apostrophe, and an escaped apostrophe."""
    texts = ["What's new?", "She said \"it's\" so", "plain"]
    rows = []
    for text in texts:
        records = [{**record(), "question": text} for _ in range(5)]
        rows.append((1, repr(records), text))
    df = spark.createDataFrame(rows, "page_id long, reply string, text string")
    parsed = df.withColumn("records", generation.parse_reply(F.col("reply")))
    for row in parsed.withColumn("valid", generation.is_valid(F.col("records"))).collect():
        assert row["valid"] and row["records"][4]["question"] == row["text"]
