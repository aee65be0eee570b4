import random

from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.operators import prep
from quizloom.runtime import dense_row_id, first_rows, nth_key

SCHEMA = "id int, prompt string, context string, A string, B string, C string, D string, " \
    "E string, answer string"


def questions(spark):
    rows = [
        (1, "p one", "c c c c", "a", "b b", "c", "d", "e", "B"),
        (2, None, "c", "a", "b", "c", "d", None, "A"),
        (3, "p", None, "a", "b", "c", "d", None, "E"),
        (4, "p", "c", "a", "b", "c", "d", "e", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_missing_values(spark):
    df = questions(spark)
    filled = {r["id"]: r for r in prep.fill_missing(df).collect()}
    assert filled[2]["prompt"] == filled[3]["context"] == filled[4]["answer"] == K.NO_ANSWER
    options = {r["id"]: r for r in prep.fill_options(df).collect()}
    assert options[2]["E"] == K.NO_ANSWER and options[2]["prompt"] is None
    assert ids(prep.keep_trainable(df)) == [1, 3]
    assert ids(prep.keep_evaluable(df)) == [1]


def test_filters_and_columns_reach_the_scan(spark, new_path):
    questions(spark).write.parquet(new_path("q"))
    kept = prep.keep_trainable(spark.read.parquet(new_path("q")), stored=True).select("id", "answer")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(prompt)" in plan and "IsNotNull(answer)" in plan
    assert "context" not in plan.split("ReadSchema")[1]


def test_codes(spark):
    df = spark.createDataFrame([("A",), ("E",), ("F",), (None,), ("option_3",)], "x string")
    row = df.select(
        prep.letter_index(F.col("x")).alias("i"), prep.option_letter(F.col("x")).alias("o")
    ).collect()
    assert [r["i"] for r in row] == [0, 4, None, None, None]
    assert [r["o"] for r in row] == [None, None, None, None, "C"]
    back = spark.createDataFrame([(0,), (4,), (5,), (None,)], "i int")
    assert [r[0] for r in back.select(prep.index_letter(F.col("i"))).collect()] == [
        "A", "E", None, None,
    ]


def test_choice_pairs(spark):
    pairs = prep.choice_pairs(questions(spark).where("id = 1")).orderBy("choice").collect()
    assert len(pairs) == 5 and {r["label"] for r in pairs} == {1}
    assert pairs[0]["first"] == "[CLS] c c c c"
    assert pairs[1]["second"] == " #### p one [SEP] b b [SEP]"


def test_list_fields_are_joined(spark):
    df = spark.createDataFrame(
        [(1, ["p", "q"], ["c", "d"], "a", ["b", "b"], "c", "d", "e", "A")],
        "id int, prompt array<string>, context array<string>, A string, B array<string>, "
        "C string, D string, E string, answer string",
    )
    pairs = prep.choice_pairs(df).orderBy("choice").collect()
    assert pairs[1]["first"] == "[CLS] c d"
    assert pairs[1]["second"] == " #### p q [SEP] b b [SEP]"


def test_word_lists_are_the_words_of_the_pairs(spark):
    df = prep.fill_missing(questions(spark))
    words = prep.choice_words(df).orderBy("id", "choice").collect()
    pairs = prep.choice_pairs(df).orderBy("id", "choice").collect()
    for w, p in zip(words, pairs, strict=True):
        assert (w["id"], w["choice"], w["label"]) == (p["id"], p["choice"], p["label"])
        assert w["first"] == p["first"].split() and w["second"] == p["second"].split()


def one_by_one(a, b, budget):
    a, b = list(a), list(b)
    while len(a) + len(b) > budget:
        (a if len(a) > len(b) else b).pop()
    return a, b


def test_truncation_equals_removing_words_one_by_one(spark):
    pick = random.Random(1)
    cases = []
    for i in range(80):
        a, b = pick.randint(0, 30), pick.randint(0, 30)
        cases.append((i, " ".join(f"a{j}" for j in range(a)), " ".join(f"b{j}" for j in range(b))))
    pairs = spark.createDataFrame(cases, "id int, first string, second string")
    for budget in (0, 1, 7, 12, 25, 60):
        for row, case in zip(
            prep.truncate_pairs(pairs, budget).orderBy("id").collect(), cases, strict=True
        ):
            expected = one_by_one(case[1].split(), case[2].split(), budget)
            assert (row["first"], row["second"]) == expected


def test_padding(spark):
    df = prep.fill_missing(questions(spark)).where("id <= 3")
    padded = prep.pad_choices(prep.choice_lists(df), 1280, batch_rows=2)
    plan = padded._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line for line in plan.splitlines()) <= 6, plan
    rows = {r["id"]: r for r in padded.collect()}
    assert [rows[i]["batch"] for i in (1, 2, 3)] == [0, 0, 1]
    assert rows[1]["width"] == rows[2]["width"] > rows[3]["width"] - 99
    for row in rows.values():
        assert len(row["words"]) == 5
        for words, mask in zip(row["words"], row["mask"], strict=True):
            assert len(words) == len(mask) == row["width"]
            assert [w == "[PAD]" for w in words] == [m == 0 for m in mask]
    assert rows[2]["words"][0][-1] == "[PAD]"


def test_dense_ids_in_any_partitioning(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("x"), (F.col("id") % 3).alias("y"))
    for parts in (1, 13):
        rows = dense_row_id(df.repartition(parts), ["y", F.desc("x")]).collect()
        rows.sort(key=lambda r: r["row_id"])
        assert [r["row_id"] for r in rows] == list(range(1000))
        assert [(r["y"], -r["x"]) for r in rows] == sorted((r["y"], -r["x"]) for r in rows)
    assert dense_row_id(df.where("x < 0"), ["x"]).count() == 0


def test_first_rows(spark):
    df = spark.range(100).repartition(6)
    for n in (0, 1, 7, 100, 200):
        assert sorted(r["id"] for r in first_rows(df, ["id"], n).collect()) == list(range(min(n, 100)))
    assert nth_key(df.select("id"), 5)["id"] == 4 and nth_key(df.select("id"), 101) is None


def test_filters_do_not_repeat_computed_columns(spark):
    """Each computed column stands in the plan once for the filter and once for the result."""
    texts = spark.range(5).select("id", F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("t"))
    words = F.split("t", " ")
    parts = {"prompt": words[0], "context": F.col("t"), "answer": words[1]}
    parts |= {x: words[i % 3] for i, x in enumerate("ABCDE")}
    kept = prep.keep_evaluable(texts.select("id", *[c.alias(n) for n, c in parts.items()]))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 7 + 7
    assert kept.count() == 5
