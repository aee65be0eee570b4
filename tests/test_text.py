import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.functions import text as T
from quizloom.operators import lexical, prep
from registry.queries import queries

PYTHON_TOKENS = re.compile(r"(?u)\b[\w/.-]+\b|!|/|\?|\"|\'")

TEXTS = [
    "Plain words, and a/b c.d e-f.",
    "trailing- -leading / alone // two ... -.-",
    "What's \"this\"? No! 3.14 v1.2-rc/3 _x_",
    "Éclair ñandú straße ﬁne Ⅳ ½ 漢字 x²",
    "",
    "?",
    "tab\tline\nbreak",
]


def python_terms(text, stop=frozenset(K.STOP_WORDS)):
    tokens = [t for t in PYTHON_TOKENS.findall(text.lower()) if t not in stop]
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def column(df, name):
    return [row[name] for row in df.orderBy("id").collect()]


def test_tokens_are_those_of_the_python_pattern(spark):
    nfkd = [unicodedata.normalize("NFKD", t) for t in TEXTS]
    for texts in (TEXTS, nfkd):
        found = frame(spark, texts).select("id", T.tokenise(F.col("text")).alias("t"))
        assert column(found, "t") == [PYTHON_TOKENS.findall(t.lower()) for t in texts]


def test_stop_words():
    assert len(K.STOP_WORDS_RAW.split()) == 129  # "the" is listed twice
    assert len(K.STOP_WORDS) == 127  # "it's" becomes "its", which is also listed
    assert "dont" in K.STOP_WORDS and "don't" not in K.STOP_WORDS


def test_terms_are_formed_after_stop_words(spark):
    found = lexical.exploded_terms(frame(spark, [*TEXTS, "cats and dogs", "the of", "one"]), "id")
    by_id = {}
    for row in found.collect():
        by_id.setdefault(row["id"], []).append(row["term"])
    for i, text in enumerate([*TEXTS, "cats and dogs", "the of", "one"]):
        assert sorted(by_id.get(i, [])) == sorted(python_terms(text))
    assert "cats dogs" in by_id[len(TEXTS)]


def test_tokeniser_stands_once_in_the_plan(spark):
    plan = lexical.exploded_terms(frame(spark), "id")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("regexp_extract_all") == 1


def test_terms_counted_in_runs(spark, monkeypatch):
    """Without an id a term comes once per run, not per occurrence; pairs over the end of a run are
    counted, those over the end of a text are not."""
    texts = [None, "", "of", *TEXTS, "one", "cats and dogs " * 40, "", *["cats dogs"] * 50, "the", None]
    expected = Counter(term for text in texts for term in python_terms(text or ""))
    df = frame(spark, texts).coalesce(1)
    rows = lexical.exploded_terms(df, None).collect()
    assert {row["term"]: row["n"] for row in rows} == expected and len(rows) == len(expected)
    monkeypatch.setattr(lexical, "COUNTED_ROWS", 2)
    for tokens in (1, 2, 3, 7, 64):
        monkeypatch.setattr(lexical, "COUNTED_TOKENS", tokens)
        found = Counter()
        for row in lexical.exploded_terms(df, None).collect():
            found[row["term"]] += row["n"]
        assert found == expected
    assert lexical.exploded_terms(df.where("false"), None).collect() == []


def test_ngrams_are_dealt_out_before_the_grouping(spark, sf_dir):
    """No grouping holds all pairs of a task before the shuffle, and no row stands for one occurrence."""
    found = queries()["ngrams"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    assert plan.rindex("HashAggregate") < plan.index("Exchange") < plan.index("MapInArrow")
    assert found.columns == ["term", "n"]


def test_nfkd_and_quotes(spark):
    texts = ["ﬁ é ½", 'say "é"', "ascii only", None]
    df = frame(spark, texts).select(
        "id", T.nfkd(F.col("text")).alias("n"), T.scoring_text(F.col("text")).alias("s")
    )
    expected = [t and unicodedata.normalize("NFKD", t) for t in texts]
    assert column(df, "n") == expected
    assert column(df, "s") == [t and t.replace('"', "") for t in expected]


def options(spark, prompt):
    df = spark.createDataFrame(
        [(1, prompt, "a1", "b 2", None, "d?", "e")],
        "id long, prompt string, A string, B string, C string, D string, E string",
    )
    return prep.with_lexical_query(prep.with_retrieval_text(prep.fill_missing(df))).first()


def test_retrieval_text(spark):
    row = options(spark, "Why?")
    assert row["full_text"] == (
        "Represent this sentence for searching relevant passages: Why?\n"
        "A)a1\nB)b 2\nC)There is no correct answer\nD)d?\nE)e\n"
    )


def test_query_rules(spark):
    choices = ["a1", "b 2", K.NO_ANSWER, "d?", "e"]
    joined = " ".join(choices)

    row = options(spark, "What is it? Which of the following is right?")
    stem = row["full_text"][7:-1]
    assert stem.startswith("nt this sentence")
    assert row["query_text"] == " ".join(f"{stem} is that {c}" for c in choices)

    row = options(spark, "Which of the following statements hold?")
    short = row["full_text"].replace("Which of the following statements ", "")
    assert row["query_text"] == (short + joined).replace("?", ". ")

    row = options(spark, "Which of the following is so?")
    short = row["full_text"].replace("Which of the following is ", "")
    assert row["query_text"] == (short + joined).replace("?", ". ")

    row = options(spark, "Why?")
    assert row["query_text"] == row["full_text"] + " " + joined


def test_instruction_can_be_stripped(spark):
    df = spark.createDataFrame(
        [(1, "What is it?", *"abcde")],
        "id long, prompt string, A string, B string, C string, D string, E string",
    )
    row = prep.with_lexical_query(prep.with_retrieval_text(df), strip_instruction=True).first()
    assert row["query_text"].startswith("What is it?\nA)a")


def test_scoring_prompt_keeps_blank_lines(spark):
    df = spark.createDataFrame(
        [(1, "Q", "1", "2", "3", "4", None)],
        "id long, prompt string, A string, B string, C string, D string, E string",
    )
    text = prep.with_scoring_prompt(df).first()["text"]
    assert text.splitlines()[1:] == [
        "Question: Q", "", "A) 1", "", "B) 2", "", "C) 3", "", "D) 4", "", "E) None", "", "",
        "Answer:",
    ]


def test_lead_sentences(spark):
    text = "One. Two! Three? 4. 5. 6. 7. 8."
    df = frame(spark, [text, "no end"]).select("id", T.lead_sentences(F.col("text")).alias("t"))
    assert column(df, "t") == ["One. Two! Three? 4. 5. 6. 7.", "no end"]
