"""Question tables: missing values, row filters, labels, and per-option pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.functions import text as T
from quizloom.runtime import dense_row_id

QUESTION_COLUMNS = ("prompt", *K.LETTERS, "answer")
PAIRED_COLUMNS = ("prompt", "context", *K.LETTERS, "answer")
SEPARATOR = "[SEP]"


def fill_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Put the no-answer text in place of nulls, in all string columns or the named ones."""
    return df.na.fill(K.NO_ANSWER, subset=columns)


def fill_options(df: DataFrame) -> DataFrame:
    return fill_missing(df, list(K.LETTERS))


def keep_complete(
    df: DataFrame, columns: tuple[str, ...], stored: bool = False
) -> DataFrame:
    """Rows without a null in the columns.

    With ``stored``, for columns as they lie in a file, there is a condition for each, which
    reaches the scan. Else the condition stays in one piece: single ones would be pushed
    through computed columns, which are then computed once for each.
    """
    if not stored:
        return df.dropna(subset=list(columns))
    condition = F.lit(True)
    for column in columns:
        condition = condition & F.col(column).isNotNull()
    return df.where(condition)


def keep_trainable(df: DataFrame, stored: bool = False) -> DataFrame:
    return keep_complete(df, ("prompt", "answer"), stored)


def keep_evaluable(df: DataFrame, stored: bool = False) -> DataFrame:
    return keep_complete(df, PAIRED_COLUMNS, stored)


def letter_index(letter: Column) -> Column:
    """0-4 for A-E, null for anything else."""
    return F.get(
        F.array(*[F.lit(i) for i in range(5)]),
        F.array_position(F.array(*[F.lit(x) for x in K.LETTERS]), letter).cast("int") - 1,
    )


def index_letter(index: Column) -> Column:
    """A-E for 0-4, null for anything else."""
    return F.get(F.array(*[F.lit(x) for x in K.LETTERS]), index.cast("int"))


def option_letter(label: Column) -> Column:
    """A-E for option_1-option_5, null for anything else."""
    return index_letter(
        F.array_position(F.array(*[F.lit(x) for x in K.OPTION_KEYS]), label).cast("int") - 1
    )


def with_retrieval_text(df: DataFrame) -> DataFrame:
    return df.withColumn("full_text", T.retrieval_text())


def with_lexical_query(df: DataFrame, strip_instruction: bool = False) -> DataFrame:
    return df.withColumn("query_text", T.lexical_query("full_text", strip_instruction))


def with_scoring_prompt(df: DataFrame, template: str = K.SCORING_PROMPT) -> DataFrame:
    return df.withColumn("text", T.scoring_prompt(template))


def join_text_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn list-valued columns into strings; string columns stay as they are."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: T.flatten_list(c, types[c].startswith("array")) for c in columns}
    )


def choice_pairs(df: DataFrame, id_column: str = "id") -> DataFrame:
    """Five rows per question: context, question with one option, option and label index."""
    flat = join_text_lists(df, list(PAIRED_COLUMNS[:-1]))
    options = F.array(*[F.col(letter) for letter in K.LETTERS])
    listed = flat.select(
        id_column, "prompt", "context", letter_index(F.col("answer")).alias("label"),
        F.posexplode(options).alias("choice", "option"),
    )
    return listed.select(
        id_column, "choice",
        F.concat(F.lit("[CLS] "), F.col("context")).alias("first"),
        F.concat(
            F.lit(" #### "), F.col("prompt"), F.lit(f" {SEPARATOR} "), F.col("option"),
            F.lit(f" {SEPARATOR}"),
        ).alias("second"),
        "label",
    )


def choice_lists(df: DataFrame, id_column: str = "id") -> DataFrame:
    """``choice_pairs`` as word lists, a row per question: ``first`` once, and in ``seconds`` the
    question with each of its five options."""
    flat = join_text_lists(df, list(PAIRED_COLUMNS[:-1]))
    split = flat.select(
        id_column, letter_index(F.col("answer")).alias("label"),
        T.words(F.concat(F.lit("[CLS] "), F.col("context"))).alias("first"),
        T.words(F.concat(F.lit("#### "), F.col("prompt"), F.lit(f" {SEPARATOR}"))).alias("stem"),
        *K.LETTERS,
    )
    options = [T.words(F.concat(F.col(x), F.lit(f" {SEPARATOR}"))) for x in K.LETTERS]
    return split.select(
        id_column, "first", F.array(*[F.concat("stem", o) for o in options]).alias("seconds"), "label"
    )


def choice_words(df: DataFrame, id_column: str = "id") -> DataFrame:
    """``choice_lists`` as five rows per question."""
    return choice_lists(df, id_column).select(
        id_column, "first", "label", F.posexplode("seconds").alias("choice", "second")
    ).select(id_column, "choice", "first", "second", "label")


def _kept_sizes(a: Column, b: Column, budget: int) -> tuple[Column, Column]:
    """Words left of two lists of ``a`` and ``b`` words, cut one at a time from the longer."""
    keep_a = F.least(a, F.greatest(F.lit(budget) - b, F.lit((budget + 1) // 2)))
    keep_b = F.least(b, F.greatest(F.lit(budget) - a, F.lit(budget // 2)))
    return keep_a, keep_b


def truncate_pairs(pairs: DataFrame, budget: int = K.TRAIN_TOKENS) -> DataFrame:
    """Cut the word lists of a pair to ``budget`` words, from the longer side, on a tie from
    the second. Removing one word at a time ends in these two sizes. Pairs may come as word
    lists or as strings."""
    kinds = dict(pairs.dtypes)
    split = {c: T.words(F.col(c)) for c in ("first", "second") if kinds[c] == "string"}
    with_words = pairs.withColumns(split) if split else pairs
    keep_a, keep_b = _kept_sizes(F.size("first"), F.size("second"), budget)
    return with_words.withColumns(
        {"first": F.slice("first", 1, keep_a), "second": F.slice("second", 1, keep_b)}
    )


def cut_choices(lists: DataFrame, budget: int = K.TRAIN_TOKENS, id_column: str = "id") -> DataFrame:
    """``truncate_pairs`` of ``choice_lists``: five rows per question, of which each list was cut
    before the question became rows."""
    def cut(second: Column) -> Column:
        keep_a, keep_b = _kept_sizes(F.size("first"), F.size(second), budget)
        return F.struct(
            F.slice("first", F.lit(1), keep_a).alias("first"), F.slice(second, F.lit(1), keep_b).alias("second"))

    pairs = lists.select(id_column, "label", F.posexplode(F.transform("seconds", cut)).alias("choice", "pair"))
    return pairs.select(id_column, "choice", "pair.first", "pair.second", "label")


def pad_choices(
    lists: DataFrame,
    budget: int = K.TRAIN_TOKENS,
    id_column: str = "id",
    batch_rows: int = K.BATCH_ROWS,
    pad: str = "[PAD]",
) -> DataFrame:
    """One row per question with its five word lists, cut to ``budget`` and padded to the
    longest of the batch. ``lists`` is of ``choice_lists``, with unique ids.

    Batches take ``batch_rows`` questions in id order. ``mask`` is 1 for a word and 0 for
    padding. A batch is a handful of rows, so its window stays small.
    """
    def joined(second: Column) -> Column:
        keep_a, keep_b = _kept_sizes(F.size("first"), F.size(second), budget)
        return F.concat(F.slice("first", F.lit(1), keep_a), F.slice(second, F.lit(1), keep_b))

    cut = lists.select(id_column, "label", F.transform("seconds", joined).alias("words"))
    ids = dense_row_id(lists.select(id_column), [id_column], "row_id").select(
        id_column, F.floor(F.col("row_id") / F.lit(batch_rows)).cast("long").alias("batch")
    )
    longest = F.array_max(F.transform("words", F.size))
    width = F.max(longest).over(Window.partitionBy("batch"))
    rows = cut.join(ids, id_column).withColumn("width", width)

    def padded(words: Column, mark: Column, rest: Column) -> Column:
        return F.concat(mark, F.array_repeat(rest, F.col("width") - F.size(words)))

    return rows.select(
        "batch", id_column, "width",
        F.transform("words", lambda w: padded(w, w, F.lit(pad))).alias("words"),
        F.transform(
            "words", lambda w: padded(w, F.array_repeat(F.lit(1), F.size(w)), F.lit(0))
        ).alias("mask"),
        "label",
    )
