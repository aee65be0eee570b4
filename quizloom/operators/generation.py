"""From a category tree and model replies to question tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.functions import text as T
from quizloom.operators.prep import option_letter
from quizloom.runtime import dense_row_id, materialise

PAGE_COLUMNS = ("wiki_text", "page_id", "page_title", "stem_label")


def plain_name(name: Column) -> Column:
    """Category names are compared with blanks in place of underscores."""
    return F.replace(name, F.lit("_"), F.lit(" "))


def member_kind(name: Column, excluded: tuple[str, ...] = K.EXCLUDED_CATEGORIES) -> Column:
    """category, page, or excluded for a category that is not to be entered."""
    left_out = [x.replace("_", " ") for x in excluded]
    return (
        F.when(~name.startswith("Category"), "page")
        .when(plain_name(name).isin(*left_out), "excluded")
        .otherwise("category")
    )


def split_members(
    members: DataFrame, name: str = "child", excluded: tuple[str, ...] = K.EXCLUDED_CATEGORIES
) -> DataFrame:
    return members.withColumn("kind", member_kind(F.col(name), excluded))


def category_pages(
    edges: DataFrame,
    roots: dict[str, tuple[str, ...]],
    excluded: tuple[str, ...] = K.EXCLUDED_CATEGORIES,
    max_depth: int | None = None,
) -> DataFrame:
    """(stem_label, page, depth): pages below each label's root categories.

    Breadth first: the categories of one level are joined with the edges, those already
    visited are left out, so cycles end. Each level is written to the shared folder, which
    keeps plans short and survives lost executors. Edges are prepared and written once; only
    categories travel from level to level.
    ``max_depth=1`` gives the roots' own pages.
    """
    spark = edges.sparkSession
    edges = split_members(
        edges.select(plain_name(F.col("parent")).alias("parent"), "child"), "child", excluded
    ).where(F.col("kind") != "excluded")
    edges = materialise(edges)
    start = [(label, root.replace("_", " ")) for label, names in roots.items() for root in names]
    frontier = spark.createDataFrame(start, "stem_label string, node string")
    visited = frontier
    pages = None
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = materialise(
            frontier.join(edges, F.col("node") == F.col("parent"))
            .select("stem_label", "child", "kind")
            .distinct()
        )
        found = reached.where(F.col("kind") == "page").select(
            "stem_label", F.col("child").alias("page"), F.lit(depth).alias("depth")
        )
        pages = found if pages is None else pages.unionByName(found)
        names = reached.where(F.col("kind") == "category").select(
            "stem_label", plain_name(F.col("child")).alias("node")
        )
        frontier = materialise(
            names.distinct().join(visited, ["stem_label", "node"], "left_anti")
        )
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    if pages is None:
        return spark.createDataFrame([], "stem_label string, page string, depth int")
    return pages.groupBy("stem_label", "page").agg(F.min("depth").alias("depth"))


def unseen_pages(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """Pages not used before; a null id is never matched and stays."""
    return pages.join(seen.select("page_id").distinct(), "page_id", "left_anti")


def lead_texts(pages: DataFrame, text: str = "wiki_text", n: int = K.LEAD_SENTENCES) -> DataFrame:
    return pages.withColumn(text, T.lead_sentences(F.col(text), n))


def with_messages(pages: DataFrame, text: str = "wiki_text") -> DataFrame:
    return pages.withColumn("messages", T.generation_messages(text))


def parse_reply(reply: Column) -> Column:
    """A reply as a list of string maps, null if it is none. The list may be JSON, or as Python
    prints it: in single quotes, with escaped apostrophes."""
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.from_json(T.strip(reply), "array<map<string,string>>", options)


def is_valid(records: Column) -> Column:
    """Exactly five records, each with exactly the seven keys."""
    keys = F.array(*[F.lit(k) for k in sorted(K.RECORD_KEYS)])
    right = F.forall(records, lambda m: F.array_sort(F.map_keys(m)) == keys)
    return F.coalesce((F.size(records) == K.RECORDS_PER_REPLY) & right, F.lit(False))


def with_validity(replies: DataFrame) -> DataFrame:
    parsed = replies.withColumn("records", parse_reply(F.col("reply")))
    return parsed.withColumn("valid", is_valid(F.col("records")))


def first_valid_replies(
    replies: DataFrame, max_attempts: int = K.MAX_ATTEMPTS, with_records: bool = True
) -> DataFrame:
    """Per page the records of its first valid attempt among ``max_attempts``, and the
    number of attempts that failed before it. A page without a valid one has null records.
    """
    tried = with_validity(replies).where(F.col("attempt") <= max_attempts)
    good = F.when(F.col("valid"), F.col("attempt"))
    picked = tried.groupBy("page_id").agg(
        F.min(good).alias("attempt"),
        F.min_by("records", good).alias("records"),
        F.array_sort(F.collect_set(F.when(~F.col("valid"), F.col("attempt")))).alias("_bad"),
    )
    before = F.filter("_bad", lambda a: F.col("attempt").isNull() | (a < F.col("attempt")))
    result = picked.withColumn("failed_attempts", F.size(before).cast("long")).drop("_bad")
    return result if with_records else result.drop("records")


def repair_answer(answer: Column, options: Column) -> Column:
    """The option key: as it is, or that of the option equal to it without case, else null."""
    place = F.array_position(F.transform(options, F.lower), F.lower(answer))
    by_text = F.get(F.array(*[F.lit(k) for k in K.OPTION_KEYS]), place.cast("int") - 1)
    return F.when(answer.isin(*K.OPTION_KEYS), answer).otherwise(by_text)


def question_records(replies: DataFrame, **options) -> DataFrame:
    """One row per generated question, with its page, its place and the repaired answer."""
    valid = first_valid_replies(replies, **options).where(F.col("attempt").isNotNull())
    listed = valid.select("page_id", F.posexplode("records").alias("pos", "record"))
    fields = [F.col("record")[k].alias(k) for k in K.RECORD_KEYS]
    rows = listed.select("page_id", "pos", *fields)
    choices = F.array(*[F.col(k) for k in K.OPTION_KEYS])
    return rows.withColumn("answer", repair_answer(F.col("answer"), choices))


def competition_format(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Question columns under their short names with dense ids and letter answers, followed
    by the page columns. Page texts join after the numbering, so they are not sorted."""
    known = records.join(pages.select("page_id"), "page_id", "left_semi")
    numbered = dense_row_id(known, ["page_id", "pos"], "id").drop("pos")
    renamed = numbered.withColumnsRenamed(
        {"question": "prompt", **dict(zip(K.OPTION_KEYS, K.LETTERS, strict=True))}
    ).withColumn("answer", option_letter(F.col("answer")))
    return renamed.join(pages.select(*PAGE_COLUMNS), "page_id").select(
        "id", "prompt", *K.LETTERS, "answer", *PAGE_COLUMNS
    )


def without_page_columns(df: DataFrame) -> DataFrame:
    return df.drop(*PAGE_COLUMNS)
