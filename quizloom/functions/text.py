"""Text column expressions: templates, normalisation, tokens and n-grams."""

from __future__ import annotations


import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quizloom import constants as K


def _options(letters=K.LETTERS) -> list[Column]:
    return [F.col(letter) for letter in letters]


def retrieval_text(prompt: str = "prompt") -> Column:
    """Search instruction, question and the five lettered options, one per line."""
    parts = [F.lit(K.SEARCH_INSTRUCTION), F.col(prompt), F.lit("\n")]
    for letter in K.LETTERS:
        parts += [F.lit(f"{letter})"), F.col(letter), F.lit("\n")]
    return F.concat(*parts)


def lexical_query(full_text: str = "full_text", strip_instruction: bool = False) -> Column:
    """Query text of the lexical stage, built by one of four rules.

    The "What is" rule drops the first seven and the last character of the retrieval text;
    with ``strip_instruction`` it drops the whole instruction in place of the seven.
    """
    text = F.col(full_text)
    options = F.concat_ws(" ", *_options())
    lead = len(K.SEARCH_INSTRUCTION) if strip_instruction else 7
    stem = F.substring(text, F.lit(lead + 1), F.greatest(F.length(text) - lead - 1, F.lit(0)))
    statements = F.concat_ws(
        " ", *[F.concat(stem, F.lit(" is that "), option) for option in _options()]
    )

    def without(phrase: str) -> Column:
        bare = F.concat(F.replace(text, F.lit(phrase + " "), F.lit("")), options)
        return F.replace(bare, F.lit("?"), F.lit(". "))

    return (
        F.when(text.contains(K.OPENING_WHAT), statements)
        .when(text.contains(K.OPENING_STATEMENTS), without(K.OPENING_STATEMENTS))
        .when(text.contains(K.OPENING_FOLLOWING), without(K.OPENING_FOLLOWING))
        .otherwise(F.concat(text, F.lit(" "), options))
    )


def fill_template(template: str, **fields: Column) -> Column:
    """Concatenate a ``{name}`` template with columns; a null field prints as ``None``."""
    parts: list[Column] = []
    rest = template
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        parts.append(F.coalesce(fields[name], F.lit("None")))
    return F.concat(*parts)


def scoring_prompt(template: str = K.SCORING_PROMPT, prompt: str = "prompt") -> Column:
    """Prompt for a letter-scoring model."""
    fields = {letter.lower(): F.col(letter) for letter in K.LETTERS}
    return fill_template(template, prompt=F.col(prompt), **fields)


def generation_messages(text: str = "wiki_text") -> Column:
    """Two chat messages, the request and the delimited text."""
    mark = F.lit(K.TEXT_DELIMITER)
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(K.GENERATION_REQUEST).alias("content")),
        F.struct(
            F.lit("user").alias("role"),
            F.concat(mark, F.col(text), mark).alias("content"),
        ),
    )


@F.arrow_udf(StringType())
def _nfkd(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, form="NFKD")


def nfkd(text: Column) -> Column:
    """NFKD form. Only texts with a character beyond ASCII are sent to Python."""
    beyond_ascii = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_nfkd(beyond_ascii), text)


def scoring_text(text: Column) -> Column:
    """Passage text as the lexical stage reads it: NFKD, double quotes removed."""
    return F.replace(nfkd(text), F.lit('"'), F.lit(""))


def tokenise(text: Column) -> Column:
    """Lower-cased tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(K.TOKEN_PATTERN), F.lit(0))


def drop_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*K.STOP_WORDS))


def terms(tokens: Column) -> Column:
    """Words and pairs of neighbouring words. Use it directly inside ``explode`` over a
    token column: a projection of its own would be merged with the tokeniser and repeat it.
    """
    following = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))
    pairs = F.zip_with(tokens, following, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, F.filter(pairs, lambda p: p.isNotNull()))


def flatten_list(column: str, is_list: bool) -> Column:
    """Join a list-valued field with blanks; pass a string through."""
    return F.array_join(F.col(column), " ") if is_list else F.col(column)


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lead_sentences(text: Column, n: int = K.LEAD_SENTENCES) -> Column:
    """The first ``n`` sentences, a sentence ending in ``.``, ``!`` or ``?``."""
    sentences = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.array_join(F.slice(sentences, 1, n), "")


def words(text: Column) -> Column:
    """White-space separated words without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")
