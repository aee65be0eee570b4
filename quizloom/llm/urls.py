"""URL filter: site rules first, then a weighted vocabulary found by Aho-Corasick.

A URL with no rule is judged by the terms in it. One pass of the automaton over the
lower-cased URL finds every term; a hit counts only between boundaries (the neighbours on both
sides are no ASCII letter or digit). A strict term has the full weight and rejects alone; soft
terms weigh one each, and count once however often they occur.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule. A
null or empty URL holds no term and is allowed. Repeated rows are judged alike. Other columns
pass through; columns called like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STRICT_TERMS = ("casino", "escort", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT_TERMS = (
    "bet", "bets", "bonus", "cheap", "click", "crypto", "deal", "free", "loan", "pills", "poker", "prize", "slots",
    "win",
)


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host with its subdomains, below a path."""

    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class Vocabulary:
    strict: Sequence[str] = STRICT_TERMS
    soft: Sequence[str] = SOFT_TERMS
    reject_weight: int = 2
    weights: dict[str, int] = field(init=False)

    def __post_init__(self):
        weights = dict.fromkeys((t.lower() for t in self.soft), 1)
        weights |= dict.fromkeys((t.lower() for t in self.strict), self.reject_weight)
        object.__setattr__(self, "weights", weights)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.substring_index(_after_scheme(url), "/", 1)
    return ascii_lower(F.substring_index(F.substring_index(rest, "?", 1), "#", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    return F.substring(rest, F.length(host_of(url)) + F.lit(1), F.length(rest))


def _after_scheme(url: Column) -> Column:
    place = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(place > 0, F.substring(url, place + F.lit(3), F.length(url))).otherwise("")


def automaton_of(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term, weight in vocabulary.weights.items():
        automaton.add_word(term, (term, weight))
    if vocabulary.weights:
        automaton.make_automaton()
    return automaton


def _is_boundary(char: str) -> bool:
    return not (char.isascii() and char.isalnum())


def terms_in(text: str, automaton: ahocorasick.Automaton) -> dict[str, int]:
    """Distinct terms between boundaries, with their weights."""
    found = {}
    if not len(automaton):
        return found
    for last, (term, weight) in automaton.iter(text):
        first = last - len(term) + 1
        before, after = text[first - 1:first] if first else "", text[last + 1:last + 2]
        if (not before or _is_boundary(before)) and (not after or _is_boundary(after)):
            found[term] = weight
    return found


def rule_for(host: str, path: str, by_host: dict[str, list[Rule]]) -> Rule | None:
    """The longest rule of the host or a parent domain whose path starts the URL's."""
    best, suffix = None, host
    while suffix:
        for rule in by_host.get(suffix, ()):
            if path.startswith(rule.path) and (
                best is None or len(rule.host + rule.path) > len(best.host + best.path)
            ):
                best = rule
        suffix = suffix.partition(".")[2]
    return best


def judge_urls(
    df: DataFrame, url: str = "url", rules: Sequence[Rule] = (), vocabulary: Vocabulary | None = None
) -> DataFrame:
    """Adds host, path, rule, verdict, strict_hits and soft_hits. Works row by row, no shuffle.

    Rules and terms are the caller's short lists; they travel with the task.
    """
    vocabulary = vocabulary or Vocabulary()
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    strict = {t.lower() for t in vocabulary.strict}

    @F.pandas_udf("struct<rule: string, verdict: string, strict_hits: int, soft_hits: int>")
    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = automaton_of(vocabulary)
        for part in parts:
            rows = []
            for host, path, text in zip(part["host"], part["path"], part["text"]):
                rule = rule_for(host, path, by_host)
                found = terms_in(text, automaton)
                hits = sum(t in strict for t in found)
                reject = sum(found.values()) >= vocabulary.reject_weight
                verdict = rule.verdict if rule else ("block" if reject else "allow")
                name = rule.host + rule.path if rule else None
                rows.append((name, verdict, hits, len(found) - hits))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "strict_hits", "soft_hits"])

    text = F.coalesce(ascii_lower(F.col(url)), F.lit(""))
    judged = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn(
        "_judged", judge(F.struct("host", "path", text.alias("text")))
    )
    names = ("rule", "verdict", "strict_hits", "soft_hits")
    return judged.withColumns({n: F.col(f"_judged.{n}") for n in names}).drop("_judged")
