"""Secret scan: a trigram inverted index chooses the texts each rule has to be tried on.

From a rule's regular expression a Boolean query over trigrams is derived: every match has to
hold a trigram combination that fulfils it. For each shard of texts, postings (the texts that
hold a trigram) are built for the trigrams that some rule asks for, intersected and united as the
query says, and the expression runs on these candidates only. A rule without mandatory trigrams
runs on all texts.

Trigrams are of bytes with A-Z lower-cased, for texts and rules alike, so that rules in either
case share the index; candidates may then be more than needed, never fewer.

Matches of a rule are leftmost and do not overlap; those whose measured group is shorter than
``least`` are dropped afterwards. Spans are code points, end exclusive. Defined results: null and
empty texts have no spans; repeated rows have the same ones; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

SHARD_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``quick`` may be an equivalent of pattern and least that fails sooner."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    quick: str | None = None


# The base rules keep the contract's order, which breaks ties of spans that start together.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=1, least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # A run of fewer than 24 characters is no match either way.
    Rule("hex", r"[0-9a-f]+", least=24, quick=r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

# A whole block, to the END line before any other BEGIN or END; without one, the headers and the
# run of base64 lines that follow.
_KEY = r"(?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----"
_BLANK = r"(?:[\x20\t\r\n]|\\[nr])"
_PRIVATE_KEY = (
    rf"-----BEGIN {_KEY}(?:"
    rf"(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END {_KEY}"
    rf"|(?:{_BLANK}*+(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID): [^\r\n]*+)*+"
    rf"(?:(?:{_BLANK}*+[A-Za-z0-9+/]{{24,}}+={{0,2}})++"
    rf"(?:\r?\n[A-Za-z0-9+/]{{1,23}}+={{0,2}}(?=[\x20\t]*(?:[\r\n]|\Z)))?"
    rf"(?:\r?\n=[A-Za-z0-9+/]{{4}})?)?)"
)
# For redaction. The scan reports the BEGIN line alone, as its SQL does.
REDACTION_RULES = (*RULES, Rule("private_key_block", _PRIVATE_KEY))

# ---------------------------------------------------------------- trigram queries

ALL = ("all",)
_MOST_STRINGS = 16


def _both(kind: str, queries: list) -> tuple:
    """An AND or OR; ALL, which every text fulfils, is dropped from an AND and swallows an OR."""
    if kind == "or" and ALL in queries:
        return ALL
    parts = [q for q in dict.fromkeys(queries) if q != ALL]
    if not parts:
        return ALL
    return parts[0] if len(parts) == 1 else (kind, *parts)


def _of_string(text: str) -> tuple:
    data = text.encode().lower()
    return _both("and", [("has", data[i:i + 3]) for i in range(len(data) - 2)])


def _close(strings: set[str]) -> tuple:
    return _both("or", [_of_string(s) for s in sorted(strings)])


def _class_strings(items: list) -> set[str] | None:
    """The characters of a small class."""
    found: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(chr(value))
        elif op is C.RANGE and value[1] - value[0] < _MOST_STRINGS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    found = {f.lower() if f.isascii() else f for f in found}
    return found if len(found) <= _MOST_STRINGS else None


def _exact(op, value) -> set[str] | None:
    """All strings of a node, if they are few."""
    if op is C.LITERAL:
        return {chr(value)}
    if op is C.IN:
        return _class_strings(value)
    if op is C.SUBPATTERN:
        return _exact_sequence(value[3])
    if op is C.BRANCH:
        each = [_exact_sequence(part) for part in value[1]]
        found = set().union(*(e for e in each if e is not None))
        return None if None in each or len(found) > _MOST_STRINGS else found
    if op is C.MAX_REPEAT and value[1] == 1:
        found = _exact_sequence(value[2])
        return found if found is None or value[0] == 1 else found | {""}
    return None


def _exact_sequence(parsed) -> set[str] | None:
    strings = {""}
    for op, value in parsed:
        own = _exact(op, value)
        if own is None or len(own) * len(strings) > _MOST_STRINGS:
            return None
        strings = {a + b for a in strings for b in own}
    return strings


def _query(parsed) -> tuple:
    """Neighbouring nodes with few strings grow together; where that ends, the trigrams of what
    has grown are mandatory."""
    parts, grown = [], {""}
    for op, value in parsed:
        own = _exact(op, value)
        if own is not None and len(own) * len(grown) <= _MOST_STRINGS:
            grown = {a + b for a in grown for b in own}
            continue
        parts.append(_close(grown))
        grown = own or {""}
        if own is None:
            if op is C.SUBPATTERN:
                parts.append(_query(value[3]))
            elif op is C.BRANCH:
                parts.append(_both("or", [_query(part) for part in value[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
                parts.append(_query(value[2]))
    return _both("and", [*parts, _close(grown)])


def trigram_query(pattern: str) -> tuple:
    """("has", trigram), ("and", …), ("or", …) or ALL."""
    return _query(_parser.parse(pattern, re.ASCII))


def trigrams_of(query: tuple) -> set[bytes]:
    if query[0] == "has":
        return {query[1]}
    return set().union(*(trigrams_of(q) for q in query[1:])) if len(query) > 1 else set()


# ---------------------------------------------------------------- index of a shard


class Postings:
    """Texts of a shard by trigram, for the given trigrams."""

    def __init__(self, texts: list[bytes], lookup: np.ndarray, trigrams: list[bytes]):
        self.count = len(texts)
        joined = np.frombuffer(b"\x00\x00".join(texts).lower(), np.uint8)
        ends = np.cumsum([len(t) + 2 for t in texts])
        self._texts: dict[bytes, np.ndarray] = {}
        if len(joined) < 3:
            self._texts = {t: np.zeros(0, np.int64) for t in trigrams}
            return
        wide = joined.astype(np.int32)
        number = lookup[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]]
        at = np.flatnonzero(number)
        owner = np.searchsorted(ends, at, "right")
        pairs = np.unique(number[at].astype(np.int64) * self.count + owner)
        bounds = np.searchsorted(pairs, np.arange(1, len(trigrams) + 2) * self.count)
        for i, trigram in enumerate(trigrams):
            self._texts[trigram] = pairs[bounds[i]:bounds[i + 1]] % self.count

    def matches(self, query: tuple) -> np.ndarray:
        if query == ALL:
            return np.arange(self.count)
        if query[0] == "has":
            return self._texts[query[1]]
        each = [self.matches(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(each))
        found = each[0]
        for other in each[1:]:
            found = np.intersect1d(found, other, assume_unique=True)
        return found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(rule.pattern) for rule in rules]
        self._compiled = [re.compile(rule.quick or rule.pattern, re.ASCII) for rule in rules]
        self._trigrams = sorted(set().union(*map(trigrams_of, self.queries)))
        self._lookup = np.zeros(1 << 24, np.int16)
        for number, trigram in enumerate(self._trigrams, 1):
            self._lookup[int.from_bytes(trigram, "big")] = number

    def _spans(self, rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
        return [
            m.span() for m in compiled.finditer(text)
            if m.end(rule.group) - m.start(rule.group) >= rule.least
        ]

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text: (start, rule, end), sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = Postings([t.encode() for t in texts], self._lookup, self._trigrams)
        for number, (rule, query, compiled) in enumerate(zip(self.rules, self.queries, self._compiled)):
            for i in postings.matches(query).tolist():
                found[i] += [(s, number, e) for s, e in self._spans(rule, compiled, texts[i])]
        return [sorted(one) for one in found]


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


# ---------------------------------------------------------------- operator

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_SPAN_TYPE = StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
])


def find_secrets(text: Column, rules: tuple[Rule, ...] = RULES, shard_bytes: int = SHARD_BYTES) -> Column:
    """All spans of a text as an array of (kind, start, end), by start, then in the rules' order."""

    @F.arrow_udf(ArrayType(_SPAN_TYPE))
    def scan(column: pa.Array) -> pa.Array:
        own, spans, shard, size = scanner(rules), [], [], 0

        def close() -> None:
            spans.extend([
                [{"kind": rules[n].kind, "start": s, "end": e} for s, n, e in one] for one in own.scan(shard)
            ])
            shard.clear()

        for value in column:
            body = value.as_py() or ""
            shard.append(body)
            size += len(body)
            if size >= shard_bytes:
                close()
                size = 0
        if shard:
            close()
        return pa.array(spans, pa.list_(_SPAN))

    return scan.asNondeterministic()(text)  # so that plans keep one evaluation


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each stretch of spans that touch or overlap replaced by ``[secret]``; null
    for a null text. ``spans`` are sorted by start. Built-in functions only."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        fresh = (span["start"] > state["at"]) | (state["at"] == 0)
        kept = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(
            F.when(fresh, F.concat(state["out"], kept, F.lit("[secret]"))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    done = F.aggregate(
        spans, start, step,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
