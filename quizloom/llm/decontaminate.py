"""Benchmark decontamination by an FM-index per training shard.

Each shard of documents is indexed as a sequence of word numbers. The windows of the benchmark
(13 consecutive words of an item; an item of fewer words is one window) are searched backwards
through the ranks of a wavelet tree, all at once; their occurrences are located by sampled suffix
positions and merged into spans. Words that no item has cannot be in an occurrence, nor can
stretches of known words shorter than the shortest window, so the index holds only the other
words, and an end mark between stretches; this changes no result.

The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text (a single longer
item makes a longer block); each block is one more pass within the same stage. Documents are
neither shuffled nor grouped.

Defined results: a null or empty text has no words and no hits. A null or wordless item has no
windows. Items are listed by distinct id, a null id as an empty string. Repeated documents are
judged alike. Empty tables give no rows or no hits. Columns called like an output column are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom.llm.fm_index import FMIndex
from quizloom.llm.tables import cut_batch

WINDOW = 13
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
_SLICE = 4 << 20
OUTPUTS = ("n_words", "n_hit", "items", "spans")

# After A-Z are lower-cased, words are of these bytes; every byte of a longer UTF-8 form is one.
_WORD_BYTES = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TO_WORDS = bytes(
    low if (low := b + 32 if 0x41 <= b <= 0x5A else b) in _WORD_BYTES else 0x20 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words in order, in lists of a bounded stretch of text each."""
    plain, start = text.translate(_TO_WORDS), 0
    while start < len(plain):
        end = len(plain)
        if end - start > _SLICE:
            blank = plain.find(b" ", start + _SLICE)
            end = blank if blank >= 0 else end
        yield plain[start:end].split()
        start = end


@dataclass
class Phrases:
    """Windows of a block of items: numbered words, and which items have which window."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray
    sizes: np.ndarray
    item_starts: np.ndarray
    item_ids: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], window: int) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [vocabulary.setdefault(w, len(vocabulary) + 1) for part in words_of(text) for w in part]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[i:i + window]), set()).add(item)
        sizes = np.array([len(w) for w in owners], np.int64)
        windows = np.zeros((len(owners), window), np.int64)
        for row, words in zip(windows, owners):
            row[:len(words)] = words
        starts = np.cumsum([0, *(len(o) for o in owners.values())])
        return cls(vocabulary, windows, sizes, starts, [i for o in owners.values() for i in sorted(o)])

    def number(self, text: bytes) -> np.ndarray:
        get = self.vocabulary.get
        parts = [np.array([get(w, 0) for w in words], np.int32) for words in words_of(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _stretches(words: np.ndarray, least: int) -> np.ndarray:
    """Places of the words in unbroken stretches (of words other than 0) of at least ``least``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], words > 0, [False]])))
    first, last = edge[::2], edge[1::2]
    long_ = last - first >= least
    first, last = first[long_], last[long_]
    if not len(first):
        return np.zeros(0, np.int64)
    mark = np.zeros(len(words) + 1, np.int64)
    mark[first] += 1
    mark[last] -= 1
    return np.flatnonzero(np.cumsum(mark[:-1]))


def search_shard(texts: list[bytes | None], phrases: Phrases) -> tuple[list[int], list[list], list[list[str]]]:
    """Per text: number of words, hit stretches of words (start, end), and ids of occurring items."""
    numbered = [phrases.number(t) if t else np.zeros(0, np.int32) for t in texts]
    counts = [len(n) for n in numbered]
    spans: list[list] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not len(phrases.sizes) or not texts:
        return counts, spans, items
    # One 0 behind every text keeps stretches apart.
    flat = np.concatenate([part for n in numbered for part in (n, [0])]).astype(np.int64)
    begins = np.cumsum([0, *(c + 1 for c in counts)])
    places = _stretches(flat, int(phrases.sizes.min()))
    if not len(places):
        return counts, spans, items
    breaks = np.flatnonzero(np.diff(places) != 1) + 1
    kept = np.insert(flat[places], breaks, 0)
    origin = np.insert(places, breaks, -1)
    index = FMIndex(np.append(kept, 0), len(phrases.vocabulary))
    low, high = index.search(phrases.windows, phrases.sizes)
    found = np.flatnonzero(high > low)
    each = high[found] - low[found]
    if not len(found):
        return counts, spans, items
    window = np.repeat(found, each)
    rows = np.arange(len(window)) + np.repeat(low[found] - (np.cumsum(each) - each), each)
    at = origin[index.locate(rows)]

    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.sizes[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    text_of = np.searchsorted(begins, edge[::2], "right") - 1
    for text, first, last in zip(text_of.tolist(), edge[::2].tolist(), edge[1::2].tolist()):
        spans[text].append((first - int(begins[text]), last - int(begins[text])))
    owner = np.searchsorted(begins, at, "right") - 1
    for pair in np.unique(owner * len(phrases.sizes) + window).tolist():
        text, number = divmod(pair, len(phrases.sizes))
        items[text] += phrases.item_ids[phrases.item_starts[number]:phrases.item_starts[number + 1]]
    return counts, spans, [sorted(set(one)) for one in items]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def to_code_points(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words as code points of the text, from the first word's start to the last's end."""
    if not spans:
        return []
    found = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
    return [(found[first][0], found[last - 1][1]) for first, last in spans]


_STATE = "_found"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_STATE_TYPE = pa.struct([("n_words", pa.int64()), ("words", _SPANS), ("spans", _SPANS), ("items", pa.list_(pa.string()))])
_SPARK_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPARK_STATE = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("words", _SPARK_SPANS),
    T.StructField("spans", _SPARK_SPANS), T.StructField("items", T.ArrayType(T.StringType())),
])


def _pairs(spans: list | None) -> list[tuple[int, int]]:
    return [(s["start"], s["end"]) for s in spans or ()]


def _pass(df: DataFrame, text: str, phrases, last: bool, shard_bytes: int) -> DataFrame:
    """Adds what one block of phrases finds to the column of findings."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in cut_batch(batch, text, shard_bytes):
                texts = shard[text].cast(pa.binary()).to_pylist()
                counts, spans, items = search_shard(texts, phrases.value)
                states = []
                for i, before in enumerate(shard[_STATE].to_pylist()):
                    before = before or {}
                    words = merge_spans(_pairs(before.get("words")) + spans[i])
                    states.append({
                        "n_words": counts[i], "words": [{"start": s, "end": e} for s, e in words],
                        "spans": [{"start": s, "end": e} for s, e in to_code_points(texts[i] or b"", words)]
                        if last else None,
                        "items": sorted({*(before.get("items") or ()), *items[i]}),
                    })
                place = shard.schema.get_field_index(_STATE)
                yield shard.set_column(place, _STATE, pa.array(states, _STATE_TYPE))

    return df.mapInArrow(search, df.schema)


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The items as lists of (id, text) of about ``block_bytes`` at most."""
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.col(text_col).cast("binary").alias("text"),
    ).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A block is dealt by hash; half of the bound leaves room for uneven shares.
    blocks = -(-2 * total // block_bytes)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        rows = own.toArrow()
        yield list(zip(rows["id"].to_pylist(), rows["text"].to_pylist()))


def find_hits(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", *, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds n_words, n_hit (words inside any occurrence), items (ids of occurring items) and spans
    (code points to remove, merged) to every row."""
    context = df.sparkSession.sparkContext
    base = df.drop(*OUTPUTS).withColumn(_STATE, F.lit(None).cast(_SPARK_STATE))
    blocks = list(benchmark_blocks(benchmark, item_id, item_text, block_bytes)) or [[]]
    found = base
    for i, items in enumerate(blocks):
        phrases = context.broadcast(Phrases.of(items, window))
        found = _pass(found, text, phrases, i == len(blocks) - 1, shard_bytes)
    state = F.col(_STATE)
    hit = F.aggregate(state["words"], F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.withColumns({
        "n_words": state["n_words"], "n_hit": hit.cast("long"), "items": state["items"], "spans": state["spans"],
    }).drop(_STATE)


def is_contaminated() -> Column:
    """Some word is hit, and at least a twentieth of all words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the spans. Built-in functions only."""
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))),
                     F.array(F.length(text)))
    between = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(text, F.get(edges, 2 * i) + 1, F.get(edges, 2 * i + 1) - F.get(edges, 2 * i)),
    )
    return F.array_join(between, "")
