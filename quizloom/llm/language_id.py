"""Language of texts by a linear-chain conditional random field over their words.

Each word has a hidden language. Its features are prefixes and suffixes of up to three bytes, all
bigrams and trigrams with the word's end, and what a lexicon says: which language uses the word
most, how clearly, and how often it was seen. Learned transitions tie neighbouring words, and
forward-backward gives each word's language probabilities, also where a text switches languages.
A text's language is the one with the largest mean probability over its words; the score is that
mean.

The lexicon counts every word of all labelled texts in a distributed aggregate, folded into
2 ** ``LEXICON_BITS`` buckets. The weights are fitted on a sample of at most
``SAMPLE_BYTES`` bytes per language and one passage: of the language's distinct passages with
words, texts or stretches of ``SAMPLE_TEXT`` bytes at most, those with the smallest hashes. So
every language with labelled words is fitted, however large it is and however often its texts are
repeated. Short stretches of the sample are mixed into switching chains.

Chains are worked on in blocks: the transfer matrix of each block, a scan over a text's blocks,
then all blocks at once; so one long text costs few steps. Texts beyond ``grams.SLICE_CHARS``
are several chains.

Defined results: a null text or one without a letter is ``und`` with score 0, as is everything
if no labelled text was given. Ties go to the language that comes first by name. Rows without a
language are not learnt from. Repeated texts get the same result; an empty table gives an empty
result. Columns called like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quizloom.llm.grams import Words, bucket, slices
from quizloom.runtime import materialise

FEATURE_BITS = 18
LEXICON_BITS = 21
SAMPLE_BYTES = 600_000
SAMPLE_TEXT = 64_000
CHAIN = 96
BLOCK = 32
UNKNOWN = "und"
_AFFIXES = 3
_SEEN = (1, 3, 10)  # bounds of how often a word was seen


def _hashed(kind: int, value: np.ndarray) -> np.ndarray:
    mixed = (value.astype(np.uint64) + np.uint64(kind << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def features(words: Words, lexicon: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Feature numbers a word, and feature numbers a byte of the words."""
    data, sizes, starts = words.data.astype(np.int64) + 1, words.sizes, words.starts
    padded = np.concatenate([data, np.zeros(_AFFIXES, np.int64)])
    by_word = []
    for size in range(1, _AFFIXES + 1):
        # A word shorter than the affix has a mark of its own for what is missing.
        front, back = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for i in range(size):
            inside = i < sizes
            front = front << 9 | np.where(inside, padded[starts + i], 0)
            back = back << 9 | np.where(inside, padded[np.maximum(starts + sizes - 1 - i, 0)], 0)
        by_word += [_hashed(size, front), _hashed(4 + size, back)]
    by_word.append(_hashed(8, lexicon[bucket(words.hashes(), LEXICON_BITS)].astype(np.int64)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(data))  # bytes up to the word's end
    second = np.where(left > 1, padded[1:len(data) + 1], 0)
    third = np.where(left > 2, padded[2:len(data) + 2], 0)
    pair = data << 9 | second
    return by_word, [_hashed(9, pair), _hashed(10, pair << 9 | third)]


def emissions(words: Words, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of each language, by word."""
    if not len(words.sizes):
        return np.zeros((0, weights.shape[1]), np.float32)
    by_word, by_byte = features(words, lexicon)
    total = sum(weights[ids] for ids in by_word)
    for ids in by_byte:
        total += np.add.reduceat(weights[ids], words.starts, axis=0)
    return total


def _scaled(rows: np.ndarray) -> np.ndarray:
    return rows / rows.sum(axis=-1, keepdims=True)


def marginals(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Forward-backward over chains that lie end to end: probabilities of the states, by place."""
    states = scores.shape[1]
    owns = np.flatnonzero(counts)
    if not len(owns):
        return np.zeros_like(scores, dtype=np.float64)
    lengths = counts[owns]
    blocks = -(-lengths // block)
    total, first_block = int(blocks.sum()), np.cumsum(blocks) - blocks
    # Place of each word in the padded blocks.
    inside = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    slot = np.repeat(first_block * block, lengths) + inside
    emit = np.ones((total * block, states))
    emit[slot] = np.exp(scores - scores.max(axis=1, keepdims=True))
    real = np.zeros(total * block, bool)
    real[slot] = True
    opening = np.zeros(total, bool)
    opening[first_block] = True
    emit, real = emit.reshape(total, block, states), real.reshape(total, block)
    move = np.exp(transitions - transitions.max())
    even = np.ones_like(move)

    def through(rows: np.ndarray, place: int) -> np.ndarray:
        """Row vectors moved to the place and weighed by its emissions; padding changes nothing."""
        moved = rows @ move
        if place == 0:
            moved[opening] = rows[opening] @ even
        moved = moved * (emit[:, place, None] if rows.ndim == 3 else emit[:, place])
        keep = ~real[:, place]
        moved[keep] = rows[keep]
        return moved

    def back(rows: np.ndarray, place: int) -> np.ndarray:
        """Column vectors moved from the place to the one before it."""
        moved = (rows * emit[:, place]) @ move.T
        keep = ~real[:, place]
        moved[keep] = rows[keep]
        return moved

    transfer = np.repeat(np.eye(states)[None], total, axis=0)
    for place in range(block):
        transfer = through(transfer, place)
        transfer /= transfer.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((total, states)), np.empty((total, states))
    for step in range(int(blocks.max())):
        now = first_block[blocks > step] + step
        ahead[now] = 1 / states if step == 0 else _scaled(np.einsum("ni,nij->nj", ahead[now - 1], transfer[now - 1]))
    for step in range(int(blocks.max())):
        chosen = blocks > step
        now = (first_block + blocks - 1)[chosen] - step
        behind[now] = 1 / states if step == 0 else _scaled(np.einsum("nij,nj->ni", transfer[now + 1], behind[now + 1]))
    forward = np.empty_like(emit)
    rows = ahead
    for place in range(block):
        rows = _scaled(through(rows, place))
        forward[:, place] = rows
    rows = behind
    for place in range(block - 1, -1, -1):
        forward[:, place] *= rows
        rows = _scaled(back(rows, place))
    return _scaled(forward.reshape(-1, states)[slot])


# ---------------------------------------------------------------- learning


def count_lexicon(labelled: DataFrame, text: str, lang: Column, names: list[str]) -> DataFrame:
    """(word bucket, number of the language, count) over all labelled texts."""
    place = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([place[name] for name in batch["lang"].to_pylist()], np.int64)
            for owners, parts in slices(t.as_py() or "" for t in batch["text"]):
                words = Words.of(parts)
                key = bucket(words.hashes(), LEXICON_BITS) * len(names) + np.repeat(own[owners], words.counts)
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key // len(names), pa.int32()), pa.array(key % len(names), pa.int32()), pa.array(n)],
                    names=["word", "lang", "n"],
                )

    rows = labelled.select(F.col(text).alias("text"), lang.alias("lang"))
    return rows.mapInArrow(count, "word int, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def lexicon_marks(counts: DataFrame, languages: int) -> np.ndarray:
    """What the lexicon says of each bucket: 0, or a number for language, clarity and frequency."""
    clear = F.max(F.struct("n", -F.col("lang")))
    best = counts.groupBy("word").agg(F.sum("n").alias("all"), clear.alias("_best"))
    got = best.select("word", "all", F.col("_best.n").alias("n"), (-F.col("_best")["col2"]).alias("lang")).toArrow()
    marks = np.zeros(1 << LEXICON_BITS, np.uint16)
    total, most = got["all"].to_numpy(), got["n"].to_numpy()
    seen = np.searchsorted(_SEEN, total, "left")
    purity = (most > 0.6 * total).astype(np.int64) + (most > 0.95 * total)
    marks[got["word"].to_numpy()] = 1 + (got["lang"].to_numpy() * 3 + purity) * (len(_SEEN) + 1) + seen
    return marks


def mixed_chains(texts: list[str], langs: np.ndarray, seed: int = 3) -> tuple[Words, np.ndarray]:
    """Words of the texts in passages of 5 to 30, shuffled into one switching sequence cut into
    chains of ``CHAIN`` words, and each word's language."""
    rng = np.random.default_rng(seed)
    words = Words.of(texts)
    ends = np.cumsum(words.counts)
    passages = []
    for start, end, lang in zip(ends - words.counts, ends, langs):
        while start < end:
            stop = min(end, start + int(rng.integers(5, 31)))
            passages.append((int(start), int(stop), int(lang)))
            start = stop
    rng.shuffle(passages)
    order = np.concatenate([np.arange(s, e) for s, e, _ in passages] or [np.zeros(0, np.int64)]).astype(np.int64)
    label = np.repeat([x for _, _, x in passages], [e - s for s, e, _ in passages]).astype(np.int64)
    usable = len(order) // CHAIN * CHAIN or len(order)
    order, label = order[:usable], label[:usable]
    sizes = words.sizes[order]
    starts = np.repeat(words.starts[order] - (np.cumsum(sizes) - sizes), sizes)
    data = words.data[starts + np.arange(len(starts))]
    chains = np.full(max(1, usable // CHAIN), min(CHAIN, usable))
    return Words(data, sizes, chains), label


def _part(words: Words, first: int, last: int) -> Words:
    """Chains first to last of equal length."""
    step = int(words.counts[0])
    low, high = first * step, last * step
    ends = np.cumsum(words.sizes)
    begin = int(ends[low - 1]) if low else 0
    return Words(words.data[begin:int(ends[high - 1])], words.sizes[low:high], words.counts[first:last])


def expectations(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains of equal length (chain, place, state): probabilities of the
    states, and expected number of moves from state to state over all chains."""
    chains, step, states = scores.shape
    emit, move = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(moves - moves.max())
    ahead, behind = np.empty(emit.shape), np.ones(emit.shape)
    ahead[:, 0] = _scaled(emit[:, 0])
    for place in range(1, step):
        ahead[:, place] = _scaled((ahead[:, place - 1] @ move) * emit[:, place])
    for place in range(step - 1, 0, -1):
        behind[:, place - 1] = _scaled((behind[:, place] * emit[:, place]) @ move.T)
    arrive = (behind * emit)[:, 1:]
    joint = ahead[:, :-1, :, None] * move * arrive[:, :, None]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return _scaled(ahead * behind), joint.sum(axis=(0, 1))


def fit_weights(
    words: Words, label: np.ndarray, languages: int, lexicon: np.ndarray, *, epochs: int = 4,
    chains: int = 64, rate: float = 0.2, seed: int = 5,
) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights and transitions by adaptive gradient steps on the chains' likelihood."""
    weights = np.zeros((1 << FEATURE_BITS, languages), np.float32)
    moves = np.zeros((languages, languages))
    seen_w, seen_m = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    step = int(words.counts[0])
    rng, groups = np.random.default_rng(seed), list(range(0, len(words.counts), chains))
    for _ in range(epochs):
        for first in rng.permutation(groups).tolist():
            last = min(first + chains, len(words.counts))
            part, truth = _part(words, first, last), label[first * step:last * step]
            scores = emissions(part, lexicon, weights)
            found, expected = expectations(scores.reshape(last - first, step, languages).astype(float), moves)
            error = -found.reshape(-1, languages)
            error[np.arange(len(truth)), truth] += 1
            error /= last - first
            by_word, by_byte = features(part, lexicon)
            slope = np.zeros_like(weights)
            spread = np.repeat(error, part.sizes, axis=0)
            for ids, share in [(i, error) for i in by_word] + [(i, spread) for i in by_byte]:
                for lang in range(languages):
                    slope[:, lang] += np.bincount(ids, share[:, lang], minlength=len(weights))
            inner = np.arange(len(truth)).reshape(-1, step)[:, :-1].ravel()
            slope_m = -expected
            np.add.at(slope_m, (truth[inner], truth[inner + 1]), 1)
            slope_m /= last - first
            seen_w += slope**2
            seen_m += slope_m**2
            weights += rate * slope / np.sqrt(seen_w)
            moves += rate * slope_m / np.sqrt(seen_m)
    return weights, moves


@dataclass
class Model:
    names: list[str]
    lexicon: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def word_probabilities(self, words: Words) -> np.ndarray:
        return marginals(emissions(words, self.lexicon, self.weights), words.counts, self.moves)

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sums = np.zeros((len(texts), len(self.names)))
        for owners, parts in slices(t or "" for t in texts):
            words = Words.of(parts)
            found, owner = self.word_probabilities(words), np.repeat(owners, words.counts)
            for lang in range(len(self.names)):
                sums[:, lang] += np.bincount(owner, found[:, lang], minlength=len(texts))
        known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool) & (sums.sum(axis=1) > 0)
        share = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)
        best = share.argmax(axis=1)
        score = np.where(known, np.minimum(share.max(axis=1), 1.0), 0.0)
        return [self.names[b] if k else UNKNOWN for b, k in zip(best, known)], score


_WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]")
_PASSAGE_CHARS = SAMPLE_TEXT // 4  # of four bytes at most
_DRAW_LEVELS = 8  # of the hashes, for each power of two


def passages(text: str) -> Iterator[tuple[int, bytes, str]]:
    """Hash, bytes and text of each passage that has a word."""
    whole = len(text) <= _PASSAGE_CHARS or len(text.encode()) <= SAMPLE_TEXT
    step = max(1, len(text)) if whole else _PASSAGE_CHARS
    for start in range(0, len(text), step):
        part = text[start:start + step]
        if _WORD.search(part):
            data = part.encode()
            yield int.from_bytes(hashlib.blake2b(data, digest_size=8).digest()) >> 1, data, part


def _level(draw: int) -> int:
    """Rises with the draw, in steps of a fixed share of it."""
    shift = max(0, draw.bit_length() - _DRAW_LEVELS.bit_length())
    return shift * _DRAW_LEVELS + (draw >> shift)


def draw_sample(rows: DataFrame, sample_bytes: int) -> DataFrame:
    """(lang, text): of each language the distinct passages with the smallest hashes, up to
    ``sample_bytes`` bytes before the last one. ``rows`` are (text, lang)."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for text, lang in zip(batch["text"], batch["lang"].to_pylist()):
                for draw, data, _ in passages(text.as_py()):
                    found[lang, draw] = len(data)
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
                pa.array([_level(k[1]) for k in found], pa.int32()), pa.array(found.values(), pa.int64()),
            ], names=["lang", "draw", "level", "size"])

    distinct = rows.mapInArrow(sizes, "lang string, draw long, level int, size long").groupBy("lang", "draw").agg(
        F.first("level").alias("level"), F.max("size").alias("size"))
    listed = distinct.groupBy("lang", "level").agg(F.sum("size").alias("size")).orderBy("lang", "level").collect()
    last: dict[str, int] = {}
    taken: dict[str, int] = {}
    for row in listed:  # the first levels that hold enough
        if taken.get(row.lang, 0) < sample_bytes:
            last[row.lang] = row.level
            taken[row.lang] = taken.get(row.lang, 0) + row.size

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for text, lang in zip(batch["text"], batch["lang"].to_pylist()):
                for draw, data, part in passages(text.as_py()):
                    if _level(draw) <= last.get(lang, -1):
                        found[lang, draw] = (part, len(data))
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
                pa.array([v[0] for v in found.values()], pa.string()), pa.array([v[1] for v in found.values()], pa.int64()),
            ], names=["lang", "draw", "text", "size"])

    found = rows.mapInArrow(chosen, "lang string, draw long, text string, size long").groupBy("lang", "draw").agg(
        F.min("text").alias("text"), F.min("size").alias("size"))
    before = Window.partitionBy("lang").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return found.where(F.col("_before") < sample_bytes).select("lang", "text")


def fit(labelled: DataFrame, text: str, lang: Column, *, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model of the languages of the labelled texts, or None if there are none."""
    rows = labelled.select(F.col(text).alias("text"), lang.alias("lang")).where("text is not null and lang is not null")
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not names:
        return None
    counts = materialise(count_lexicon(rows, "text", F.col("lang"), names))
    lexicon = lexicon_marks(counts, len(names))
    sample = sorted((r.text, r.lang) for r in draw_sample(rows, sample_bytes).toLocalIterator())
    place = {name: i for i, name in enumerate(names)}
    langs = np.array([place[name] for _, name in sample], np.int64)
    missing = {r.lang for r in counts.select("lang").distinct().collect()} - set(langs.tolist())
    if missing:
        raise RuntimeError(f"no sample of {sorted(names[i] for i in missing)}, which have labelled words")
    words, label = mixed_chains([t for t, _ in sample], langs)
    if not len(label):
        zeros = np.zeros((1 << FEATURE_BITS, len(names)), np.float32)
        return Model(names, lexicon, zeros, np.zeros((len(names), len(names))))
    return Model(names, lexicon, *fit_weights(words, label, len(names), lexicon))


_RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def add_language(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    if model is None:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def label(texts: pa.Array) -> pa.Array:
        names, score = shared.value.label(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang_pred", "score"])

    found = df.withColumn("_language", label.asNondeterministic()(F.col(text)))
    return found.withColumns({"lang_pred": F.col("_language.lang_pred"), "score": F.col("_language.score")}).drop("_language")
