"""Toxicity by class-conditional Kneser-Ney models.

Two language models are counted, one over toxic and one over ordinary texts, and their
log-likelihoods of a text are compared. Both discount counts and hand the discount down to an order
that both classes share:

- pairs of neighbouring words: what is taken from a pair goes back by the expectation of its second
  word, so a pair that says no more than its words weighs nothing;
- words: what is taken goes to the word's stem (its first bytes) in the class, by the word's share of
  it over both classes;
- stems: what is taken goes to the shared base, the number of different words that have the stem,
  over both classes.

A word or pair that occurs once in all is discounted whole (the discount of a singleton is 1), so it
has no row of its own and is judged by the order below. A stem that no class knows weighs
nothing.

A text's evidence are the differences of its log-likelihoods under the two models: that of its
words, their clearly toxic part (what is beyond ``margin`` for a word), and what toxic pairs add to
it, each by the length and by its square root. A logistic function of these, fitted on labelled
texts that were not counted, turns them into a score.

Counts cover all labelled texts but those kept for the fit. Every distinct word and pair is
counted, and what it says is a row of a written table that grows with the corpus; pairs that do
not raise their words' ratio by ``pair_margin`` are left out. The most frequent rows,
``hot_rows`` of words, of stems and of pairs at most, go to the tasks; what may be among the
others, by a filter of fixed size, is joined to the table. The bound changes no result. The fit
takes ``calibration_rows`` at most, chosen by a hash of the row.

Pairs that lower the ratio were tried and left out: as ordinary texts are many, they are mostly
pairs of neutral words, and the held-out area under the curve fell (0.971 for 0.982 on sf0.1).

Defined results: null and empty texts have no words and get the score of no evidence. Rows
without a label are not learnt from; repeated texts count as often as they occur. If a class has
no rows, every score is the share of toxic labels (0 without labels). An empty table gives an
empty result. Other columns pass through; columns called ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quizloom.llm.grams import Words, slices
from quizloom.llm.tables import column
from quizloom.runtime import materialise

STEM_BITS = 20  # the base has room for 2 ** STEM_BITS stems, or for more if there are
STEM_BYTES = 4
DISCOUNT = 0.75
MARGIN = 2.0
HOT_ROWS = 1 << 20
CALIBRATION_PARTS = 4
CALIBRATION_ROWS = 20_000
BROADCAST_ROWS = 100_000
PAIR_MARGIN = 2.0
SLICE = 1 << 20  # characters that are taken together
_PAIR_STEPS = 64  # a ratio is taken to one part in so many where pairs are compared with words
COUNT_SCHEMA = "hash long, stem long, toxic long, ordinary long"


def _word_counts(texts: list[str], toxic: np.ndarray) -> pa.RecordBatch:
    """Distinct words of some texts with their counts in both classes."""
    words = Words.of(texts)
    hashes = words.hashes()
    own = np.repeat(toxic, words.counts)
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    stems = words.hashes(STEM_BYTES)[first]
    both = np.bincount(number, minlength=len(distinct))
    bad = np.bincount(number[own], minlength=len(distinct))
    return pa.RecordBatch.from_arrays([
        pa.array(distinct.view(np.int64)), pa.array(stems.view(np.int64)), pa.array(bad), pa.array(both - bad),
    ], names=["hash", "stem", "toxic", "ordinary"])


def count_words(labelled: DataFrame, text: str, label: Column) -> DataFrame:
    """Every distinct word with its stem and its counts in both classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False)
            for owners, parts in slices((t.as_py() or "" for t in batch["text"]), SLICE):
                yield _word_counts(parts, toxic[owners])

    rows = labelled.select(F.col(text).alias("text"), label.cast("boolean").alias("toxic"))
    partial = rows.mapInArrow(count, COUNT_SCHEMA)
    return partial.groupBy("hash", "stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _pair_hashes(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and the one behind it in the same text, and the place of the second."""
    at = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    mixed = (hashes[at - 1] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = ((mixed ^ (mixed >> np.uint64(29))) + hashes[at]) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32)), at


_PAIR_SCHEMA = "hash long, second long, base int, toxic int, ordinary int"


def count_pairs(labelled: DataFrame, text: str, label: Column, shared: Broadcast, words: DataFrame) -> DataFrame:
    """(hash, n, toxic, ordinary, ratio) of every pair that occurs more than once, with the ratio of its
    second word. That word occurs more than once as well, so it is held or has a row in ``words``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False)
            for owners, parts in slices((t.as_py() or "" for t in batch["text"]), SLICE):
                found = Words.of(parts)
                known = shared.value.find(found)
                owner = np.repeat(np.arange(len(parts)), found.counts)
                hashes, at = _pair_hashes(known.hashes[known.number], owner)
                distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
                second = known.number[at[first]]
                both = np.bincount(number, minlength=len(distinct))
                bad = np.bincount(number[np.asarray(toxic[owners], bool)[owner[at]]], minlength=len(distinct))
                open_ = known.open[second]
                yield pa.RecordBatch.from_arrays([
                    pa.array(distinct.view(np.int64)), pa.array(known.hashes[second].view(np.int64), mask=~open_),
                    pa.array(np.rint(known.ratio[second] * _PAIR_STEPS).astype(np.int32), mask=open_),
                    pa.array(bad.astype(np.int32)), pa.array((both - bad).astype(np.int32)),
                ], names=["hash", "second", "base", "toxic", "ordinary"])

    rows = labelled.select(F.col(text).alias("text"), label.cast("boolean").alias("toxic"))
    pairs = rows.mapInArrow(count, _PAIR_SCHEMA).groupBy("hash").agg(
        F.max("second").alias("second"), F.max("base").alias("base"), F.sum("toxic").alias("toxic"),
        F.sum("ordinary").alias("ordinary"), (F.sum("toxic") + F.sum("ordinary")).alias("n")).where(F.col("n") > 1)
    if not shared.value.whole:
        held = F.rint(F.col("ratio") * _PAIR_STEPS).cast("int").alias("_held")
        pairs = pairs.join(words.select(F.col("hash").alias("second"), held), "second", "left")
        pairs = pairs.withColumn("base", F.coalesce("base", "_held", F.lit(0)))
    return pairs.select("hash", "n", "toxic", "ordinary", (F.col("base") / _PAIR_STEPS).alias("ratio"))


@dataclass
class Ratios:
    """Log of toxic over ordinary probability: (hash, n, ratio) of every counted word, (stem, n,
    ratio) of words not counted that have the stem, and of words whose stem was not counted."""

    words: DataFrame
    stems: DataFrame
    default: float
    toxic: int
    ordinary: int

    def of_pairs(self, pairs: DataFrame, margin: float) -> DataFrame:
        """(hash, n, ratio): what pairs add to the ratio of their second word. A pair's discount, once
        for each class that has it, goes back to the classes by that word's odds."""
        odds = F.exp("ratio") * (self.toxic / self.ordinary)
        back = DISCOUNT * (F.col("toxic") > 0).cast("int") + DISCOUNT * (F.col("ordinary") > 0).cast("int")
        toxic = F.greatest(F.col("toxic") - DISCOUNT, F.lit(0.0)) + back * odds / (1 + odds)
        ordinary = F.greatest(F.col("ordinary") - DISCOUNT, F.lit(0.0)) + back / (1 + odds)
        added = F.log(toxic / self.toxic) - F.log(ordinary / self.ordinary) - F.col("ratio")
        found = pairs.select("hash", "n", added.cast("float").alias("ratio"))
        return materialise(found.where(F.col("ratio") >= margin))

    @classmethod
    def of(cls, words: DataFrame) -> Ratios | None:
        """None if a class has no words."""
        sums = [F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")]
        seen = [F.count_if(F.col(c) > 0).alias(f"{c}_types") for c in ("toxic", "ordinary")]
        single = F.col("toxic") + F.col("ordinary") == 1
        alone = [F.sum(F.when(single, F.col(c)).otherwise(0)).alias(f"{c}_alone") for c in ("toxic", "ordinary")]
        totals = words.agg(*sums, *seen, *alone).first()
        if not totals.toxic or not totals.ordinary:
            return None
        stems = words.groupBy("stem").agg(*sums, F.count(F.lit(1)).alias("n"))
        kinds = stems.agg(*seen, F.count(F.lit(1)).alias("stems"), F.sum("n").alias("types")).first()
        base = (F.col("n") + 0.5) / (kinds.types + 0.5 * max(1 << STEM_BITS, kinds.stems))
        left, reserve = {}, {}
        for c in ("toxic", "ordinary"):
            taken = DISCOUNT * totals[f"{c}_types"] + (1 - DISCOUNT) * totals[f"{c}_alone"]
            left[c] = taken / totals[c]
            reserve[c] = DISCOUNT * kinds[f"{c}_types"] / totals[c]

        def discounted(column: str, c: str) -> Column:
            return F.greatest(F.col(column) - DISCOUNT, F.lit(0.0)) / totals[c]

        def ratio(toxic: Column, ordinary: Column) -> Column:
            return (F.log(toxic) - F.log(ordinary)).cast("float").alias("ratio")

        shares = {c: (discounted(c, c) + reserve[c] * base).alias(f"p_{c}") for c in left}
        stems = materialise(stems.select(
            "stem", "n", (F.col("toxic") + F.col("ordinary")).alias("pooled"), *shares.values()))
        pooled = F.col("toxic") + F.col("ordinary")
        share = (pooled + 0.5) / (F.col("pooled") + 0.5)
        known = words.where(~single).join(stems.drop("n"), "stem").select("hash", pooled.alias("n"), ratio(*[
            discounted(c, c) + left[c] * F.col(f"p_{c}") * share for c in left
        ]))
        unseen = stems.select("stem", "n", ratio(*[left[c] * F.col(f"p_{c}") for c in left]))
        default = np.log(left["toxic"] * reserve["toxic"]) - np.log(left["ordinary"] * reserve["ordinary"])
        return cls(materialise(known), unseen, float(np.float32(default)), totals.toxic, totals.ordinary)


_LEVELS = 8  # of frequency, for each power of two


def _hot(rows: DataFrame, key: str, most: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Keys, ascending, and ratios of the rows with the largest n, ``most`` at most, and the rest
    of the rows, None if there are none."""
    level = F.floor(F.log2("n") * _LEVELS)
    sizes = sorted(rows.groupBy(level.alias("level")).count().collect(), reverse=True)
    least, taken = None, 0
    for row in sizes:
        if taken + row["count"] > most:
            break
        least, taken = row.level, taken + row["count"]
    whole = taken == sum(row["count"] for row in sizes)
    got = rows.where(F.lit(least is not None) & (level >= F.lit(least))).select(key, "ratio").toArrow()
    keys = got[key].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["ratio"].to_numpy()[order], None if whole else (
        rows if least is None else rows.where(level < least))


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each key asked for, NaN if there is none."""
    if not len(keys):
        return np.full(len(asked), np.nan)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at].astype(float), np.nan)


_PAGE = 1 << 16  # bits
MOST_PAGES = 2048
_PER_KEY = 12


class Filter:
    """A Bloom filter of fixed size at most: a key's three bits lie in one page."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, rows: DataFrame, key: str) -> Filter:
        count = rows.count()
        pages = min(MOST_PAGES, 1 << max(0, (count * _PER_KEY // _PAGE)).bit_length())

        def page(table: pa.Table) -> pa.Table:
            bits = np.zeros(_PAGE, bool)
            for place in cls._places(table["key"].to_numpy().astype(np.int64).view(np.uint64)):
                bits[place] = True
            return pa.table({"page": table["page"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        number = F.pmod(F.shiftrightunsigned(F.col(key), 40), F.lit(pages)).cast("int")
        made = rows.select(number.alias("page"), F.col(key).alias("key")).groupBy("page")
        bits = np.zeros((pages, _PAGE // 8), np.uint8)
        for row in made.applyInArrow(page, "page int, bits binary").collect():
            bits[row.page] = np.frombuffer(row.bits, np.uint8)
        return cls(bits)

    @staticmethod
    def _places(keys: np.ndarray) -> list[np.ndarray]:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        return [((mixed >> np.uint64(shift)) & np.uint64(_PAGE - 1)).astype(np.int64) for shift in (48, 32, 16)]

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        page = ((keys >> np.uint64(40)) % np.uint64(len(self.bits))).astype(np.int64)
        found = np.ones(len(keys), bool)
        for place in self._places(keys):
            found &= (self.bits[page, place >> 3] >> (7 - (place & 7))) & 1 == 1
        return found


@dataclass
class Found:
    """Distinct words of some texts: what is known of them and of their stems (else NaN), and
    which words' ratios are ``open``, as they may be in the tables' rest. ``number`` is the
    distinct word of each word."""

    hashes: np.ndarray
    stems: np.ndarray
    number: np.ndarray
    ratio: np.ndarray
    backoff: np.ndarray
    open: np.ndarray


@dataclass
class Model:
    """The part of the ratios that goes to the tasks. A filter is None where all rows are held."""

    words: np.ndarray
    word_ratios: np.ndarray
    word_filter: Filter | None
    stems: np.ndarray
    stem_ratios: np.ndarray
    more_stems: bool
    default: float
    margin: float
    pairs: np.ndarray
    pair_ratios: np.ndarray
    pair_filter: Filter | None = None

    @property
    def whole(self) -> bool:
        return self.word_filter is None and self.pair_filter is None and not self.more_stems

    @classmethod
    def of(cls, words: DataFrame, margin: float) -> Model | None:
        """None if a class has no words."""
        ratios = Ratios.of(words)
        return None if ratios is None else cls.held(ratios, margin, HOT_ROWS)[0]

    @classmethod
    def held(cls, ratios: Ratios, margin: float, most: int) -> tuple[Model, DataFrame | None, DataFrame | None]:
        """Without pairs, and with the rows of words and stems that are not held."""
        words, word_ratios, more_words = _hot(ratios.words, "hash", most)
        stems, stem_ratios, more_stems = _hot(ratios.stems, "stem", most)
        model = cls(
            words, word_ratios, None if more_words is None else Filter.of(more_words, "hash"), stems, stem_ratios,
            more_stems is not None, ratios.default, margin, np.zeros(0, np.uint64), np.zeros(0, np.float32))
        return model, more_words, more_stems

    def with_pairs(self, pairs: DataFrame, most: int) -> tuple[Model, DataFrame | None]:
        keys, ratios, more = _hot(pairs, "hash", most)
        chosen = None if more is None else Filter.of(more, "hash")
        return replace(self, pairs=keys, pair_ratios=ratios, pair_filter=chosen), more

    def find(self, words: Words) -> Found:
        hashes, first, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
        stems = words.hashes(STEM_BYTES)[first]
        known, backoff = _find(self.words, self.word_ratios, hashes), _find(self.stems, self.stem_ratios, stems)
        ratio = np.where(np.isnan(known), np.where(np.isnan(backoff), self.default, backoff), known)
        open_ = np.zeros(len(hashes), bool)
        if self.word_filter is not None:
            open_ |= self.word_filter.may_hold(hashes)
        if self.more_stems:
            open_ |= np.isnan(backoff)
        return Found(hashes, stems, number, ratio, backoff, open_ & np.isnan(known))

    def ratios(self, words: Words) -> np.ndarray:
        """Log of toxic over ordinary probability, by word, as far as it is held here."""
        found = self.find(words)
        return found.ratio[found.number]

    def find_pairs(self, found: Found, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs: hash, owner, what it adds as far as it is held, and whether it is open."""
        hashes, at = _pair_hashes(found.hashes[found.number], owner)
        added = _find(self.pairs, self.pair_ratios, hashes)
        unknown = np.isnan(added)
        open_ = unknown & self.pair_filter.may_hold(hashes) if self.pair_filter is not None else np.zeros(len(at), bool)
        return hashes, owner[at], np.where(unknown, 0.0, added), open_

    def sums(self, texts: list[str]) -> np.ndarray:
        """Numbers of a text: words; whole and clearly toxic difference of words that are not open,
        and open words; what pairs add that are not open, and open pairs."""
        sums = np.zeros((6, len(texts)))
        for owners, parts in slices(texts, SLICE):
            words = Words.of(parts)
            found, owner = self.find(words), np.repeat(owners, words.counts)
            ratio, shut = found.ratio, ~found.open
            values = [None, ratio * shut, np.maximum(ratio - self.margin, 0) * shut, found.open * 1.0]
            for row, value in zip(sums, values):
                row += np.bincount(owner, value if value is None else value[found.number], minlength=len(texts))
            # A cut text goes on in another part, so pairs are told apart by part.
            part = np.repeat(np.arange(len(parts)), words.counts)
            _, of, added, open_ = self.find_pairs(found, part)
            of = np.asarray(owners, np.int64)[of]
            for row, value in zip(sums[4:], (added, open_ * 1.0)):
                row += np.bincount(of, value, minlength=len(texts))
        return sums


@dataclass
class Scorer:
    """The held ratios, sent to the tasks once for fitting and scoring, the rows that are not
    held, and the fitted weights."""

    shared: Broadcast
    more_words: DataFrame | None
    more_stems: DataFrame | None
    more_pairs: DataFrame | None = None
    weights: np.ndarray | None = None


_SUMS = StructType([
    StructField(c, DoubleType()) for c in ("words", "ratio", "clear", "open", "pair", "pair_open")])
_OPEN_SCHEMA = "a long, b long, pair boolean, hash long, stem long, backoff float, n int"
_EVIDENCE = tuple(f"_{c}_by_{x}" for c in ("ratio", "clear", "pair") for x in ("length", "root"))


def _text_keys(text: str) -> dict[str, Column]:
    """128 bits of a text's hashes."""
    return {"_a": F.xxhash64(text), "_b": F.xxhash64(F.lit("b"), text)}


def _open_rows(a, b, row, pair: bool, hashes, stems=None, backoff=None) -> pa.RecordBatch:
    """One row per text and word or pair with the number of its occurrences."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (hashes[1:] != hashes[:-1])]))
    n = np.diff([*first, len(row)]).astype(np.int32)
    chosen = order[first]
    none = pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.float32())
    known = none if stems is None else (
        pa.array(stems[chosen].view(np.int64), mask=~np.isnan(backoff[chosen])),
        pa.array(backoff[chosen].astype(np.float32), mask=np.isnan(backoff[chosen])))
    return pa.RecordBatch.from_arrays([
        pa.array(a[row[first]]), pa.array(b[row[first]]), pa.array(np.full(len(first), pair)),
        pa.array(hashes[first].view(np.int64)), *known, pa.array(n),
    ], names=["a", "b", "pair", "hash", "stem", "backoff", "n"])


def open_means(df: DataFrame, scorer: Scorer, text: str) -> DataFrame:
    """By text (_a, _b): mean difference and mean clearly toxic difference of its open words, and what its
    open pairs add in the mean. A mean is the same however often the text occurs."""
    shared, model = scorer.shared, scorer.shared.value

    def left_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            for owners, parts in slices((t.as_py() or "" for t in batch["text"]), SLICE):
                words = Words.of(parts)
                found = shared.value.find(words)
                part = np.repeat(np.arange(len(parts)), words.counts)
                owners = np.asarray(owners, np.int64)
                at = np.flatnonzero(found.open[found.number])
                if len(at):
                    word = found.number[at]
                    yield _open_rows(
                        a, b, owners[part[at]], False, found.hashes[word], found.stems[word], found.backoff[word])
                hashes, of, _, open_ = shared.value.find_pairs(found, part)
                if open_.any():
                    yield _open_rows(a, b, owners[of[open_]], True, hashes[open_])

    keys = _text_keys(text)
    rows = df.select(keys["_a"].alias("a"), keys["_b"].alias("b"), F.col(text).alias("text"))
    found = rows.mapInArrow(left_open, _OPEN_SCHEMA)
    tables = [
        more.select("hash", F.lit(pair).alias("pair"), F.col("ratio").alias("_own"))
        for pair, more in ((False, scorer.more_words), (True, scorer.more_pairs)) if more is not None
    ]
    ratio = [F.when(F.col("pair"), F.lit(0.0)), F.col("backoff"), F.lit(model.default)]
    if tables:
        table = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
        found = found.join(table, ["hash", "pair"], "left")
        ratio.insert(0, F.col("_own"))
    if scorer.more_stems is not None:
        # Rows that have a back-off need no stem, and are dealt out by their hash.
        found = found.withColumn("_stem", F.coalesce("stem", "hash"))
        found = found.join(
            scorer.more_stems.select(F.col("stem").alias("_stem"), F.col("ratio").alias("_other")), "_stem", "left")
        ratio.insert(-1, F.col("_other"))
    own = F.coalesce(*ratio).cast("double")
    clear = F.greatest(own - model.margin, F.lit(0.0))

    def mean(value: Column, pair: bool) -> Column:
        mine = F.col("pair") == pair
        return F.sum(F.when(mine, value * F.col("n"))) / F.sum(F.when(mine, F.col("n")))

    return found.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(
        mean(own, False).alias("_mean"), mean(clear, False).alias("_clear_mean"), mean(own, True).alias("_pair_mean"))


def add_evidence(df: DataFrame, scorer: Scorer, text: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds six numbers: whole and clearly toxic difference of words and what pairs add, by length and
    by its root. Up to ``broadcast_rows`` texts' means (five numbers each) go to the tasks; more
    are joined by a shuffle."""
    shared = scorer.shared

    @F.arrow_udf(_SUMS)
    def sums(texts: pa.Array) -> pa.Array:
        found = shared.value.sums([t.as_py() or "" for t in texts])
        return pa.StructArray.from_arrays([pa.array(row) for row in found], _SUMS.names)

    values = [F.col(f"_sums.{c}") for c in ("ratio", "clear", "pair")]
    out = df
    if not shared.value.whole:
        means = materialise(open_means(df, scorer, text))
        if means.count() <= broadcast_rows:
            means = F.broadcast(means)
        out = df.withColumns(_text_keys(text)).withColumn("_sums", sums.asNondeterministic()(F.col(text)))
        out = out.join(means, ["_a", "_b"], "left").drop("_a", "_b")
        for i, (number, mean) in enumerate((("open", "_mean"), ("open", "_clear_mean"), ("pair_open", "_pair_mean"))):
            values[i] += F.col(f"_sums.{number}") * F.coalesce(mean, F.lit(0.0))
    else:
        out = out.withColumn("_sums", sums.asNondeterministic()(F.col(text)))
    length = F.greatest("_sums.words", F.lit(1.0))
    evidence = [value / by for value in values for by in (length, F.sqrt(length))]
    return out.withColumns(dict(zip(_EVIDENCE, evidence))).drop("_sums", "_mean", "_clear_mean", "_pair_mean")


def fit_logistic(evidence: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept by Newton steps on standardised columns."""
    mean, spread = evidence.mean(axis=0), evidence.std(axis=0) + 1e-9
    x = np.c_[(evidence - mean) / spread, np.ones(len(evidence))]
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
        slope = x.T @ (p - toxic) + ridge * weights
        bend = (x.T * (p * (1 - p))) @ x + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    scaled = weights[:-1] / spread
    return np.append(scaled, weights[-1] - scaled @ mean)


def _calibrate(scorer: Scorer, kept: DataFrame, text: str, label: Column, rows: int) -> np.ndarray:
    """Fits on about ``rows`` texts at most, chosen by a hash of text and place; five numbers of
    each come to the driver."""
    count = kept.count()
    chosen = kept.withColumn("_toxic", label.cast("boolean"))
    if count > rows:
        # Nine tenths, so that an uneven draw stays within the bound. The other columns tell copies apart.
        share = int(0.9 * rows / count * 1_000_000_000)
        draw = F.xxhash64(F.lit("fit"), *[column(kept, c) for c in kept.columns])
        chosen = chosen.where(F.pmod(draw, F.lit(1_000_000_000)) < share)
    chosen = chosen.select(F.col(text).alias("text"), F.col("_toxic").cast("double").alias("toxic"))
    if not scorer.shared.value.whole:
        chosen = materialise(chosen)  # read twice
    got = add_evidence(chosen, scorer, "text").select(*_EVIDENCE, "toxic").toPandas().to_numpy()
    if len(got) and 0 < got[:, -1].sum() < len(got):
        return fit_logistic(got[:, :-1], got[:, -1])
    # Without both classes to fit on, the difference by the root of the length decides.
    return np.array([0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0])


def fit(
    labelled: DataFrame, text: str, label: Column, *, margin: float = MARGIN, pair_margin: float = PAIR_MARGIN,
    calibration_rows: int = CALIBRATION_ROWS, hot_rows: int = HOT_ROWS,
) -> Scorer | float:
    """A scorer, or the constant score if a class is missing. ``label`` is null where unknown."""
    known = labelled.where(label.isNotNull())
    kept = F.pmod(F.xxhash64(text), F.lit(CALIBRATION_PARTS)) == 0
    learnt = known.where(~kept)
    ratios = Ratios.of(materialise(count_words(learnt, text, label)))
    if ratios is None:
        return float(known.agg(F.avg(label.cast("double"))).first()[0] or 0.0)
    context = labelled.sparkSession.sparkContext
    model, *more = Model.held(ratios, margin, hot_rows)
    words_only = context.broadcast(model)
    pairs = ratios.of_pairs(count_pairs(learnt, text, label, words_only, ratios.words), pair_margin)
    model, more_pairs = model.with_pairs(pairs, hot_rows)
    scorer = Scorer(context.broadcast(model), *more, more_pairs)
    scorer.weights = _calibrate(scorer, known.where(kept), text, label, calibration_rows)
    return scorer


def add_score(
    df: DataFrame, scorer: Scorer | float, text: str = "text", out: str = "score",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Adds the score, 0 to 1."""
    if isinstance(scorer, float):
        return df.withColumn(out, F.lit(scorer))
    raw = F.lit(float(scorer.weights[-1]))
    for name, weight in zip(_EVIDENCE, scorer.weights.tolist()):
        raw += F.col(name) * weight
    bounded = F.greatest(F.least(raw, F.lit(500.0)), F.lit(-500.0))
    found = add_evidence(df, scorer, text, broadcast_rows)
    return found.withColumn(out, 1 / (1 + F.exp(-bounded))).drop(*_EVIDENCE)


def label_rows(
    df: DataFrame, labels: DataFrame, key: str, label: str, out: str, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """The rows of ``df`` that have a label, with it. Of several labels the largest counts.

    Up to ``broadcast_rows`` labels (two numbers each) go to the tasks; more are joined by a
    shuffle. The result is the same.
    """
    slim = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias(out))
    slim = materialise(slim)
    if slim.count() <= broadcast_rows:
        slim = F.broadcast(slim)
    return df.drop(out).join(slim, df[key] == slim["_key"]).drop("_key")
