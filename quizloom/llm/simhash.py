"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has a bit for each of 64 places, set if more than half of the document's shingle
hashes (XXH64, seed 42) have it set. It is cut into segments; a table holds every distinct
fingerprint under each of its segment values. Two fingerprints within ``max_distance`` bits
differ by at most ``max_distance // segments`` bits in one segment, so the small Hamming ball
around a segment value names the table buckets to fetch; whole distances are then verified.

Exact copies are one fingerprint and never meet as pairs. A bucket of more than ``hot_bucket``
fingerprints (many variants of one text that agree in a segment) is not fetched, as its pairs
would grow with the square of its size. Its fingerprints, and all that ask for it, are listed
under every value within half of ``max_distance`` instead: two fingerprints are within
``max_distance`` exactly if they share such a value, and one value has at most as many
fingerprints as its ball. So no link is lost, and the result is the same for every
``hot_bucket``.

Defined results: A-Z are lower-cased; words are split at ASCII white space; a text of fewer words
than a shingle is one shingle; null, empty and blank texts have fingerprint zero and are linked
like any other. ``component_id`` is the smallest id that can be reached; null ids do not count,
and a component with null ids only has a null ``component_id``. Repeated rows keep their number.
An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quizloom.llm.components import connected_components
from quizloom.llm.tables import pack, unpacked
from quizloom.runtime import materialise

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
SEGMENTS = 2
HOT_BUCKET = 64
_SLICE = 1 << 16


def shingle_hashes(text: bytes, words_each: int = SHINGLE_WORDS) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= words_each:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    ends = list(accumulate(len(word) + 1 for word in words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = [0, *ends]
    return [digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[words_each - 1:])]


def majority_bits(hashes: list[int]) -> int:
    """The 64-bit fingerprint; zero for no hashes."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), _SLICE):
        part = np.array(hashes[start:start + _SLICE], np.uint64).astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    packed = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int.from_bytes(packed.tobytes(), "little")


@F.pandas_udf(LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    found = [majority_bits(shingle_hashes(t)) if t else 0 for t in texts]
    return pd.Series(np.array(found, np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a long."""
    return _fingerprint(text.cast("binary"))


def fingerprint_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), BITS // 4, "0"))


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` among ``bits`` bits, as signed longs."""
    masks = [
        sum(1 << bit for bit in chosen)
        for size in range(radius + 1) for chosen in combinations(range(bits), size)
    ]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def segment_values(value: Column, segments: int) -> Column:
    width = BITS // segments
    return F.array(*[
        F.struct(
            F.lit(i).alias("segment"),
            F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("part"),
        )
        for i in range(segments)
    ])


def similar_fingerprints(
    fingerprints: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS,
    hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """Links (a, b) that connect all distinct values of column ``fp`` within ``max_distance``
    bits: verified pairs, and for hot buckets verified links to a common neighbour's smallest."""
    if max_distance % 2 or segments < 2 or BITS % segments:
        raise ValueError("max_distance has to be even, and segments a power of two above one")
    table = fingerprints.select("fp", F.explode(segment_values(F.col("fp"), segments)).alias("_s"))
    table = table.select("fp", "_s.segment", "_s.part")
    masks = _longs(ball(BITS // segments, max_distance // segments))
    # Of two segment values the smaller one asks for the larger.
    asked = table.select(
        "fp", "segment", "part",
        F.explode(F.transform(masks, lambda m: F.col("part").bitwiseXOR(m))).alias("_ask"),
    ).where(F.col("_ask") >= F.col("part")).select("fp", "segment", F.col("_ask").alias("part"))

    sizes = table.groupBy("segment", "part").agg(F.count(F.lit(1)).alias("_n"))
    hot = materialise(sizes.where(F.col("_n") > hot_bucket).select("segment", "part"))
    fetched = (
        asked.withColumnRenamed("fp", "a")
        .join(table.join(hot, ["segment", "part"], "left_anti").withColumnRenamed("fp", "b"),
              ["segment", "part"])
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b")
    )
    crowded = asked.join(hot, ["segment", "part"], "left_semi").select("fp").distinct()
    near = _longs(ball(BITS, max_distance // 2))
    shared = (
        crowded.select("fp", F.explode(F.transform(near, lambda m: F.col("fp").bitwiseXOR(m))).alias("_v"))
        .groupBy("_v").agg(F.collect_set("fp").alias("_all")).where(F.size("_all") > 1)
    )
    met = shared.select(F.array_min("_all").alias("a"), F.explode("_all").alias("b")).where("a < b")
    return fetched.unionByName(met)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Per row: the id, ``fp`` (the fingerprint as a long), ``text_hash`` and ``component_id``."""
    rows = materialise(df.select(
        F.col(id_col), fingerprint(F.col(text_col)).alias("fp"),
        F.xxhash64(text_col).alias("text_hash"),
    ))
    distinct = materialise(rows.groupBy("fp").agg(F.min(id_col).alias("_least")))
    roots = connected_components(similar_fingerprints(distinct.select("fp"), **options))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("_root")
    )
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = rooted.join(least, "_root").select("fp", F.col("_root").alias("component"), "component_id")
    return rows.join(classes, "fp")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay when one document of each component is kept: that with the
    smallest id (null ids last; then the smallest hash of the text)."""
    found = near_duplicates(df.select(id_col, text_col), id_col, text_col, **options)
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "text_hash")
    kept = found.groupBy("component").agg(F.min(order).alias("_kept")).select(
        F.col("_kept.id").alias("_id"), F.col("_kept.text_hash").alias("_hash")
    )
    hashed = pack(df, id_col, _text_hash=F.xxhash64(df[text_col]))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    chosen = hashed.join(kept, same, "left_semi")
    return chosen.dropDuplicates([id_col, "_text_hash"]).select(*unpacked(df.columns, id_col))
