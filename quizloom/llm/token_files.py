"""Token ids as raw binary shards with a keyed index.

A shard is two files. ``<name>.ids`` holds nothing but the ids of its documents, end to end, as
little-endian unsigned integers of 16 or 32 bits. ``<name>.idx`` holds, behind a header that
lists its arrays, the key and offset of every row, and a minimal perfect hash of the keys: a key
is hashed level by level into bit arrays, belongs to the first level where its bit is set, and
the number of set bits before that one is its slot. The slot stores a fingerprint of the key,
which tells unknown keys (all but one in 2^32), and the key's rows. So one key costs a constant number of
reads, whatever the number of documents.

Rows are range-partitioned and sorted by key (nulls first, then by a hash of the text), so the
shards in order of (part, number) hold the documents in key order. Shards have a fresh name per
task attempt, and only those of the written manifest count.

Defined results: a null or empty text has the end id alone. Null keys are stored and read back,
but have no slot. Repeated keys are neighbours under one slot. An empty table has no shards.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quizloom.llm.chunks import gather
from quizloom.llm.parts import ChunkTable, ids_of_column
from quizloom.llm.tables import cut_batch, one_per_task

MANIFEST_SCHEMA = (
    "shard string, part int, number int, docs long, ids long, width int, first_key long, last_key long"
)
TABLE_CHUNKS = 1 << 19
TABLE_CHARS = 32 << 20
BATCH_BYTES = 8 << 20
SHARD_BYTES = 512 << 20
READ_BYTES = 8 << 20
_GAMMA = 2
_LEVELS = 32

# ---------------------------------------------------------------- tokenizer

# What a file has to state for its texts to be cut at blanks. White space is dropped
# and no token crosses it; letters are lower-cased, and runs of signs are tokens of their own.
_NORMALISER = [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# A run of full stops or commas behind a letter or digit and before a blank is a match of its own.
_TAIL = re.compile(r"(?<=[^\W_])[.,]+$")
_JOINED = 64


class WordTokenizer:
    """The tokenizers library over chunks between blanks, which no token crosses; each distinct
    chunk is encoded once while the table holds it. Texts of a file that normalises or splits in
    another way are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.by_blanks = self._parts_at_blanks(json.load(file))
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self._ends = np.zeros(self.size, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._table = ChunkTable(self._learn, TABLE_CHUNKS, TABLE_CHARS)

    @staticmethod
    def _parts_at_blanks(read: dict) -> bool:
        normaliser, split = read["normalizer"] or {}, read["pre_tokenizer"] or {}
        steps, first = normaliser.get("normalizers"), (split.get("pretokenizers") or [{}])[0]
        return (
            steps == _NORMALISER and first.get("pattern") == {"Regex": _SPLIT}
            and read["model"].get("end_of_word_suffix") == "</w>" and not read["model"].get("dropout")
            and not any(" " in t["content"] or t["normalized"] or t["lstrip"] or t["rstrip"] for t in read["added_tokens"])
        )

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Words of letters are encoded many to a text and cut at the ids that end a word."""
        found = []
        groups = [words[i:i + _JOINED] for i in range(0, len(words), _JOINED)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups])):
            ends = (np.flatnonzero(self._ends[np.array(ids, np.int64)]) + 1).tolist()
            if len(ends) == len(group):
                found += [ids[s:e] for s, e in zip([0, *ends], ends)]
            else:
                found += self._encode(group)
        return found

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [c for c in chunks if c.isascii() and c.isalpha()]
        found = dict(zip(words, self._encode_words(words)))
        heads, tails = {}, {}  # of chunks that are no words of plain letters
        for chunk in chunks:
            if chunk not in found:
                tail = _TAIL.search(chunk) if chunk[-1:] in (".", ",") else None
                cut = tail.start() if tail else len(chunk)
                heads[chunk], tails[chunk] = chunk[:cut], chunk[cut:]
        more, others = [], []
        for form in dict.fromkeys([*heads.values(), *tails.values()]):
            if form not in found:
                plain = form.isalpha() and max(form) < "ɐ" and unicodedata.is_normalized("NFC", form)
                (more if plain else others).append(form)
        found.update(zip(more, self._encode_words(more)))
        found.update(zip(others, self._encode(others)))
        ids = [found[heads[c]] + found[tails[c]] if c in heads else found[c] for c in chunks]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; null texts have none."""
        if self.by_blanks:
            # Fewer different parts: lower case where no mark may join a letter and no special token is
            # meant, and a blank before a run of full stops or commas that ends a part.
            other = pc.match_substring_regex(texts, r"\p{M}|<\|")
            low = pc.replace_substring(pc.if_else(other, texts, pc.ascii_lower(texts)), "\n", " ")
            return ids_of_column(pc.replace_substring_regex(low, r"([A-Za-z0-9])([.,]+)( |$)", r"\1 \2\3"), self._table)
        found = self._encode([t.as_py() or "" for t in texts])
        return np.array([i for one in found for i in one], np.int32), np.array(list(map(len, found)), np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[0]


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


# ---------------------------------------------------------------- minimal perfect hash


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash by two rounds of xor-shift and multiplication."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Numbers n distinct keys 0 to n-1. ``bits`` are all levels' bits, end to end; ``ends`` are
    the levels' ends; ``before`` counts the set bits before each."""

    def __init__(self, bits: np.ndarray, ends: np.ndarray, rest: np.ndarray):
        self.bits, self.ends, self.rest = bits, ends, rest
        self._before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < _LEVELS:
            size = _GAMMA * len(left) + 1
            place = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[place]]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        ends = np.cumsum([len(level) for level in levels], dtype=np.int64)
        return cls(bits, ends, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; an unknown key gets -1 or any slot."""
        found, open_, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, end in enumerate(self.ends.tolist()):
            place = (_mix(keys[open_], level) % np.uint64(end - start)).astype(np.int64) + start
            hit = self.bits[place]
            found[open_[hit]] = self._before[place[hit]]
            open_, start = open_[~hit], end
        if len(self.rest):  # keys that met others at every level
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            found[open_[hit]] = self._before[-1] + at[hit]
        return found


# ---------------------------------------------------------------- shard files


def _write_arrays(filesystem, path: str, arrays: dict[str, np.ndarray]) -> None:
    listed = [(name, a.dtype.str, len(a)) for name, a in arrays.items()]
    header = json.dumps(listed).encode()
    with filesystem.open_output_stream(path, compression=None) as out:
        out.write(len(header).to_bytes(8, "little") + header)
        for array in arrays.values():
            out.write(np.ascontiguousarray(array).tobytes())


def _read_arrays(filesystem, path: str) -> dict[str, np.ndarray]:
    with filesystem.open_input_file(path) as file:
        size = int.from_bytes(file.read_at(8, 0), "little")
        at, arrays = 8 + size, {}
        for name, kind, count in json.loads(file.read_at(size, 8)):
            dtype = np.dtype(kind)
            arrays[name] = np.frombuffer(file.read_at(count * dtype.itemsize, at), dtype)
            at += count * dtype.itemsize
    return arrays


class ShardWriter:
    def __init__(self, folder: str, width: int):
        self._fs, self._root = pafs.FileSystem.from_uri(folder)
        self._fs.create_dir(self._root, recursive=True)
        self.name, self.width, self.bytes = uuid.uuid4().hex, width, 0
        self._out = self._fs.open_output_stream(f"{self._root}/{self.name}.ids", compression=None)
        self._keys: list[int | None] = []
        self._sizes: list[int] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        data = ids.astype(f"<u{self.width}").tobytes()
        self._out.write(data)
        self._keys.append(key)
        self._sizes.append(len(ids))
        self.bytes += len(data)

    def close(self) -> dict:
        self._out.close()
        null = np.array([k is None for k in self._keys], bool)
        keys = np.array([0 if k is None else k for k in self._keys], np.int64)
        offsets = np.concatenate([[0], np.cumsum(self._sizes, dtype=np.int64)])
        rows = np.flatnonzero(~null)
        known, first, count = np.unique(keys[rows], return_index=True, return_counts=True)
        table = PerfectHash.build(known)
        slots = table.slots(known)
        by_slot = np.zeros((3, len(known)), np.int64)
        by_slot[:, slots] = key_fingerprint(known), rows[first] if len(rows) else first, count
        _write_arrays(self._fs, f"{self._root}/{self.name}.idx", {
            "keys": keys, "null": null, "offsets": offsets, "bits": table.bits, "ends": table.ends,
            "rest": table.rest, "fingerprints": by_slot[0].astype("<u4"), "rows": by_slot[1],
            "counts": by_slot[2],
        })
        return {
            "shard": self.name, "docs": len(keys), "ids": int(offsets[-1]), "width": self.width,
            "first_key": int(known[0]) if len(known) else None,
            "last_key": int(known[-1]) if len(known) else None,
        }


class ShardReader:
    """Rows of a shard by key, and their ids by place."""

    def __init__(self, folder: str, name: str, width: int):
        filesystem, root = pafs.FileSystem.from_uri(folder)
        self._index = _read_arrays(filesystem, f"{root}/{name}.idx")
        self._hash = PerfectHash(*(self._index[n] for n in ("bits", "ends", "rest")))
        self._file = filesystem.open_input_file(f"{root}/{name}.ids")
        self._width = width
        self.keys, self.null, self.offsets = (self._index[n] for n in ("keys", "null", "offsets"))

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key, by its slot; none if the fingerprint differs."""
        slots = self._hash.slots(keys)
        known = slots >= 0
        known[known] = self._index["fingerprints"][slots[known]] == key_fingerprint(keys[known])
        safe = np.where(known, slots, 0)
        if not len(self._index["rows"]):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return self._index["rows"][safe], np.where(known, self._index["counts"][safe], 0)

    def places(self) -> np.ndarray:
        """The row of every document in the order of keys, from the slots."""
        at = np.arange(len(self.keys))
        known = np.flatnonzero(~self.null)
        own = self.keys[known]
        heads = np.flatnonzero(np.diff(own, prepend=own[:1] - 1))
        number = np.arange(len(own)) - np.repeat(heads, np.diff([*heads, len(own)]))
        first, count = self.rows(own)
        if (number >= count).any():
            raise ValueError("the index misses a key")
        at[known] = first + number
        return at

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of rows first to last, exclusive."""
        start, end = int(self.offsets[first]), int(self.offsets[last])
        data = self._file.read_at((end - start) * self._width, start * self._width)
        return np.frombuffer(data, f"<u{self._width}")

    def close(self) -> None:
        self._file.close()


# ---------------------------------------------------------------- jobs


def write_shards(
    df: DataFrame, folder: str, key: str, text: str, tokenizer_path: str, end_id: int,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encodes every text, appends ``end_id``, writes the shards below ``folder`` and returns the
    manifest rows. Write them as a table once, and read that."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("_place")]
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        width = 2 if max(tokenizer.size, end_id + 1) <= 1 << 16 else 4
        shard, done, part = None, [], TaskContext.get().partitionId()
        for batch in batches:
            for cut in cut_batch(batch, "text", BATCH_BYTES):
                ids, counts = tokenizer.encode_column(cut["text"])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                ends += np.arange(1, len(ends) + 1)
                for number, start, end in zip(cut["key"].to_pylist(), [0, *ends.tolist()], ends.tolist()):
                    shard = shard or ShardWriter(folder, width)
                    shard.add(number, ids[start:end])
                    if shard.bytes >= shard_bytes:
                        done.append(shard.close())
                        shard = None
        if shard:
            done.append(shard.close())
        listed = [one | {"part": part, "number": i} for i, one in enumerate(done)]
        schema = pa.schema([
            ("shard", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("docs", pa.int64()),
            ("ids", pa.int64()), ("width", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()),
        ])
        yield pa.RecordBatch.from_pylist(listed, schema)

    return placed.mapInArrow(write, MANIFEST_SCHEMA)


def with_start(manifest: DataFrame) -> DataFrame:
    """Adds ``start``, the ids before each shard. A row per shard."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the shards: key, start (ids before it in all shards), n_ids and the
    unsigned crc32 of its ids as 32-bit integers. A document's row is the first row in its key's
    slot and its number among the rows of the key; rows without a key are read as they stand."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                shard = ShardReader(folder, one["shard"], one["width"])
                at = shard.places()
                sizes = shard.offsets[at + 1] - shard.offsets[at]
                starts = one["start"] + shard.offsets[at]
                cut = (shard.offsets[at] * one["width"]) // READ_BYTES
                blocks = np.flatnonzero(np.diff(cut, prepend=-1)).tolist()
                for row, end in zip(blocks, [*blocks[1:], len(at)]):
                    ids, base = shard.ids(at[row], at[end - 1] + 1), shard.offsets[at[row]]
                    crc = [
                        zlib.crc32(ids[s - base:s - base + n].astype("<u4").tobytes())
                        for s, n in zip(shard.offsets[at[row:end]].tolist(), sizes[row:end].tolist())
                    ]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.keys[row:end], pa.int64(), mask=shard.null[row:end]),
                        pa.array(starts[row:end]), pa.array(sizes[row:end]), pa.array(crc, pa.int64()),
                    ], names=["key", "start", "n_ids", "ids_crc32"])
                shard.close()

    shards = with_start(manifest).select("shard", "width", "start")
    return one_per_task(shards, "shard").mapInArrow(read, "key long, start long, n_ids long, ids_crc32 long")


def lookup(wanted: DataFrame, manifest: DataFrame, folder: str, key: str = "key") -> DataFrame:
    """(key, ids) of the wanted keys. The shards' key ranges, a row per shard, go to the tasks."""
    ranges = manifest.where("first_key is not null").orderBy("part", "number").select(
        "shard", "width", "first_key", "last_key").toPandas()
    first, last = ranges["first_key"].to_numpy(np.int64), ranges["last_key"].to_numpy(np.int64)
    names, widths = ranges["shard"].tolist(), ranges["width"].tolist()

    @F.arrow_udf(ArrayType(IntegerType()))
    def shards_of(keys: pa.Array) -> pa.Array:
        own = keys.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(last, own, "left"), np.searchsorted(first, own, "right")
        return pa.array([list(range(a, b)) for a, b in zip(low.tolist(), high.tolist())], pa.list_(pa.int32()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            keys, found = [], []
            for own, to in zip(batch["key"].to_pylist(), batch["to"].to_pylist()):
                if to != number:
                    number, shard = to, ShardReader(folder, names[to], widths[to])
                row, count = (int(x[0]) for x in shard.rows(np.array([own], np.int64)))
                for i in range(row, row + count):
                    keys.append(own)
                    found.append(shard.ids(i, i + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["key", "ids"]
            )

    keys = wanted.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct()
    sent = keys.select("key", F.explode(shards_of("key")).alias("to")).repartition("to")
    return sent.sortWithinPartitions("to", "key").mapInArrow(read, "key long, ids array<int>")


def store(
    spark: SparkSession, df: DataFrame, folder: str, key: str, text: str, tokenizer_path: str,
    end_id: int, **options,
) -> DataFrame:
    """Writes shards and manifest below ``folder`` and returns the stored manifest."""
    write_shards(df, f"{folder}/shards", key, text, tokenizer_path, end_id, **options).write.parquet(
        f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")
