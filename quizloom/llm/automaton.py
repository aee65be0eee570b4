"""Byte-level BPE by a deterministic tokenization automaton, compiled from a tokenizer file.

**Automaton.** Its arcs are labelled with tokens, and it accepts one sequence of tokens for every
string: the one that the merges give. It starts as a single state with an arc for each byte. Every
merge (u, v) -> w then adds one gadget, in the order of the merges: the state that u leads to is
copied without its arc v, all arcs u are led to the copy, and beside every arc u an arc w is put
that leads where u and v led. All arcs of one label lead to the same state, so a state is named by
the token that leads to it. A copy shares its arcs with the state it was made from: a gadget is
kept as its time and its two tokens, and ``arc`` follows the gadgets back in time until one has
removed the arc or both sides are bytes. The compiled automaton so takes memory in proportion to
the merges and not to the arcs, of which there are billions. A merge whose second token cannot
follow its first adds nothing; its token is never used.

**Encoding.** A word is read byte by byte. A table of the tokens' prefixes, with links to the
longest prefix that is a suffix, gives from state and byte the next state and the longest token
that ends there; shorter ones are linked. Of these exactly one has an arc from the state that the
word had before that token, so a word is spelt by table steps, whatever the number of merges it
needs. Short words are read many at a time, long ones alone in plain lists.

**Decoding** emits the labels of the arcs, the bytes of the tokens.

Text is cut at special tokens of the file, then by the byte-level split pattern; parts between
blanks are looked up once a batch (see ``parts``), which changes no result.

Defined results: null and empty texts have no ids and decode to the empty text; a null list
decodes to the empty text too. Ids that are null or not in the file give nothing; bytes that are
no UTF-8 become U+FFFD. Texts are never shortened, whatever truncation the file states. A column
of the name of an output column is replaced. A file with a normaliser, another way of splitting,
dropout, unknown tokens or affixes is refused.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quizloom.llm.chunks import gather
from quizloom.llm.parts import ChunkTable, ids_of_column
from quizloom.llm.tables import column, cut_batch, for_arrow

# Fixed value: the split pattern of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
START = -1
NEVER = np.int64(1) << 40
SHORT_BYTES = 64
# Bytes that are read together, and text whose ids leave a task together.
CELLS = 1 << 19
BATCH_BYTES = 4 << 20
TABLE_CHUNKS = 1 << 19
TABLE_CHARS = 32 << 20


class IntTable:
    """Integers by non-negative 64-bit keys, -1 for unknown ones; an open hash table."""

    def __init__(self, items: dict[int, int]):
        bits = max(4, (2 * len(items)).bit_length())
        self._mask, self._shift = (1 << bits) - 1, np.uint64(64 - bits)
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        keys = np.fromiter(items.keys(), np.int64, len(items))
        values = np.fromiter(items.values(), np.int64, len(items))
        at = self._home(keys)
        while len(keys):
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= self._keys[at] < 0
            self._keys[at[first]], self._values[at[first]] = keys[first], values[first]
            keys, values, at = keys[~first], values[~first], (at[~first] + 1) & self._mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        there = self._keys[at]
        found = np.where(there == keys, self._values[at], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self._mask
            there = self._keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self._values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found


class Automaton:
    """``labels`` are the tokens' bytes by id, ``merges`` the ids (left, right, union) in order."""

    def __init__(self, labels: dict[int, bytes], merges: Iterable[tuple[int, int, int]]):
        self.size = max(labels, default=-1) + 1
        self._time, self._left, self._right = ([-1] * self.size for _ in range(3))
        self._gadgets: dict[int, int] = {}
        live = [i for i, label in labels.items() if len(label) == 1]
        used = set(live)
        for left, right, union in merges:
            if self._add_gadget(left, right, union) and left in used and right in used:
                used.add(union)
                live.append(union)
        self._arrays = tuple(np.array(a, np.int64) for a in (self._time, self._left, self._right))
        self._gadget = IntTable(self._gadgets)
        self._compile_reader({i: labels[i] for i in live})
        sizes = np.zeros(self.size + 1, np.int64)
        sizes[list(labels)] = [len(b) for b in labels.values()]
        self._label_sizes, self._label_starts = sizes, np.zeros(self.size + 1, np.int64)
        self._label_starts[list(labels)] = np.cumsum(sizes[list(labels)]) - sizes[list(labels)]
        self._label_pool = np.frombuffer(b"".join(labels.values()), np.uint8)

    def _add_gadget(self, left: int, right: int, union: int) -> bool:
        """False if no arc ``right`` leaves the state of ``left``: then there is nothing to add."""
        now = len(self._gadgets)
        has_arc = self.arc(left, right)
        self._gadgets[(left << 32) | right] = now
        self._time[union], self._left[union], self._right[union] = now, left, right
        return has_arc

    def arc(self, state: int, token: int) -> bool:
        """Whether an arc ``token`` leaves the state of the token ``state``.

        A gadget at time t leads its union where its right token led before t, and its union's
        arcs stand beside those of its left token as they are after the removal at t."""
        if state == START:
            return True
        time, gadgets, now = self._time, self._gadgets, NEVER
        while True:
            if gadgets.get((state << 32) | token, NEVER) < now:
                return False
            if time[token] >= time[state]:
                if time[token] < 0:
                    return True
                now, token = time[token] + 1, self._left[token]
            else:
                now, state = time[state], self._right[state]

    def arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """``arc`` of many pairs."""
        time, left, right = self._arrays
        found = np.ones(len(states), bool)
        open_ = np.flatnonzero(states != START)
        state, token, now = states[open_], tokens[open_], np.full(len(open_), NEVER)
        while len(open_):
            gadget = self._gadget((state << 32) | token)
            gone = (gadget >= 0) & (gadget < now)
            found[open_[gone]] = False
            of_token, of_state = time[token], time[state]
            stay = ~gone & ((of_token >= 0) | (of_state >= 0))
            open_, state, token = open_[stay], state[stay], token[stay]
            of_token, of_state = of_token[stay], of_state[stay]
            back = of_token >= of_state
            now = np.where(back, of_token + 1, of_state)
            state, token = np.where(back, state, right[state]), np.where(back, left[token], token)
        return found

    def _compile_reader(self, labels: dict[int, bytes]) -> None:
        """Tables from (prefix, byte) to the next prefix, to the longest proper suffix that is a
        prefix, to the longest token that ends in a prefix, and from a token to the next shorter."""
        steps: dict[int, int] = {}
        own, up, last = [-1], [0], [0]
        node_of = {}
        levels: list[list[int]] = [[0]]
        for token, label in labels.items():
            node = 0
            for depth, byte in enumerate(label, 1):
                child = steps.get(node << 8 | byte)
                if child is None:
                    child = steps[node << 8 | byte] = len(own)
                    own.append(-1)
                    up.append(node)
                    last.append(byte)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append(child)
                node = child
            own[node] = token
            node_of[token] = node
        link = [0] * len(own)
        longest = own[:]
        for level in levels[1:]:
            for node in level:
                at, byte = up[node], last[node]
                while at:
                    at = link[at]
                    there = steps.get(at << 8 | byte)
                    if there is not None:
                        link[node] = there
                        break
                if longest[node] < 0:
                    longest[node] = longest[link[node]]
        shorter, sizes = [-1] * self.size, [0] * self.size
        for token, node in node_of.items():
            shorter[token], sizes[token] = longest[link[node]], len(labels[token])
        self._steps, self._step = steps, IntTable(steps)
        self._lists = link, longest, shorter, sizes
        self._tables = tuple(np.array(a, np.int64) for a in self._lists)

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        link = self._tables[0]
        found = self._step(node << 8 | byte)
        open_ = np.flatnonzero((found < 0) & (node > 0))
        while len(open_):
            node[open_] = link[node[open_]]
            found[open_] = self._step(node[open_] << 8 | byte[open_])
            open_ = open_[(found[open_] < 0) & (node[open_] > 0)]
        return np.maximum(found, 0)

    def _spell_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in a row, and how many each has."""
        _, longest, shorter, sizes = self._tables
        lengths = np.array([len(w) for w in words], np.int64)
        n, width = len(words), int(lengths.max())
        inside = np.arange(width) < lengths[:, None]
        read = np.zeros((n, width), np.int64)
        read[inside] = np.frombuffer(b"".join(words), np.uint8)
        state = np.full((n, width + 1), START)  # by the bytes read
        node, rows = np.zeros(n, np.int64), np.arange(n)
        for place in range(1, width + 1):
            on = lengths[rows] >= place
            node, rows = node[on], rows[on]
            node = self._next(node, read[rows, place - 1])
            token, open_ = longest[node], np.arange(len(rows))
            while len(open_):
                own, row = token[open_], rows[open_]
                fits = self.arcs(state[row, place - sizes[own]], own)
                state[row[fits], place] = own[fits]
                open_ = open_[~fits]
                token[open_] = shorter[token[open_]]
        kept, at, rows = np.zeros((n, width + 1), bool), lengths.copy(), np.arange(n)
        while len(rows):
            kept[rows, at] = True
            at = at - sizes[state[rows, at]]
            on = at > 0
            rows, at = rows[on], at[on]
        return state[kept], kept.sum(axis=1)

    def _spell_one(self, word: bytes) -> list[int]:
        link, longest, shorter, sizes = self._lists
        steps, node, state = self._steps, 0, [START]
        arc = functools.lru_cache(1 << 16)(self.arc)
        for place, byte in enumerate(word, 1):
            step = steps.get(node << 8 | byte)
            while step is None and node:
                node = link[node]
                step = steps.get(node << 8 | byte)
            node = step or 0
            token = longest[node]
            while not arc(state[place - sizes[token]], token):
                token = shorter[token]
            state.append(token)
        found, place = [], len(word)
        while place:
            found.append(state[place])
            place -= sizes[state[place]]
        return found[::-1]

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in a row, and how many each has. Words are not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        pools, filled = [], 0
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        widths = np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        for bits in np.unique(widths).tolist():
            same = np.flatnonzero(widths == bits)
            many = (1 << bits) <= SHORT_BYTES
            step = max(1, CELLS >> bits) if many else 1
            for first in range(0, len(same), step):
                chosen = same[first:first + step]
                if many:
                    found, count = self._spell_many([words[i] for i in chosen.tolist()])
                else:
                    found = np.array(self._spell_one(words[int(chosen[0])]), np.int64)
                    count = np.array([len(found)])
                pools.append(found)
                starts[chosen], sizes[chosen] = filled + np.cumsum(count) - count, count
                filled += len(found)
        pool = np.concatenate([np.zeros(0, np.int64), *pools]).astype(np.int32)
        return gather(pool, starts, sizes), sizes

    def emit(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels' bytes in a row, and how many each id has; none for unknown ids."""
        known = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        sizes = self._label_sizes[known]
        return gather(self._label_pool, self._label_starts[known], sizes), sizes


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable Latin-1 ones for themselves, the
    others, in order, for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Codec:
    """Automaton and special tokens of a tokenizer file, and the worker's table of chunks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        self._verify(read)
        letters, vocabulary = _byte_letters(), read["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in read["model"]["merges"]]
        unions = [vocabulary[a + b] for a, b in pairs]
        labels = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self._special = {t["content"]: t["id"] for t in read["added_tokens"]}
        labels |= {
            i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
            for t, i in self._special.items()
        }
        if len(set(unions)) < len(unions) or len({vocabulary[c] for c in letters}) < 256:
            raise ValueError("a token is made by two merges, or a byte has no token")
        of_bytes = {vocabulary[c] for c in letters}
        self.automaton = Automaton(
            labels, ((vocabulary[a], vocabulary[b], i) for (a, b), i in zip(pairs, unions))
        )
        if any(len(labels[i]) == 1 and i not in of_bytes for i in labels):
            raise ValueError("a special token is a single byte")
        self._split = regex.compile(SPLIT).findall
        listed = sorted(self._special, key=len, reverse=True)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, listed)) + ")").split if listed else None
        self.table = ChunkTable(self._learn, TABLE_CHUNKS, TABLE_CHARS)

    @staticmethod
    def _verify(read: dict) -> None:
        model, split = read["model"], read["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE" and not read["normalizer"]
            and not any(model.get(k) for k in (
                "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback",
                "ignore_merges"))
            and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
            and split.get("use_regex", True) and (read["decoder"] or {}).get("type") == "ByteLevel"
        )
        if not plain:
            raise ValueError("not a plain byte-level BPE file")
        for token in read["added_tokens"]:
            odd = token["single_word"] or token["lstrip"] or token["rstrip"]
            if odd or not token["content"] or " " in token["content"] or token["content"][-1] in ".,":
                raise ValueError(f"special token {token['content']!r} is not supported")

    def _begins(self, parts: pa.Array) -> np.ndarray:
        """A text may be cut before them. Before a blank: what follows is neither white space or an
        unusual character, so that the split pattern parts there, nor a special token. Else
        they are the signs that end a word."""
        second = pc.utf8_slice_codeunits(parts, 1, 2).dictionary_encode()
        plain = np.array([c.isprintable() and c != "" for c in second.dictionary.to_pylist()], bool)
        blank = pc.starts_with(parts, " ").to_numpy(zero_copy_only=False)
        found = ~blank | plain[second.indices.to_numpy()]
        for token in self._special:
            found &= ~pc.starts_with(parts, f" {token}").to_numpy(zero_copy_only=False)
        return found

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words: list[bytes] = []
        counts, special = [], {}
        for chunk in chunks:
            before = len(words)
            if chunk.isascii() and chunk[1:].isalpha() and chunk[0] == " ":
                words.append(chunk.encode())
            elif self._cut and any(t in chunk for t in self._special):
                for number, piece in enumerate(self._cut(chunk)):
                    if number % 2:
                        special[len(words)] = self._special[piece]
                        words.append(b" ")
                    else:
                        words += [w.encode() for w in self._split(piece)]
            else:
                words += [w.encode() for w in self._split(chunk)]
            counts.append(len(words) - before)
        ids, sizes = self.automaton.spell(words)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if special:
            ids[ends[list(special)]] = list(special.values())
        ends = ends[np.cumsum([0, *counts])]
        return ids, np.diff(ends)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        number, mark = 0, "\x1f"  # a text that no text holds
        while pc.any(pc.match_substring(texts, mark)).as_py():
            number, mark = number + 1, f"\x1f{number}"
        marked = pc.replace_substring(texts, " ", f"{mark} ")
        # Full stops and commas that end a word are parts of their own.
        marked = pc.replace_substring_regex(marked, f"([A-Za-z0-9])([.,]+)({mark}|$)", rf"\1{mark}\2\3")
        return ids_of_column(marked, self.table, mark, self._begins)

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text], pa.string()))[0].tolist()

    def decode_column(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of ids in a row, of which each text has so many."""
        data, sizes = self.automaton.emit(ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), buffers)
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            return pa.array([t.as_py().decode("utf-8", "replace") for t in texts], pa.string())


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_rows(
    df: DataFrame, text: str, path: str, *, ids: str = "ids", decoded: str | None = None, keep_text: bool = True
) -> DataFrame:
    """Adds the ids of the text to every row, and, under the name ``decoded``, the text decoded
    from them. ``path`` has to be readable on every worker."""
    new = [ids, decoded] if decoded else [ids]
    kept = [c for c in df.columns if c not in new and (keep_text or c != text)]
    fields = [*(df.schema[c] for c in kept), StructField(ids, ArrayType(IntegerType()))]
    fields += [StructField(decoded, StringType())] if decoded else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in cut_batch(batch, "body", BATCH_BYTES):
                found, counts = own.encode_column(part["body"])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = part.columns[:len(kept)]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(found, pa.int32())))
                if decoded:
                    columns.append(own.decode_column(found, counts))
                yield pa.RecordBatch.from_arrays(columns, names=kept + new)

    return for_arrow(df, kept, body=column(df, text)).mapInArrow(encode, StructType(fields))


def decode(ids: Column, path: str) -> Column:
    """The text of a list of ids."""

    @F.arrow_udf(StringType())
    def texts(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return codec(path).decode_column(flat, counts)

    return texts(ids)
