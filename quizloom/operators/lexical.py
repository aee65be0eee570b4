"""Lexical rerank: vocabulary, idf, TF-IDF vectors, cosine scores, top k and context.

The single steps are plain joins and groupings. The search itself (``lexical_topk``) reads
each passage once, writes its vocabulary counts as one sparse row, and scores sparse rows
against a bounded block of queries inside the tasks, keeping k rows per query. Passages
are never shuffled, and no (query, passage) pair becomes a row before the cut to k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom import constants as K
from quizloom.functions import text as T
from quizloom.operators import blocks as B
from quizloom.operators.postings import SENT_BYTES, Postings
from quizloom.runtime import dense_row_id, materialise, nth_key

# Tokens whose terms a task counts at a time, and rows of the batches it hands on.
COUNTED_TOKENS = 1 << 21
COUNTED_ROWS = 1 << 17

# ---------------------------------------------------------------- single steps


def tokens_of(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """(id, tokens) without stop words."""
    return df.select(id_column, T.drop_stop_words(T.tokenise(F.col(text))).alias("tokens"))


def exploded_terms(df: DataFrame, id_column: str | None, text: str = "text") -> DataFrame:
    """(id, term), a row per occurrence of a word or word pair. Without an id column (term, n):
    occurrences are counted where they are cut, ``COUNTED_TOKENS`` tokens at a time, so that a term
    comes once for every such run that holds it."""
    if id_column is None:
        return _counted_terms(df.select(T.drop_stop_words(T.tokenise(F.col(text))).alias("tokens")))
    tokens = df.select(id_column, T.drop_stop_words(T.tokenise(F.col(text))).alias("tokens"))
    return tokens.select(id_column, F.explode(T.terms(F.col("tokens"))).alias("term"))


def _counted_terms(tokens: DataFrame) -> DataFrame:
    """Words are numbered within a run, and pairs counted by the numbers of their words."""
    most, rows = COUNTED_TOKENS, COUNTED_ROWS

    def pieces(terms: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = pa.array(counts, pa.int64())
        for at in range(0, len(terms), rows):
            yield pa.RecordBatch.from_arrays([terms.slice(at, rows), n.slice(at, rows)], names=["term", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            last = np.zeros(len(flat), dtype=bool)
            last[np.cumsum(lengths)[lengths > 0] - 1] = True
            for first in range(0, len(flat), most):
                # With the first token of the next run, as the second of a pair.
                run = flat.slice(first, most + 1).dictionary_encode()
                words, code = run.dictionary, run.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                found = np.bincount(code[:most], minlength=len(words))
                held = np.flatnonzero(found)
                yield from pieces(words.take(pa.array(held)), found[held])
                both = ~last[first : first + code.size - 1]
                key, found = np.unique(code[:-1][both] * len(words) + code[1:][both], return_counts=True)
                left, right = (words.take(pa.array(part)) for part in np.divmod(key, len(words)))
                yield from pieces(pc.binary_join_element_wise(left, right, " "), found)

    return tokens.mapInArrow(count, "term string, n long")


def with_chunk(
    queries: DataFrame, id_column: str = "query_id", size: int | None = None
) -> DataFrame:
    """Number queries in id order and put ``size`` of them in a chunk; without a size all are
    one chunk, so that no query's scores depend on which others share its chunk."""
    if size is None:
        return queries.withColumn("chunk", F.lit(0).cast("long"))
    return dense_row_id(queries, [id_column], "query_no").withColumn(
        "chunk", F.floor(F.col("query_no") / F.lit(size)).cast("long")
    )


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(chunk, query_id, term, tf) of chunked queries; one null term for a query with none."""
    tokens = queries.select(
        "chunk", "query_id", T.drop_stop_words(T.tokenise(F.col(text))).alias("tokens")
    )
    return (
        tokens.select(
            "chunk", "query_id", F.explode_outer(T.terms(F.col("tokens"))).alias("term")
        )
        .groupBy("chunk", "query_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(terms: DataFrame) -> DataFrame:
    """Distinct terms of the queries of a chunk."""
    return terms.select("chunk", "term").where(F.col("term").isNotNull()).distinct()


def term_counts(passages: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """(passage_id, term, tf) of the terms some query holds.

    A vocabulary of ``SENT_BYTES`` at most is sent to the tasks, so that occurrences of other
    terms go where they are cut; what is left is counted in the tasks before it is shuffled. With a
    larger one, occurrences are counted in the tasks and then meet the vocabulary.
    """
    wanted = materialise(vocab.select("term").distinct())
    terms = exploded_terms(passages, "passage_id", text)
    size = wanted.agg(F.sum(F.octet_length("term") + F.lit(48)).alias("bytes")).first()["bytes"] or 0
    sent = size <= SENT_BYTES
    if sent:
        terms = terms.join(F.broadcast(wanted), "term", "left_semi")
    counted = terms.groupBy("passage_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return counted if sent else counted.join(wanted, "term", "left_semi").select("passage_id", "term", "tf")


def idf(vocab: DataFrame, counts: DataFrame, n_passages: Column) -> DataFrame:
    """Smoothed idf of every vocabulary term, also of those no passage holds.

    ``counts`` holds the term counts of the sampled passages and ``n_passages`` their number,
    a literal or a scalar subquery.
    """
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    frequency = F.coalesce(F.col("df"), F.lit(0)).cast("long")
    return (
        vocab.join(df, "term", "left")
        .select("chunk", "term", frequency.alias("df"))
        .withColumn("idf", F.log((1 + n_passages) / (1 + F.col("df"))) + 1)
    )


def passage_vectors(counts: DataFrame, idf_table: DataFrame) -> DataFrame:
    """(chunk, passage_id, term, weight), of unit length over the chunk's vocabulary."""
    raw = counts.join(idf_table, "term").withColumn("w", F.col("tf") * F.col("idf"))
    passage = Window.partitionBy("chunk", "passage_id")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(passage))
    return raw.select("chunk", "passage_id", "term", (F.col("w") / length).alias("weight"))


# ---------------------------------------------------------------- block search


@dataclass
class _Chunk:
    """The queries of one chunk as postings, in one shared numbering of terms."""

    query_ids: np.ndarray
    start: np.ndarray  # first posting of a term
    count: np.ndarray  # postings of a term; 0 for terms outside the chunk
    query: np.ndarray  # query position of a posting
    tf: np.ndarray
    member: np.ndarray  # whether a term is in the chunk's vocabulary
    owned: np.ndarray  # of a part of a chunk: terms that count here for passage lengths
    weight: np.ndarray | None = None


@dataclass
class _Block:
    """One pass over the passages: whole chunks, or a part of one very large chunk."""

    words: np.ndarray
    pairs: np.ndarray  # first word * number of words + second word, ascending
    chunks: list[_Chunk]

    @property
    def n_terms(self) -> int:
        return self.words.size + self.pairs.size


def _block(table: pa.Table) -> _Block:
    terms = table.column("term").combine_chunks()
    filled = terms.is_valid().to_numpy(zero_copy_only=False)
    distinct = terms.drop_null().unique()
    names = distinct.to_numpy(zero_copy_only=False).astype(object)
    is_pair = np.array([" " in name for name in names], dtype=bool)
    words = np.sort(names[~is_pair])
    place = {word: i for i, word in enumerate(words)}
    codes = np.full(names.size, -1, dtype=np.int64)
    codes[~is_pair] = [place[word] for word in names[~is_pair]]
    keys = np.empty(int(is_pair.sum()), dtype=np.int64)
    for i, name in enumerate(names[is_pair]):
        first, _, second = name.partition(" ")
        keys[i] = place[first] * words.size + place[second]
    pairs = np.sort(keys)
    codes[is_pair] = words.size + np.searchsorted(pairs, keys)
    code = np.full(filled.size, -1, dtype=np.int64)
    found = pc.index_in(terms.drop_null(), value_set=distinct)
    code[filled] = codes[found.to_numpy(zero_copy_only=False)]

    chunk_no = table.column("chunk").to_numpy()
    query_id = table.column("query_id").to_numpy()
    tf = table.column("tf").to_numpy().astype(np.float64)
    own = table.column("own").to_numpy() if "own" in table.column_names else np.ones(len(tf), bool)
    n_terms = words.size + pairs.size
    chunks = []
    for chunk in np.unique(chunk_no):
        here = chunk_no == chunk
        ids = np.unique(query_id[here])
        at = np.flatnonzero(here & filled)
        at = at[np.lexsort((query_id[at], code[at]))]
        position = np.searchsorted(ids, query_id[at])
        count = np.bincount(code[at], minlength=n_terms)
        owned = np.bincount(code[at][own[at]], minlength=n_terms) > 0
        chunks.append(
            _Chunk(ids, np.cumsum(count) - count, count, position, tf[at], count > 0, owned)
        )
    return _Block(words, pairs, chunks)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, … (count[0] of them), start[1], …"""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(start, count)


def _encode(passages: DataFrame, block: _Block) -> DataFrame:
    """One row per passage: the vocabulary terms it holds and how often.

    A vocabulary pair consists of two vocabulary words, so words are looked up as text and
    pairs by the numbers of their words.
    """
    spark = passages.sparkSession
    shared = spark.sparkContext.broadcast((pa.array(block.words, pa.string()), block.pairs))
    n_words, n_terms = block.words.size, block.n_terms

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value
        for batch in B.list_runs(batches, "tokens"):
            n = batch.num_rows
            tokens = batch.column("tokens")
            lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), lengths)
            found = pc.index_in(tokens.flatten(), value_set=words)
            word = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = word >= 0
            code = [row[known] * n_terms + word[known]]
            if pairs.size and word.size > 1:
                both = known[:-1] & known[1:] & (row[:-1] == row[1:])
                key = word[:-1][both] * n_words + word[1:][both]
                place = np.minimum(np.searchsorted(pairs, key), pairs.size - 1)
                hit = pairs[place] == key
                code.append(row[:-1][both][hit] * n_terms + n_words + place[hit])
            cell, tf = np.unique(np.concatenate(code), return_counts=True)
            of_row, term = np.divmod(cell, max(1, n_terms))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of_row, minlength=n))])
            offsets = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("passage_id"),
                    pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())),
                ],
                names=["passage_id", "terms", "tfs"],
            )

    tokens = tokens_of(
        passages.select("passage_id", T.scoring_text(F.col("text")).alias("text")), "passage_id"
    )
    return tokens.mapInArrow(
        encode, "passage_id long, terms array<int>, tfs array<int>"
    )


def _weigh_queries(block: _Block, idf_values: np.ndarray) -> None:
    for chunk in block.chunks:
        term = np.repeat(np.arange(chunk.count.size), chunk.count)
        raw = chunk.tf * idf_values[term]
        square = np.bincount(chunk.query, weights=raw**2, minlength=chunk.query_ids.size)
        chunk.weight = raw / np.sqrt(square)[chunk.query]


_SCORE_SCHEMA = "query_id long, passage_id long, score_key long"


def _score(sparse: DataFrame, block: _Block, idf_values, k: int | None, zeros: bool = False) -> DataFrame:
    """Scores of one block; the k best per query and task, or all above zero, with ``zeros`` all.

    With a column ``norm`` that is used as the passage length, else the length follows
    from the terms of the chunk.
    """
    given = "norm" in sparse.columns
    shared = sparse.sparkSession.sparkContext.broadcast((block.chunks, idf_values))

    def as_batch(query_ids, ids, keys) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids), pa.array(ids), pa.array(keys)],
            names=["query_id", "passage_id", "score_key"],
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, idf_of = shared.value
        states = [B.RunningTopK(c.query_ids.size, k) for c in chunks] if k else []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("passage_id").to_numpy(zero_copy_only=False)
            order = np.argsort(ids)
            batch = batch.take(pa.array(order))
            ids = ids[order]
            terms = batch.column("terms")
            lengths = terms.value_lengths().to_numpy(zero_copy_only=False)
            term = terms.flatten().to_numpy(zero_copy_only=False)
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            norm = batch.column("norm").to_numpy(zero_copy_only=False) if given else None
            raw = tf * idf_of[term]
            for which, chunk in enumerate(chunks):
                n_queries = chunk.query_ids.size
                for part in B.row_slices(batch.num_rows, n_queries):
                    first = int(ends[part.start - 1]) if part.start else 0
                    last = int(ends[part.stop - 1])
                    n = part.stop - part.start
                    row = np.repeat(np.arange(n), lengths[part])
                    t, w = term[first:last], raw[first:last]
                    inside = chunk.member[t]
                    row, t, w = row[inside], t[inside], w[inside]
                    if given:
                        length = norm[part]
                    else:
                        length = np.sqrt(np.bincount(row, weights=w**2, minlength=n))
                    w = w / length[row]
                    who = _may_enter(t, w, chunk, states[which].keys[:, -1]) if k else None
                    dots = _dots(row, t, w, chunk, n, who)
                    keys = -np.rint(dots * B.SCALE).astype(np.int64)
                    if k:
                        states[which].push(keys, ids[part], who)
                    elif zeros:
                        yield as_batch(np.repeat(chunk.query_ids, n), np.tile(ids[part], n_queries), keys.ravel())
                    else:
                        q, p = np.nonzero(dots > 0)
                        yield as_batch(chunk.query_ids[q], ids[part][p], keys[q, p])
        for chunk, state in zip(chunks, states, strict=False):
            query, found, keys = state.rows()
            yield as_batch(chunk.query_ids[query], found, keys)

    return sparse.mapInArrow(score, _SCORE_SCHEMA)


def _may_enter(term, weight, chunk: _Chunk, last: np.ndarray) -> np.ndarray | None:
    """The queries for which a row of this block may enter the k best so far, None for all: no row
    scores more than the sum, over the query's terms, of the term's largest weight in the block."""
    most = np.zeros(chunk.count.size)
    np.maximum.at(most, term, weight)
    held = np.repeat(most, chunk.count)
    bound = np.bincount(chunk.query, weights=chunk.weight * held, minlength=chunk.query_ids.size)
    who = np.flatnonzero(-np.rint(bound * B.SCALE) - 1 <= last)
    return None if who.size == chunk.query_ids.size else who


def _dots(row, term, weight, chunk: _Chunk, n: int, who: np.ndarray | None = None) -> np.ndarray:
    """Queries x rows products of sparse rows with the postings of a chunk, or of some queries."""
    n_queries = chunk.query_ids.size
    first, count, query, own = chunk.start, chunk.count, chunk.query, chunk.weight
    if who is not None:
        place_of = np.full(n_queries, -1)
        place_of[who] = np.arange(who.size)
        kept = place_of[query] >= 0
        ends = np.concatenate([[0], np.cumsum(kept)])
        first, count = ends[chunk.start], ends[chunk.start + chunk.count] - ends[chunk.start]
        query, own, n_queries = place_of[query[kept]], own[kept], who.size
    dots = np.zeros(n_queries * n)
    postings = count[term]
    ends = np.cumsum(postings)
    start = 0
    while start < term.size:
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + B.BLOCK_CELLS, side="right"))
        stop = max(stop, start + 1)
        at = slice(start, stop)
        place = _spread(first[term[at]], postings[at])
        cell = query[place] * n + np.repeat(row[at], postings[at])
        value = own[place] * np.repeat(weight[at], postings[at])
        dots += np.bincount(cell, weights=value, minlength=n_queries * n)
        start = stop
    return dots.reshape(n_queries, n)


def _query_parts(terms: DataFrame, limit: int) -> DataFrame:
    """(chunk, query_id, n, part): parts of a very large chunk, dealt by a hash of the query so
    that each has about half the limit of terms; no running sum brings a chunk's queries
    together."""
    per_query = terms.groupBy("chunk", "query_id").agg(F.count(F.lit(1)).alias("n"))
    totals = per_query.groupBy("chunk").agg(F.sum("n").alias("_all"))
    parts = F.when(F.col("_all") <= limit, 1).otherwise(F.ceil(2 * F.col("_all") / F.lit(limit)))
    dealt = F.pmod(F.xxhash64("query_id"), parts.cast("long")).cast("int")
    return per_query.join(F.broadcast(totals), "chunk").select("chunk", "query_id", "n", dealt.alias("part"))


def _plan_passes(parts: DataFrame, limit: int):
    """Lists of (chunk, part) that fit one block together, and the chunks cut in parts.

    One short row per chunk and part comes to the driver.
    """
    sizes = parts.groupBy("chunk", "part").agg(F.sum("n").alias("n")).orderBy("chunk", "part")
    rows = sizes.collect()
    split = {row["chunk"] for row in rows if row["part"] > 0}
    passes: list[list[tuple[int, int]]] = []
    filled = 0
    for row in rows:
        # A part of a cut chunk is a pass of its own, as it brings its own passage lengths.
        alone = row["chunk"] in split or (passes and passes[-1][0][0] in split)
        if not passes or alone or filled + row["n"] > limit:
            passes.append([])
            filled = 0
        passes[-1].append((row["chunk"], row["part"]))
        filled += row["n"]
    return passes, split


def _squares(sparse: DataFrame, block: _Block, idf_values: np.ndarray) -> DataFrame:
    """(passage_id, square): what one part of a chunk adds to the squared passage lengths."""
    shared = sparse.sparkSession.sparkContext.broadcast(np.where(block.chunks[0].owned, idf_values, 0.0))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf_of = shared.value
        for batch in batches:
            lengths = batch["terms"].value_lengths().to_numpy(zero_copy_only=False)
            term, tf = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
            raw = tf * idf_of[term]
            row = np.repeat(np.arange(batch.num_rows), lengths)
            square = np.bincount(row, weights=raw**2, minlength=batch.num_rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch["passage_id"], pa.array(square)], names=["passage_id", "square"])

    return sparse.mapInArrow(squares, "passage_id long, square double")


def _lengths(jobs: list) -> DataFrame:
    """(passage_id, norm) over the vocabulary of a chunk that is cut in parts: every term counts in
    the first part that holds it, so the parts' sums add up and no text is read again."""
    parts = B.union_all([_squares(sparse, block, idf_values) for block, sparse, idf_values in jobs])
    return materialise(parts.groupBy("passage_id").agg(F.sqrt(F.sum("square")).alias("norm")))


def _score_pairs(sparse: DataFrame, asked: DataFrame, block: _Block, idf_values: np.ndarray) -> DataFrame:
    """Scores of the given (query_id, passage_id) alone: a passage's row meets the list of its
    queries in this block."""
    wanted = asked.groupBy("passage_id").agg(F.collect_list("query_id").alias("query_ids"))
    chunk, n_terms = block.chunks[0], block.n_terms
    term = np.repeat(np.arange(n_terms), chunk.count)
    key = chunk.query * n_terms + term
    order = np.argsort(key)
    given = "norm" in sparse.columns
    shared = sparse.sparkSession.sparkContext.broadcast(
        (chunk.query_ids, chunk.member, key[order], chunk.weight[order], idf_values))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, member, keys, weights, idf_of = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n or not len(keys):
                continue
            size = batch["terms"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            code = batch["terms"].flatten().to_numpy(zero_copy_only=False)
            raw = np.where(member[code], batch["tfs"].flatten().to_numpy(zero_copy_only=False) * idf_of[code], 0.0)
            length = np.sqrt(np.bincount(np.repeat(np.arange(n), size), weights=raw**2, minlength=n))
            if given:
                length = batch["norm"].to_numpy(zero_copy_only=False)
            asked_size = batch["query_ids"].value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), asked_size)
            query = np.searchsorted(ids_q, batch["query_ids"].flatten().to_numpy(zero_copy_only=False))
            starts = np.cumsum(size) - size
            dots = np.zeros(len(row))
            step = max(1, B.BLOCK_CELLS // max(1, int(size.max(initial=1))))
            for first in range(0, len(row), step):
                r, q = row[first:first + step], query[first:first + step]
                at = _spread(starts[r], size[r])
                pair = np.repeat(np.arange(len(r)), size[r])
                wanted_key = q[pair] * n_terms + code[at]
                place = np.minimum(np.searchsorted(keys, wanted_key), len(keys) - 1)
                value = np.where(keys[place] == wanted_key, weights[place], 0.0) * raw[at]
                dots[first:first + step] = np.bincount(pair, weights=value, minlength=len(r))
            dots = np.divide(dots, length[row], out=np.zeros(len(row)), where=length[row] > 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids_q[query]), batch["passage_id"].take(pa.array(row)),
                pa.array(-np.rint(dots * B.SCALE).astype(np.int64)),
            ], names=["query_id", "passage_id", "score_key"])

    return sparse.join(wanted, "passage_id").mapInArrow(score, _SCORE_SCHEMA)


def lexical_scores(
    queries: DataFrame,
    passages: DataFrame | None,
    k: int | None = K.LEXICAL_K,
    query_chunk: int | None = None,
    idf_sample: int | None = None,
    max_terms: int | None = None,
    index: Postings | None = None,
    pairs: DataFrame | None = None,
    zeros: bool = False,
) -> DataFrame:
    """Cosine scores (query_id, passage_id, score_key): the ``k`` best candidates per query and
    task, or with ``k=None`` every score above zero, with ``zeros`` also those of 0, or those of
    ``pairs`` (query_id, passage_id) alone. Keys are scores of six places as whole numbers, negative.

    ``queries`` is (query_id, text), ``passages`` is (passage_id, text) with unique ids; in their
    place stands an ``index`` of them. By default all queries share one vocabulary and idf is
    fitted on all passages; ``query_chunk`` queries each, or the first ``idf_sample`` passages by
    id, can be asked for.
    """
    limit = max_terms or B.MAX_BLOCK_TERMS
    chunked = with_chunk(queries.select("query_id", "text"), "query_id", query_chunk)
    terms = materialise(query_terms(chunked))
    parts = _query_parts(terms, limit)
    passes, split = _plan_passes(parts, limit)
    if len(passes) > 1:
        parts = materialise(parts)
        terms = terms.join(parts.select("chunk", "query_id", "part"), ["chunk", "query_id"])
        first = terms.where(F.col("chunk").isin(*split)).groupBy("chunk", "term").agg(F.min("part").alias("_first"))
        terms = materialise(terms.join(first, ["chunk", "term"], "left").select(
            "chunk", "part", "query_id", "term", "tf", F.coalesce(F.col("_first") == F.col("part"), F.lit(True)).alias("own")))
    ids = None if index is None else index.passages
    n_all = None if index is None else ids.count()
    threshold = None
    jobs = []
    for chosen in passes:
        mine = terms
        if len(passes) > 1:
            mine = terms.where(F.concat_ws("/", "chunk", "part").isin(*[f"{c}/{p}" for c, p in chosen]))
        block = _block(mine.toArrow())
        encoded = _encode(passages, block) if index is None else index.sparse_rows(block.words.tolist(), block.pairs)
        sparse = materialise(encoded)
        if n_all is None:
            ids = sparse.select("passage_id")
            n_all = ids.count()
        if idf_sample is not None and n_all > idf_sample and threshold is None:
            threshold = nth_key(ids.select("passage_id"), idf_sample)["passage_id"]
        sample = sparse if threshold is None else sparse.where(F.col("passage_id") <= threshold)
        counted = (
            sample.select(F.explode("terms").alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        )
        df = np.zeros(block.n_terms)
        df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        n = n_all if idf_sample is None else min(n_all, idf_sample)
        idf_values = np.log((1.0 + n) / (1.0 + df)) + 1.0
        _weigh_queries(block, idf_values)
        jobs.append((chosen[0][0], block, sparse, idf_values))
    lengths = {chunk: _lengths([job[1:] for job in jobs if job[0] == chunk]) for chunk in sorted(split)}
    results = []
    for chunk, block, sparse, idf_values in jobs:
        if chunk in split:
            sparse = sparse.join(lengths[chunk], "passage_id", "left").na.fill({"norm": 1.0})
        if pairs is None:
            results.append(_score(sparse, block, idf_values, k, zeros))
        else:
            here = queries.sparkSession.createDataFrame(pa.table({"query_id": block.chunks[0].query_ids}))
            results.append(_score_pairs(sparse, pairs.join(here, "query_id", "left_semi"), block, idf_values))
    if not results:
        results = [queries.sparkSession.createDataFrame([], _SCORE_SCHEMA)]
    return B.union_all(results)


def _as_scores(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.abs(F.col("score_key") / F.lit(float(B.SCALE))))


def tfidf_scores(queries: DataFrame, passages: DataFrame, **options) -> DataFrame:
    """Every cosine score above zero, straight from the block product."""
    found = lexical_scores(queries, passages, k=None, **options)
    return _as_scores(found).select("query_id", "passage_id", "score")


def lexical_topk(
    queries: DataFrame,
    passages: DataFrame,
    k: int = K.LEXICAL_K,
    fill_to_k: bool = True,
    **options,
) -> DataFrame:
    """The ``k`` best passages per query by score, then passage_id.

    With ``fill_to_k`` passages that share no term with the query fill the list with score
    0 in passage_id order; without it they are left out.
    """
    found = lexical_scores(queries, passages, k=k, **options)
    if not fill_to_k:
        found = found.where(F.col("score_key") < 0)
    best = B.merge_ranked(found, ["query_id"], ["score_key", "passage_id"], k)
    return _as_scores(best).select("query_id", "rank", "score", "passage_id")


def own_pool_scores(
    queries: DataFrame, pairs: DataFrame | None, passages: DataFrame, max_terms: int | None = None
) -> DataFrame:
    """(query_id, passage_id, score) of the given ``pairs`` (query_id, passage_id) alone, or without
    pairs of every query and passage, 0 where they share no term.

    With pairs each question is scored against its own neighbours, so the work grows with the pairs
    and not with questions times passages; vocabulary and idf are those of all questions and of all
    passages of the pairs. Without pairs no passage is left out: idf is that of all passages, and
    the rows are questions times passages, straight from the block product and never shuffled.
    Passages are cut into terms once.
    """
    if pairs is None:
        every = lexical_scores(queries, passages, k=None, max_terms=max_terms, zeros=True)
        return _as_scores(every).select("query_id", "passage_id", "score")
    pairs = materialise(pairs.select("query_id", "passage_id").distinct())
    pool = passages.select("passage_id", "text").join(
        pairs.select("passage_id").distinct(), "passage_id", "left_semi"
    )
    found = _as_scores(lexical_scores(queries, pool, pairs=pairs, max_terms=max_terms))
    return pairs.join(found, ["query_id", "passage_id"], "left").select(
        "query_id", "passage_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )


def own_pool_topk(
    queries: DataFrame, pairs: DataFrame, passages: DataFrame, k: int = K.LEXICAL_K,
    fill_to_k: bool = True,
) -> DataFrame:
    """The ``k`` best of each query's own passages by score, then passage_id."""
    scores = own_pool_scores(queries, pairs, passages)
    if not fill_to_k:
        scores = scores.where(F.col("score") > 0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "passage_id")
    ranked = scores.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "score", "passage_id")


# ---------------------------------------------------------------- context


def with_texts(ranked: DataFrame, passages: DataFrame) -> DataFrame:
    """Add the NFKD text of each hit."""
    texts = passages.select("passage_id", "text").join(
        ranked.select("passage_id").distinct(), "passage_id", "left_semi"
    )
    texts = texts.select("passage_id", T.nfkd(F.col("text")).alias("text"))
    return ranked.join(texts, "passage_id")


def assemble_context(hits: DataFrame, id_column: str = "query_id") -> DataFrame:
    """One string per query: texts from best to worst, each followed by a line break.

    A query has at most k hits, so the collected list is short.
    """
    listed = hits.groupBy(id_column).agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("hits")
    )
    lines = F.transform("hits", lambda h: F.concat(h["text"], F.lit("\n")))
    return listed.select(id_column, F.array_join(lines, "").alias("context"))


def attach_context(questions: DataFrame, contexts: DataFrame, id_column: str) -> DataFrame:
    """Left join by question id; a question without hits gets an empty context."""
    return questions.join(contexts, id_column, "left").withColumn(
        "context", F.coalesce("context", F.lit(""))
    )
