"""Filter interaction audit: what every order of a set of filters would remove, by part.

Filters read a document independently of each other, so the state of an order is the set of filters
applied so far, and n! orders run over only 2^n states. A document is the bit mask of the filters it
fails: it is removed on the edge from set S to S + {f} if it fails f and nothing in S, whatever
order led to S. Path counting over the lattice tells how many orders use an edge: those that reach
S (counted forward from the empty set) times those that leave S + {f} (counted backward from the
full set). The sum of an edge's removals times its orders, over the edges of f, is f's Shapley
weight over all orders; and each order's steps are read from the same edges.

The rows are reduced at once: a document becomes a mask where its text is read, and no text is
shuffled; a part has at most 2^n rows of counts before the lattice is walked.

Filters of ``FILTERS`` (null text: empty; words: maximal runs that are not white space):
A under 50 words; B under 65 distinct words in 100; C over 5 capital letters in 100 code points;
D any of ``#$%&*|``; E identical to the text of a smaller key, in any part, removed or not.

Defined results: a null part is the empty string. A null key has no smaller key and is smaller than
none, so such rows never fail E; rows of equal key and text do not fail by each other. A
document is good or toxic if any label row of its key says so; labels of null are none. An empty table
has no parts, so no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.llm.tables import column

FILTERS = "ABCDE"
_WHITE = r"[\x20\x09-\x0D]+"


def paths(n: int) -> tuple[list[int], list[int]]:
    """How many orders reach each state from the empty set, and leave it for the full set."""
    full = (1 << n) - 1
    reaching, leaving = [0] * (full + 1), [0] * (full + 1)
    reaching[0] = leaving[full] = 1
    for state in range(full + 1):
        for bit in (1 << f for f in range(n)):
            if not state & bit:
                reaching[state | bit] += reaching[state]
    for state in range(full, -1, -1):
        for bit in (1 << f for f in range(n)):
            if not state & bit:
                leaving[state] += leaving[state | bit]
    return reaching, leaving


def edges(names: str) -> list[dict]:
    """The edges of the lattice: state, bit of the filter, number of orders through the edge, and
    each of those orders with the step at which it takes the edge."""
    reaching, leaving = paths(len(names))
    through: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            through.setdefault((state, 1 << f), []).append(("".join(names[i] for i in order), step))
            state |= 1 << f
    return [
        {"state": state, "bit": bit, "orders": reaching[state] * leaving[state | bit], "uses": uses}
        for (state, bit), uses in sorted(through.items())
    ]


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at the text alone, A to D."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, _WHITE), lambda w: w != "")

    def bits(words: Column) -> Column:
        n = F.size(words)
        failed = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n]
        return F.when(failed[0], 1).otherwise(0) + F.when(failed[1], 2).otherwise(0)

    # A single-element array binds the words once.
    of_words = F.transform(F.array(words), bits)[0]
    capitals = 100 * F.regexp_count(body, F.lit("[A-Z]")).cast("long") > 5 * F.length(body).cast("long")
    return (
        of_words + F.when(capitals, 4).otherwise(0) + F.when(body.rlike(r"[#$%&*|]"), 8).otherwise(0)
    ).cast("int")


def masks(docs: DataFrame, labels: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail.

    Texts are compared by their SHA-256. Rows are first counted by key, hash and part, so that a
    text that a third of all rows share is reduced before its rows meet."""
    body = F.coalesce(column(docs, text), F.lit(""))
    rows = docs.select(
        column(docs, key).alias("key"), F.unhex(F.sha2(body, 256)).alias("hash"), text_mask(body).alias("mask"),
        F.coalesce(column(docs, part), F.lit("")).alias("part"),
        # Rows without a key are spread by their text; the join's condition keeps them from any label.
        F.coalesce(column(docs, key).cast("long"), F.xxhash64(body)).alias("place"),
    )
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("place")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    labelled = (rows["place"] == marks["place"]) & rows["key"].isNotNull()
    rows = rows.join(marks, labelled, "left").select(
        rows["key"], rows["place"], "hash", "mask", "part",
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")),
    )
    group = ["hash", "mask", "part", "good", "toxic"]
    by_key = rows.groupBy(*group, "key", "place").agg(F.count(F.lit(1)).alias("n"))
    # Per text: its rows, and, of the smallest key, the key and its rows.
    by_text = by_key.groupBy(*group).agg(
        F.sum("n").alias("n"), F.min("key").alias("first"), F.min_by("n", "key").alias("firsts"),
        F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
    )
    first = F.min("first").over(Window.partitionBy("hash"))
    kept = F.col("nulls") + F.when(F.col("first") == first, F.col("firsts")).otherwise(0)
    counted = by_text.withColumn("kept", kept).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), F.col("kept").alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("kept")).alias("n")),
        )).alias("c"),
    )
    n = F.col("c.n")
    return counted.where(n > 0).groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
    )


def walk(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for all orders of the filters, from (part, mask, n, good, toxic)."""
    found = edges(names)
    listed = F.expr("array(" + ", ".join(
        f"named_struct('state', {e['state']}, 'bit', {e['bit']}, 'orders', {e['orders']}L)" for e in found) + ")")
    fails = F.col("mask").bitwiseAND(F.col("e.bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("e.state")) != 0

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0))

    on_edges = counts.withColumn("e", F.explode(listed)).groupBy("part", "e").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("e.bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    weight = F.sum(F.col("removed") * F.col("e.orders")).over(Window.partitionBy("part", "e.bit"))
    uses = F.expr("map(" + ", ".join(
        f"{e['state'] << len(names) | e['bit']}, array(" + ", ".join(
            f"named_struct('filter_order', '{order}', 'step', {step})" for order, step in e["uses"]) + ")"
        for e in found) + ")")
    edge = F.shiftleft("e.state", len(names)).bitwiseOR(F.col("e.bit"))
    return on_edges.withColumn("shapley", weight).select("*", F.explode(uses[edge]).alias("use")).select(
        "part", "use.filter_order", "use.step", "kept", "removed", "redundant", "unique_fails", "good_lost",
        "toxic_lost", "shapley",
    )


def audit(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    return walk(masks(docs, labels, key, text, part))
