"""Connected components by rounds of a small star and a large star.

A link goes from its larger node a to its smaller node b. A small star links the nodes below a
node, and the node itself, to the smallest of them; a large star then moves every link to the
smallest node below its lower end. Neither adds links. A round shuffles links by a, for the small
star, which also drops repeated ones; then the smallest nodes, as partial minima, and the links by
b, for the join that brings them together. Each round is written once to the shared folder, which
cuts the lineage; the round that moves no link is the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.runtime import materialise


def _small_star(links: DataFrame) -> DataFrame:
    """Links without repeats; ``moved`` tells those that were not there."""
    around = Window.partitionBy("a").orderBy("b")
    found = links.select(
        "a", "b", F.first("b").over(around).alias("_m"), F.lag("b").over(around).alias("_before")
    ).where(F.col("_before").isNull() | (F.col("_before") != F.col("b")))
    moved = F.col("b") != F.col("_m")
    return found.select(
        F.when(moved, F.col("b")).otherwise(F.col("a")).alias("a"), F.col("_m").alias("b"), moved.alias("moved")
    )


def _large_star(links: DataFrame) -> DataFrame:
    # By the turned key the minima are dealt out anew. Joined as they are grouped, adaptive execution
    # could not split a partition, and all links to a hub would be one task's.
    least = links.groupBy("a").agg(F.min("b").alias("_m")).select(F.bitwise_not("a").alias("_turned"), "_m")
    return links.join(least, F.bitwise_not("b") == F.col("_turned"), "left").select(
        "a", F.coalesce("_m", "b").alias("b"), (F.col("moved") | F.col("_m").isNotNull()).alias("moved")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has two long columns a and b without nulls. Returns (node, root), root being the
    smallest node it reaches; nodes that are a root themselves are left out."""
    current = materialise(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ))
    moved = True
    while moved:
        current = materialise(_large_star(_small_star(current.select("a", "b"))))
        moved = current.agg(F.max("moved")).first()[0]
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
