"""Connected components of an edge table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm._common import table

#: Rounds after which vertices are ordered anew, so that two of equal order cannot stand apart for ever.
ROUNDS_AN_ORDER = 16


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (v, label): each vertex of an edge with the least vertex of its component.

    In a round every vertex moves to the first, in a random order, of itself and its
    neighbours; edges follow their ends, and those whose ends meet go.  A star is gone
    after two rounds and a chain halves, so all rounds together handle a few times the
    edges.  The moves are then followed from the last to the first.
    """
    e = table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not e.isEmpty():
        place = lambda c, turn=len(moves) // ROUNDS_AN_ORDER: F.xxhash64(F.col(c), F.lit(turn))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", place("b")).alias("b"))
        moves.append(table(first.select(F.col("a").alias("v"), F.when(place("b") < place("a"), F.col("b")).otherwise(F.col("a")).alias("to"))))
        to = lambda end: moves[-1].select(F.col("v").alias(end), F.col("to").alias(f"{end}_to"))
        moved = table(e.join(to("a"), "a").select("a_to", "b")).join(to("b"), "b").where("a_to <> b_to")
        e = table(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    if not moves:
        return e.select(F.col("a").alias("v"), F.col("b").alias("label"))
    at = moves.pop()
    while moves:  # a vertex that stood still when others moved on is in no later table
        further = at.select(F.col("v").alias("to"), F.col("to").alias("further"))
        at = table(moves.pop().join(further, "to", "left").select("v", F.coalesce("further", "to").alias("to")))
    least = table(at.groupBy("to").agg(F.min("v").alias("label")))
    return table(at.join(least, "to").select("v", "label"))
