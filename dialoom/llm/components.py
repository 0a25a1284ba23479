"""Connected components of a list of links, as joins over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``).

    Randomised contraction: in each round every node moves to the node of its neighbourhood,
    itself included, with the smallest hash of the round, and the links between the places moved
    to are the next round's. Fresh hashes each round let a constant share of the nodes go in
    expectation, also along chains, so the rounds grow with the logarithm of the nodes. A node
    with very many links is a group of a minimum, which is combined before the shuffle. Each round
    is a written table.
    """
    edges = materialize(links.filter("a <> b").select("a", "b").distinct())
    roots, turn = None, 0
    while not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("node"), ranked("b").alias("r")).unionByName(
            edges.select(F.col("b").alias("node"), ranked("a").alias("r"))
        )
        least = both.groupBy("node").agg(F.min("r").alias("r"))
        moves = materialize(
            least.select("node", F.least(F.col("r"), ranked("node"))["to"].alias("to"))
        )
        place = lambda c, name: moves.select(F.col("node").alias(c), F.col("to").alias(name))  # noqa: B023, E731
        edges = materialize(
            edges.join(place("a", "x"), "a").join(place("b", "y"), "b").filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        if roots is None:
            roots = moves.select("node", F.col("to").alias("root"))
        else:
            on = place("root", "next")
            roots = materialize(
                roots.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            )
        turn += 1
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if roots is None else roots
