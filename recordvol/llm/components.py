"""Connected components of a link table, by contraction; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordvol.llm._common import followed, stored


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (columns a and b, long); linked nodes get one root.

    Each round points every node to the smallest of itself and its neighbours, follows these
    pointers twice, and replaces the ends of all links by where they point. Links inside one node
    vanish, so the table shrinks by a constant factor where labels have no order along paths, as
    with hashes. A node with very many links is one row per task before it is shuffled, and a root
    that very many nodes point to is looked up by a broadcast of its one row.
    """
    left = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    names = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("b"))
        to = stored(near.select(F.col("a").alias("node"), F.col("b").alias("up")), "pointers")
        for _ in range(2):
            above = to.select(F.col("node").alias("up"), F.col("up").alias("top"))
            to = stored(followed(to, above, "up").select("node", F.col("top").alias("up")), "pointers")
        names = to.withColumnRenamed("up", "root") if names is None else _composed(names, to)
        names = stored(names, "roots")
        a = to.select(F.col("node").alias("a"), F.col("up").alias("x"))
        b = to.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = stored(followed(left, a, "a").select("b", "x"), "links")
        left = followed(left, b, "b").where("x <> y")
        left = stored(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return names if names is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _composed(names: DataFrame, to: DataFrame) -> DataFrame:
    step = to.select(F.col("node").alias("root"), "up")
    return followed(names, step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
