"""Connected components by alternating stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardmill.operators.scratch import settled

#: Parts that the neighbours of every node are dealt to.
_SALTS = 16


def _with_least(edges: DataFrame) -> DataFrame:
    """a, b, least: the least of a's neighbours and a. Neighbours are salted, so a hub is
    spread over tasks, and the engine may split what is still large."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("least"),
        F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(_SALTS)).cast("int"))
    # the optimizer's estimate leaves the copies out, so it must not broadcast them
    return salted.join(least.hint("merge"), ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).filter("b > a").select(F.col("b").alias("a"),
                                                     F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    near = _with_least(edges)
    # an edge to the least stays, the other neighbours are hung on it
    return near.select(F.when(F.col("b") == F.col("least"), F.col("a"))
                       .otherwise(F.col("b")).alias("a"), F.col("least").alias("b")
                       ).unionByName(near.select("a", F.col("least").alias("b")))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40)))
                 .first())


def components(edges: DataFrame) -> DataFrame:
    """a, b: every node of an edge but the least of its component, and that least node.

    `edges` has two long columns a and b. Large and small stars alternate until nothing
    changes, which takes a number of rounds that grows with the logarithm of a component's
    size. Every round is written to the checkpoint folder; only two numbers reach the
    driver. No edges give no rows.
    """
    edges = settled(_clean(edges))
    before = _mark(edges)
    while before[0]:
        edges = settled(_clean(_small_star(settled(_large_star(edges)))))
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges
