"""Connected components of links, by stars that shrink in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesleuth.llm import scratch


def _stars(edges: DataFrame, everything: bool) -> tuple[DataFrame, list[str]]:
    """Tie neighbours of each node to the smallest of them.

    The large form looks at all neighbours and moves the greater ones, the small
    form looks at smaller neighbours and moves them and the node.  Both inputs of
    the join are read from written tables, so Spark can split a hub's rows.
    """
    spark = edges.sparkSession
    if everything:
        edges, both = scratch.write(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "stars")
    least, path = scratch.write(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    joined = edges.join(least, "a")
    if everything:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out, out_path = scratch.write(moved.distinct(), "stars")
    scratch.drop(spark, path, *([both] if everything else []))
    return out, [out_path]


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in undirected long pairs ``(a, b)``.

    The component is its smallest node.  Loops, repeats and either direction of
    a pair are fine; pairs with a null are left out; no pairs give no rows.  The
    rounds end when a whole round changes no pair.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = scratch.write(pairs, "stars")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == seen:
            break
        seen = state
        large, gone = _stars(now, True)
        small, kept = _stars(large, False)
        scratch.drop(spark, path, *gone)
        now, path = small, kept[0]
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
