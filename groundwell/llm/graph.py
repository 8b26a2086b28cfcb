"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import cut, release, with_groups


def _star(e: DataFrame, n_edges: int) -> DataFrame:
    """One large-star and one small-star round over ``n_edges`` edges (a, b) with a > b."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("c")).select("a", F.least("a", "m").alias("m"), "c")
    # (b, a) with b < a: those whose smaller end is the node a
    large = with_groups(both.where("b > a"), low, ["a"], ["m"], "c", n_edges, "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c"))
    linked = with_groups(large, least, ["a"], ["m"], "c", n_edges, "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Both stars only ever replace an edge by one to a smaller node of the same
    component, so the edges shrink to one star per component in a number of
    rounds that is logarithmic in practice, and the rounds end when a round
    changes nothing. Minima are pre-aggregated, the edges of a hub are dealt to
    all tasks. Each round is checkpointed and the one before it deleted.
    """
    e = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    mark = lambda t: t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
    before = mark(e)
    while before[0]:
        last, e = e, cut(_star(e, before[0]))
        release(last)
        after = mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
