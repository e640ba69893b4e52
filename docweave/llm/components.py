"""Connected components of a graph in Spark, for graphs of any size and shape."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.plans.session import checkpoint, forget


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the component's least node.

    Large-star and small-star rounds: each node links its larger neighbours to its least neighbour,
    then its smaller neighbours and itself to the least of them, until no round changes anything.
    Every round is two aggregations by node whose least neighbour is taken by a min with map-side
    combine, joined back, so that a node with very many links makes no hot task. The number of rounds
    is logarithmic in the longest chain. Each round is checkpointed in the shared folder.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    if not mark[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for n in itertools.count(1):
        if n % 3 == 0:
            forget(edges.sparkSession)
        both = now.union(now.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), F.col("m"), F.col("a"))
        after = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = checkpoint(after)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Two equal marks in a row: the same set of edges."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0))).first()
    return tuple(row)
