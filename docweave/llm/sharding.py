"""Sharding by a hierarchical weighted hash tree, in DataFrame functions alone.

A tree of regions, racks and shards is descended level by level. At each level every child draws
``-ln(u) / weight`` from a hash of the document id and the child's path, and the smallest draw wins,
so a child is chosen in proportion to its weight and a changed weight moves rows only into or out of
the subtree that changed. A shard that is added later stands in a region and a rack of its own:
no old weight changes, so rows move only into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.plans.session import checkpoint, shuffle_partitions

#: At most so many groups of rows a shard for numbering; bounds the table of their counts.
MOST_GROUPS = 1024
#: Repeated rows that one task brings back at a time.
RUN = 1 << 16


@dataclass(frozen=True)
class Tree:
    """``regions[i][j]`` lists the (shard, weight) leaves of rack j of region i."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> Tree:
        number = iter(range(regions * racks * shards))
        return Tree(tuple(tuple(tuple((next(number), 1.0) for _ in range(shards)) for _ in range(racks)) for _ in range(regions)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, numbered after all others, in a region and rack of its own."""
        return Tree((*self.regions, ((((self.shards()), weight),),)))

    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _draw(weight: float, *path: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(*path), 11).cast("double")
    return -F.log((bits + 0.5) * F.lit(2.0**-53)) / F.lit(weight)


def _choose(weights: list[float], *path: Column) -> Column:
    """The index of the child with the smallest draw; the lower index on a tie."""
    if len(weights) == 1:
        return F.lit(0)
    return F.array_min(F.array(*(F.struct(_draw(w, *path, F.lit(i)).alias("draw"), F.lit(i).alias("child")) for i, w in enumerate(weights) if w > 0)))["child"]


def _by_case(on: Column, cases: list[Column]) -> Column:
    """cases[i] where ``on`` is i; equal cases share a branch."""
    out = cases[-1]
    for i in reversed(range(len(cases) - 1)):
        out = F.when(on == i, cases[i]).otherwise(out)
    return out


def place(df: DataFrame, tree: Tree, key: str, prefix: str) -> DataFrame:
    """Adds <prefix>region, <prefix>rack and <prefix>shard, decided by the key's value and the tree.

    A null key is a value like any other.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    weight = [[sum(w for _, w in rack) for rack in region] for region in tree.regions]
    region, rack = F.col(f"{prefix}region"), F.col(f"{prefix}rack")
    df = df.withColumn(f"{prefix}region", _choose([sum(x) for x in weight], k, F.lit("region")))
    shapes = sorted({tuple(x) for x in weight})
    chosen = {s: _choose(list(s), k, F.lit("rack"), region) for s in shapes}
    df = df.withColumn(f"{prefix}rack", _by_case(region, [chosen[tuple(x)] for x in weight]) if len(shapes) > 1 else chosen[shapes[0]])
    flat = [(i, j, leaves) for i, r in enumerate(tree.regions) for j, leaves in enumerate(r)]
    widest = max(len(r) for r in tree.regions)
    shapes = sorted({tuple(w for _, w in leaves) for _, _, leaves in flat})
    chosen = {s: _choose(list(s), k, F.lit("shard"), region, rack) for s in shapes}
    at = region * widest + rack
    slots: list[Column] = [F.lit(0)] * (widest * len(tree.regions))
    names: list[Column] = [F.array(F.lit(-1))] * len(slots)
    for i, j, leaves in flat:
        slots[i * widest + j] = chosen[tuple(w for _, w in leaves)]
        names[i * widest + j] = F.array(*(F.lit(n) for n, _ in leaves))
    df = df.withColumn(f"{prefix}leaf", _by_case(at, slots) if len(shapes) > 1 else chosen[shapes[0]])
    table = F.array(*names)
    return df.withColumn(f"{prefix}shard", F.get(F.get(table, at), F.col(f"{prefix}leaf")).cast("int")).drop(f"{prefix}leaf")


def shard(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """Places every row and numbers the rows of each shard without gaps.

    Law ``key``: the id and the tree decide alone. Returns key, size (UTF-8 bytes and 16), text_crc32,
    law, shard, slot, grown_shard (in the tree with one more shard), region and rack.

    Null or empty text: 16 bytes, checksum 0. Null ids share a shard. Rows that are equal in id and
    text are merged before any shuffle, numbered as a run and expanded again, so that repeated rows
    make no hot task: where there are more than ``run`` equal ones, they are dealt over tasks by runs
    of so many. The text itself is never shuffled. An empty table gives no rows. Other columns
    of the input are ignored, whatever their names.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n_same"))
    groups = max(1, min(MOST_GROUPS, shuffle_partitions(spark)))
    rows = place(place(rows, tree, "doc_id", ""), tree.grown(), "doc_id", "grown_")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("text_crc32", "size", "doc_id"), F.lit(groups)).cast("int"))
    rows = checkpoint(rows.drop("grown_region", "grown_rack"))  # small, and read twice
    upto = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").agg(F.sum("n_same").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("at", F.coalesce(F.sum("n_same").over(upto), F.lit(0))).join(starts, ["shard", "part"])
    numbered = numbered.withColumn("first", F.col("start") + F.col("at")).withColumn("last", F.col("first") + F.col("n_same") - 1)
    if (rows.agg(F.max("n_same")).first()[0] or 0) > run:
        begins = F.explode(F.sequence("first", "last", F.lit(run).cast("long")))
        numbered = numbered.withColumn("first", begins).withColumn("last", F.least("last", F.col("first") + run - 1)).repartition("shard", "first")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence("first", "last")).alias("slot"), "grown_shard", "region", "rack")
