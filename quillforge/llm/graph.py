"""Connected components of edge tables, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, cut


def _with_least(pairs: DataFrame, written: Written) -> DataFrame:
    """(u, v, m): each pair with the least of u and all its v.

    The least values are summed up first and written, so that the join has two plain exchanges and adaptive execution
    can split the hub of a large component; where they are few, Spark sees it and broadcasts them.
    """
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _state(edges: DataFrame) -> tuple:
    x = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(x), F.sum((x % 1_000_003).cast("bigint"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of `edges` (u, v), root being the least node of the component.

    Nodes may be of any type with an order. Rounds grow with the logarithm of the longest path; each is written to the
    shared folder and goes when the next ones are there. Loops and null ends are ignored; an edge table without rows
    gives none.
    """
    written = Written(edges.sparkSession)
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        large = _with_least(both, written).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large, written)
        small = small.select("u", F.col("m").alias("w")).union(small.select(F.col("v"), F.col("m")).toDF("u", "w"))
        edges = written(small.where("u <> w").select("u", F.col("w").alias("v")).distinct())
        after = _state(edges)
        written.drop(keep=1)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = cut(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots))
    written.drop()
    return out
