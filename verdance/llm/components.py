"""Connected components by alternating star contraction, in joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.llm import tables


def _hooked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) pairs with the least v of each u, as m, and the table of those.

    The minimum is aggregated on the map side, and both join inputs are plain
    shuffles, so a node with very many neighbours is split by skew handling."""
    least = tables.written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u"), least


def _settled(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: the edges are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up + down > 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge; the component is its least node.

    Each round moves all larger neighbours of a node, then all smaller ones, to
    the least node it sees, until stars are left; edges never grow in number, and
    rounds grow with the logarithm of the longest path.  Nulls and loops are left
    out.  The result is a written table; the tables of the rounds are dropped."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = tables.written(e, "edges")
    for _ in range(rounds):
        if _settled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked, seen = _hooked(both)
        large = hooked.select("v", F.least("u", "m").alias("m")).where("v > m")
        # (v, m): every neighbour points at the least node around its centre
        large = tables.written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        hooked, least = _hooked(large)
        small = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hooked.select("u", F.col("m").alias("v")))
        moved = tables.written(small.where("u > v").distinct(), "edges")
        tables.drop(e, seen, large, least)
        e = moved
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = tables.written(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root), "found")
    tables.drop(e)
    return found
