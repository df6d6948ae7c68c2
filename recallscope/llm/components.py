"""Connected components of an edge table by alternating stars.

Each round joins every node with the least neighbour it knows (large star),
then re-hangs the nodes of smaller ids (small star). The number of rounds grows
with the logarithm of the largest component; every round is written to the
checkpoint folder, so lineage stays short and a lost executor costs one round.
Least neighbours are aggregates (combined map-side), so a hub with very many
neighbours is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallscope.llm.stages import materialize

ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; the component's name is its
    least node. Self-loops, repeated edges and null ends are ignored; an empty
    table gives an empty result."""
    pairs = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    pairs = materialize(pairs)
    seen = _mark(pairs)
    for _ in range(ROUNDS):
        pairs = materialize(_small_star(_large_star(pairs)))
        mark = _mark(pairs)
        if mark == seen:
            return (pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
        seen = mark
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def _mark(pairs: DataFrame):
    """A digest of the edge set (one row)."""
    return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[:]


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined with the least node around it."""
    around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())


def _small_star(pairs: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and itself, are joined with the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    hung = pairs.join(least, "u")
    return (hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
