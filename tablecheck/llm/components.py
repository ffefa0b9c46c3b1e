"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 16))).first()
    return tuple(row)


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): label is the component's smallest node.

    A large-star step ties each node's greater neighbours to its smallest one, a
    small-star step ties the smaller ones; both replace the edges, which end as one
    star per component.  Minima are combined before the shuffle, joins on a hub are
    left to adaptive skew splitting, every round is a written table, and no component
    is ever gathered.
    """
    def step(found: DataFrame) -> DataFrame:
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # every edge now points down: u > v
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        return (large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
            .filter("u <> v").distinct())

    current = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                          .filter("u <> v").distinct(), "edges")
    before = _checksum(current)
    for _ in range(most_rounds):
        current = written(step(current), "stars")
        now = _checksum(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    labels = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return labels.unionByName(roots)
