"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a uniform number u from a 64-bit hash; the record goes
to the shard with the greatest ``-weight / ln(u)``.  A shard's scores do not depend
on the other shards, so a further shard takes records only into itself, and a
removed one gives up only its own: about ``weight / total`` of the records move.
Places inside a shard come from written rows numbered per (partition, shard) plus
per-partition offsets, so no shard is ever gathered in one task.

Defined cases: a null key is a key of its own (all such rows share a shard); rows
with equal keys share a shard; null text has no bytes; weights must be positive;
empty tables give an empty result; other columns are kept by :func:`assign_shards`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_rows


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard (0 to ``len(weights) - 1``) that wins ``key``."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(shard)), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(shard).alias("shard"))

    scores = [score(i, w) for i, w in enumerate(weights)]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"].cast("int")


def assign_shards(df: DataFrame, key: Column, weights: Sequence[float], shard_col: str = "shard",
                  seed: int = 0) -> DataFrame:
    return df.withColumn(shard_col, rendezvous(key, weights, seed))


def number_in_shards(df: DataFrame, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Add gapless places from 0 in each shard.

    The rows are written with their partition and place in it, so that a task that
    runs again cannot renumber them.
    """
    rows = materialize(df.withColumn("__part", F.spark_partition_id())
                       .withColumn("__seq", F.monotonically_increasing_id()), "shard-rows")
    here = Window.partitionBy("__part", shard_col)
    before = Window.partitionBy(shard_col).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("__part", shard_col).agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    return (rows.withColumn("__place", F.row_number().over(here.orderBy("__seq")))
            .join(offsets, ["__part", shard_col])
            .withColumn(slot_col, (F.col("__before") + F.col("__place") - 1).cast("long"))
            .drop("__part", "__seq", "__before", "__place"))


def write_shards(df: DataFrame, path: str, key: Column, weights: Sequence[float], shard_col: str = "shard") -> None:
    """Write ``df`` as Parquet, one folder per shard (each task adds its own file to every shard)."""
    assign_shards(df, key, weights, shard_col).write.mode("errorifexists").partitionBy(shard_col).parquet(path)


def shard_documents(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the ``key`` law."""
    rows = text_rows(df, id_col, text_col).select(
        "doc_id", (F.octet_length("text").cast("long") + 1).alias("size"),
        F.crc32("text").alias("text_crc32"), F.lit("key").alias("law"))
    key = F.col("doc_id")
    rows = assign_shards(rows, key, [1.0] * shards)
    rows = assign_shards(rows, key, [1.0] * (shards + 1), "grown_shard")
    return number_in_shards(rows)
