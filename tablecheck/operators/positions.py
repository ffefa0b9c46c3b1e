"""Row positions after a total sort, without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row to one task.  Here the
rows are range-partitioned on the sort key (the same exchange ``orderBy`` uses) with
a unique row id as its last part, so that equal rows, however many, spread over
ranges too; numbered inside each partition; written to the shared scratch folder so
that the numbering is fixed; and shifted by the row counts of the earlier partitions
of the same group, one small row per (partition, group).  The same path serves every
size.

Grouped positions (``group_cols``) restart at 0 for every group; a group with a
third of all rows is still spread over many range partitions because the sort
key, not the group, decides where a row goes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

LOCAL_BITS = 33
_LOCAL_MASK = (1 << LOCAL_BITS) - 1


def with_positions(df: DataFrame, order: Sequence[Column], group_cols: Sequence[str] = (),
                   pos_col: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Return ``df`` plus a 0-based BIGINT ``pos_col`` following ``order`` within each group.

    Rows that are equal under ``order`` are numbered in any order.  The result reads a
    written table, so later jobs see the same numbering even if executors are lost.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc_nulls_last() for g in group_cols] + list(order) + [F.col("_tie").asc()]
    ranged = (df.withColumn("_tie", F.monotonically_increasing_id())
              .repartitionByRange(n, *keys)
              .sortWithinPartitions(*keys)
              .drop("_tie")
              .withColumn("_mid", F.monotonically_increasing_id()))
    path = scratch_path(spark, "positions")
    ranged.write.mode("overwrite").parquet(path)
    fixed = spark.read.parquet(path)
    fixed = (fixed.withColumn("_part", F.shiftright(F.col("_mid"), LOCAL_BITS))
             .withColumn("_local", F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK))))

    stats = fixed.groupBy("_part", *group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    on = ["_part", *group_cols]
    joined = fixed.join(offsets, on=on, how="inner") if not group_cols else \
        fixed.join(offsets, on=[fixed[c].eqNullSafe(offsets[c]) for c in on], how="inner") \
             .drop(*[offsets[c] for c in on])
    return (joined.withColumn(pos_col, F.col("_offset") + F.col("_local") - F.col("_first"))
            .drop("_mid", "_part", "_local", "_first", "_offset"))
