"""Exact deduplication by a content sort.

Texts are equal when identical after deleting every character of
``[\\x20\\x09-\\x0D]``; null counts as empty.  The normalised texts themselves are
the sort key: Spark samples splitters and range-partitions the rows by content, by
the first ``SPLITTER`` characters and then a hash, so that sampled splitters stay short
and texts with a common beginning still spread over ranges.  Each range is sorted
externally (spilling to disk), whole texts last in the key, and a window compares whole
neighbouring texts, so no verdict rests on a hash.

Hot texts.  A text with more than ``1 / HOT_SHARE`` of all rows would fill one
range.  There are fewer than ``HOT_SHARE`` such texts whatever the input, so the
list of their 64-bit hashes is broadcast, and their rows get a salt as second sort
key.  Each (text, salt) run is settled in its own range; the leaders of a hot
text's runs (at most one per salt) are then sorted and compared by content again.
A cold text that shares a hash with a hot one is merely salted as well.

Defined cases: null text counts as empty and all empty texts are one group; a null
id sorts after all others; of rows equal in text, length and id one (any) stays; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_rows, written

WHITE_SPACE = r"[\x20\x09-\x0D]+"
HOT_SHARE = 4096
SPLITTER = 24


def normalised(col):
    return F.regexp_replace(col, WHITE_SPACE, "")


def exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, text_sha256, keep_id, group_size, kept."""
    spark = df.sparkSession
    rows = text_rows(df, id_col, text_col).select(
        "doc_id", normalised(F.col("text")).alias("norm"), F.char_length("text").alias("n_chars"))
    total = df.count()
    hot = (rows.groupBy(F.xxhash64("norm").alias("norm_hash")).agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") * HOT_SHARE > F.lit(total)).select("norm_hash"))
    salts = max(64, shuffle_partitions(spark))
    salted = (rows.withColumn("norm_hash", F.xxhash64("norm"))
              .join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "norm_hash", "left")
              .withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(salts)))
                          .otherwise(F.lit(-1)))
              .select("doc_id", "n_chars", "norm", "salt", "norm_hash", F.substring("norm", 1, SPLITTER).alias("lead")))
    order = [F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last()]
    # the range keys are among the window's, so the ranges serve the window without another shuffle
    run = Window.partitionBy("lead", "norm_hash", "norm", "salt").orderBy(*order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    settled = (salted.repartitionByRange("lead", "norm_hash", "salt")
               .select("doc_id", "n_chars", "norm", "salt",
                       F.row_number().over(run).alias("place"),
                       F.first("doc_id").over(whole).alias("leader"),
                       F.count(F.lit(1)).over(whole).alias("size"))
               .select("doc_id", "n_chars", "salt", "place", "leader", "size",
                       F.sha2("norm", 256).alias("text_sha256"),
                       F.when((F.col("salt") >= 0) & (F.col("place") == 1), F.col("norm")).alias("norm")))
    settled = written(settled, "content-sort")
    cold = settled.filter("salt < 0").select(
        "doc_id", "n_chars", "text_sha256", F.col("leader").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("place") == 1).alias("kept"))
    again = Window.partitionBy("lead", "text_sha256", "norm").orderBy(*order, "salt").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    leaders = (settled.filter("salt >= 0 and place = 1").withColumn("lead", F.substring("norm", 1, SPLITTER))
               .repartitionByRange("lead", "text_sha256")
               .select("text_sha256", "salt",
                       F.first("doc_id").over(again).alias("keep_id"),
                       F.first("salt").over(again).alias("keep_salt"),
                       F.sum("size").over(again).alias("group_size")))
    warm = (settled.filter("salt >= 0").drop("norm", "leader", "size").join(leaders, ["text_sha256", "salt"])
            .select("doc_id", "n_chars", "text_sha256", "keep_id", "group_size",
                    ((F.col("place") == 1) & (F.col("salt") == F.col("keep_salt"))).alias("kept")))
    return cold.unionByName(warm)


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`exact_copies` keeps, with all their columns.

    Repeated rows (same id, normalised text and length) leave one row.
    """
    kept = exact_copies(df, id_col, text_col).filter("kept").select(
        F.coalesce(F.col("doc_id"), F.lit(-1 << 62)).alias("__id"),
        F.col("text_sha256").alias("__sha"), F.col("n_chars").alias("__n"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = (df.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 62)))
             .withColumn("__sha", F.sha2(normalised(text), 256)).withColumn("__n", F.char_length(text)))
    return (keyed.join(kept, ["__id", "__sha", "__n"], "left_semi")
            .dropDuplicates(["__id", "__sha", "__n"]).drop("__id", "__sha", "__n"))
