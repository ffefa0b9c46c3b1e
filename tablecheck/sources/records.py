"""JSON sources: landed API records and nested expectation documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS_TYPE = "map<string,map<string,bigint>>"
KEYS_TYPE = "map<string,map<string,array<string>>>"


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines records read with a declared schema (no inference pass); a malformed
    line fails the read instead of becoming a row of NULLs."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def explode_expectations(docs: DataFrame, col: str, known_tasks: DataFrame | None = None) -> DataFrame:
    """``{task: {table: n}}`` documents to rows ``(task_id, table_name, expected BIGINT)``.

    A task absent from ``known_tasks`` fails the job (a left join against the task list,
    unhinted: adaptive execution broadcasts it only when its measured size is small).
    """
    parsed = docs.select(F.explode(F.from_json(F.col(col), COUNTS_TYPE)).alias("task_id", "tables"))
    rows = parsed.select("task_id", F.explode("tables").alias("table_name", "expected"))
    rows = rows.select("task_id", "table_name", F.col("expected").cast("long").alias("expected"))
    if known_tasks is not None:
        known = known_tasks.select("task_id", F.lit(True).alias("known")).distinct()
        unknown = F.raise_error(F.concat(F.lit("expectations for an unknown task: "), F.col("task_id")))
        rows = (rows.join(known, "task_id", "left")
                .withColumn("task_id", F.when(F.col("known"), F.col("task_id")).otherwise(unknown.cast("string")))
                .drop("known"))
    return rows


def explode_sort_keys(docs: DataFrame, col: str) -> DataFrame:
    """``{task: {table: [column, ...]}}`` to ``(task_id, table_name, keys ARRAY<STRING>)``."""
    parsed = docs.select(F.explode(F.from_json(F.col(col), KEYS_TYPE)).alias("task_id", "tables"))
    return parsed.select("task_id", F.explode("tables").alias("table_name", "keys"))

