"""Source routing: which connection and provider each selected table is read through.

Configuration rows say what a run may read: ``api`` ``(run_id, table_name)`` lists the
tables of its API source, ``files`` ``(run_id, table_name, format, path)`` its files.  All
API tables of a run share the connection ``api``; a file has a connection of its own,
named after its table, and a table in both lists is read through both.  A table that no
row covers, a file of another format, and a path that is neither local nor HTTPS are
refused with a reason, as rows rather than as a failure of the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Provider names, accepted path starts, file format and sync mode.
API_CONNECTION, API_PROVIDER = "api", "custom_api"
FILE_PROVIDERS = (("/local/", "local_filesystem_limited"), ("https://", "https_public_web"))
FILE_FORMAT = "csv"
SYNC_MODE = "full_refresh_overwrite"

KEYS = ["run_id", "table_name"]


def route_sources(selected: DataFrame, api: DataFrame, files: DataFrame) -> DataFrame:
    """``(run_id, table_name, connection, provider, refused)``, one row per selected table and
    source; ``connection`` and ``provider`` are NULL exactly where ``refused`` has a reason."""
    wanted = selected.select(*KEYS).distinct()
    through_api = wanted.join(api.select(*KEYS).distinct(), KEYS, "left_semi").select(
        *KEYS, F.lit(API_CONNECTION).alias("connection"), F.lit(API_PROVIDER).alias("provider"),
        F.lit(None).cast("string").alias("refused"))
    provider = F.coalesce(*[F.when(F.col("path").startswith(start), F.lit(name)) for start, name in FILE_PROVIDERS])
    filed = wanted.join(files.select(*KEYS, "format", "path"), KEYS).withColumn(
        "refused", F.when(~F.col("format").eqNullSafe(FILE_FORMAT), F.lit("format"))
        .when(provider.isNull(), F.lit("path")))
    through_file = filed.select(
        *KEYS, F.when(F.col("refused").isNull(), F.col("table_name")).alias("connection"),
        F.when(F.col("refused").isNull(), provider).alias("provider"), "refused")
    covered = api.select(*KEYS).unionByName(files.select(*KEYS)).distinct()
    uncovered = wanted.join(covered, KEYS, "left_anti").select(
        *KEYS, F.lit(None).cast("string").alias("connection"), F.lit(None).cast("string").alias("provider"),
        F.lit("no_source").alias("refused"))
    return through_api.unionByName(through_file).unionByName(uncovered)


def connections(routes: DataFrame) -> DataFrame:
    """``(run_id, connection, provider, streams, sync_mode)``: the accepted routes by connection,
    streams sorted by name.  A run with any refused table gets no connection at all."""
    refused = routes.where(F.col("refused").isNotNull()).select("run_id").distinct()
    return (routes.join(refused, "run_id", "left_anti").groupBy("run_id", "connection", "provider")
            .agg(F.sort_array(F.collect_set("table_name")).alias("streams"))
            .withColumn("sync_mode", F.lit(SYNC_MODE)))
