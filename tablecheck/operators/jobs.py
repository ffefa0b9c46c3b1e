"""Sync-job status rollup: from polled status observations to one exit code per run.

Input ``observations``: ``(run_id, connection_id, job_id, status, ts)``, one row per
poll.  A job's outcome is its first terminal status seen by the deadline; the run's
code is 2 without connections, 3 if any job had no terminal status by the deadline,
0 if every job succeeded, else 4.  All steps are grouped aggregates (map-side
partial aggregation), so a run with many jobs is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_status

# Statuses after which a job is no longer polled.
TERMINAL_STATUSES = ("succeeded", "failed", "cancelled", "canceled", "incomplete")


def job_outcomes(observations: DataFrame, deadline) -> DataFrame:
    """``(run_id, connection_id, job_id, outcome)``; outcome NULL when unfinished."""
    obs = observations.withColumn("status", normalize_status(F.col("status")))
    terminal = F.col("status").isin(*TERMINAL_STATUSES) & (F.col("ts") <= F.lit(deadline))
    return obs.groupBy("run_id", "connection_id", "job_id").agg(
        F.min_by(F.when(terminal, F.col("status")), F.when(terminal, F.col("ts"))).alias("outcome"))


def rollup(outcomes: DataFrame, connections: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """``(run_id, n_connections, n_succeeded, n_failed, n_unfinished, exit_code)``.

    ``connections`` ``(run_id, connection_id)``: every configured connection; one whose
    job never reported is unfinished (an equi-join on both keys).  ``runs``: runs
    with no connection at all get code 2.
    """
    if connections is not None:
        outcomes = connections.select("run_id", "connection_id").distinct().join(
            outcomes, ["run_id", "connection_id"], "left")
    per_run = outcomes.groupBy("run_id").agg(
        F.countDistinct("connection_id").alias("n_connections"),
        F.count(F.when(F.col("outcome") == "succeeded", 1)).alias("n_succeeded"),
        F.count(F.when(F.col("outcome").isNotNull() & (F.col("outcome") != "succeeded"), 1)).alias("n_failed"),
        F.count(F.when(F.col("outcome").isNull(), 1)).alias("n_unfinished"))
    if runs is not None:
        per_run = runs.select("run_id").join(per_run, "run_id", "left").na.fill(
            0, ["n_connections", "n_succeeded", "n_failed", "n_unfinished"])
    code = (F.when(F.col("n_connections") == 0, F.lit(2))
            .when(F.col("n_unfinished") > 0, F.lit(3))
            .when(F.col("n_failed") == 0, F.lit(0))
            .otherwise(F.lit(4)))
    return per_run.select("run_id", *[F.col(c).cast("long").alias(c) for c in
                                      ("n_connections", "n_succeeded", "n_failed", "n_unfinished")],
                          code.cast("int").alias("exit_code"))
