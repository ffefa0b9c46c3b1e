"""The transition log and the streaming fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runlog as R
from ..session import scratch_path
from ..streaming.runfold import run_fold_stream
from . import actions as A
from . import runs as RN
from .registry import register, table

RECORDED_SQL = """
CASE WHEN f.tool = 'preview_sql' THEN '[' || f.props || ']'
     WHEN f.k % 11 = 5 THEN 'ValueError: ' || repeat(f.event_type || ' refused; ', 90)
     ELSE f.event_type || ' done: ' || f.props END"""
TRANSITION_SQL = f"""
WITH {A.GRADE_CTES},
m AS (SELECT run_id, 'el_success' AS metric, CASE WHEN el_succeeded THEN 1.0 ELSE 0.0 END AS value FROM gr WHERE submitted
      UNION ALL SELECT run_id, 'raw_fraction', raw_fraction FROM gr WHERE submitted
      UNION ALL SELECT run_id, 'submitted', CASE WHEN submitted THEN 1.0 ELSE 0.0 END FROM gr
      UNION ALL SELECT pt.run_id, 'target/' || pt.table_name, pt.score FROM pt JOIN gr USING (run_id)
        WHERE gr.submitted AND gr.el_succeeded AND gr.raw_fraction = 1.0
      UNION ALL SELECT run_id, 'target_fraction', graded_fraction FROM gr
        WHERE submitted AND el_succeeded AND raw_fraction = 1.0),
mm AS (SELECT run_id, string_agg(metric || '=' || printf('%.4f', value), ',' ORDER BY metric) AS metrics
       FROM m GROUP BY run_id),
fe AS (SELECT f.*, e.props, e.event_type, CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k
       FROM f JOIN events e USING (event_id))
SELECT f.run_id, f.event_id, f.tool,
  CASE WHEN f.tool = 'submit_pipeline' THEN NULL WHEN f.tool <> 'preview_sql' AND f.k % 11 = 5
       THEN substr({RECORDED_SQL}, 1, 1200) ELSE {RECORDED_SQL} END AS observation,
  f.tool = 'submit_pipeline' AS done,
  CASE WHEN f.tool = 'submit_pipeline' THEN gr.reward ELSE 0.0 END AS reward,
  CASE WHEN f.tool = 'submit_pipeline' THEN mm.metrics END AS metrics
FROM fe f JOIN gr ON f.run_id = gr.run_id LEFT JOIN mm ON f.run_id = mm.run_id"""


def recorded_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action log with what each call returned, as the event recorded it."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    told = events.select("event_id", "props", "event_type", k.alias("k"))
    acts = A.actions_from_events(events).join(told, "event_id")
    preview = F.col("tool") == "preview_sql"
    error = (F.col("k") % 11 == 5) & ~preview & (F.col("tool") != R.TERMINAL_TOOL)
    text = (F.when(F.col("tool") == R.TERMINAL_TOOL, F.lit(None))
            .when(preview, F.concat(F.lit("["), F.col("props"), F.lit("]")))
            .when(error, F.concat(F.lit("ValueError: "), F.repeat(F.concat("event_type", F.lit(" refused; ")), 90)))
            .otherwise(F.concat("event_type", F.lit(" done: "), "props")))
    return acts.withColumn("observation", text).withColumn("is_error", F.coalesce(error, F.lit(False)))


@register("transition_log", oracle=TRANSITION_SQL)
def transition_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-action transitions of every run up to its submit, written as JSON lines and read back."""
    es = RN.event_summaries(spark, sf_dir)
    g, per_target = A.graded(spark, sf_dir, es)
    log = R.transition_log(recorded_actions(spark, sf_dir), g, R.run_metrics(g, per_target), id_cols=("event_id",))
    path = scratch_path(spark, "transitions")
    R.write_transition_log(log, path)
    read = spark.read.schema(log.schema).json(path)
    shown = F.transform(F.array_sort(F.map_entries("metrics")),
                        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))
    return read.withColumn("metrics", F.array_join(shown, ","))


LANDINGS = 5
LANDED_DAYS, LATE_DAYS = 6, 2


def land_events(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """``events`` as the files of a log folder that arrive one after the other, out of order.

    A landing holds six days of events, but a third of them each land up to one or two days
    late, so every landing but the first brings events from before the end of the last one.
    The closing one is an event of no known run, two months on, which flushes the state.
    Returns the folder and how many files a landing has: as many as ``events`` has splits.
    """
    events = table(spark, sf_dir, "events")
    path = scratch_path(spark, "landed-events")
    start = events.agg(F.min(F.date_trunc("day", "ts"))).first()[0]
    late = F.make_dt_interval(F.col("event_id") % (LATE_DAYS + 1))
    landing = F.least(F.floor(F.datediff(F.col("ts") + late, F.lit(start)) / LANDED_DAYS), F.lit(LANDINGS - 1))
    n_files = max(1, events.rdd.getNumPartitions())
    for k in range(LANDINGS):
        events.filter(landing == k).repartition(n_files).write.mode("append").parquet(path)
    last = events.select(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.make_dt_interval(F.lit(60))).alias("ts"),
                         F.lit(None).cast("long").alias("user_id"), *[F.lit(None).cast(events.schema[c].dataType).alias(c)
                                                                      for c in ("event_type", "value", "props")])
    last.coalesce(1).write.mode("append").parquet(path)
    return path, n_files


@register("run_fold_stream", oracle=A.FOLD_SQL)
def run_fold_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run-log fold over ``events`` read as a stream of out-of-order files, with typed state per run."""
    schema = table(spark, sf_dir, "events").schema
    path, n_files = land_events(spark, sf_dir)
    # One landing a micro-batch, however many files it takes.
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", n_files).parquet(path)
    # A file may come a whole landing late at most, and an event two days more.
    state = run_fold_stream(spark, A.actions_from_events(events), A.tasks_frame(spark),
                            watermark=f"{LANDED_DAYS + LATE_DAYS + 1} days", limit_seconds=1800 * A.LOG_CLOCK)
    return A.fold_columns(state)
