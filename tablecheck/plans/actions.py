"""Queries over ``events`` read as the tool-call log of many pipeline runs.

Mapping (fixed for the tests): run = ``user_id``; order = ``ts``; turn = ``event_id``
(one call a turn); the log's clock runs 240 times as fast as a run's; tool by event type
(signup -> configure_el, view -> write_model, click -> run_transforms,
purchase -> submit_pipeline, error -> preview_sql); arguments from ``props.k``:
configure_el tables by ``k % 4`` (both declared, one, both with a duplicate, one
undeclared), write_model target by ``k % 3`` (two declared targets, one unknown),
SQL text with a semicolon when ``k % 7 = 3``.  Tasks 10 to 14 are official ones: there an
error with even k is a run_el, which failed when ``k % 11 = 5``.  Every task declares the sources
``customers, orders`` and the targets ``daily_activity, type_summary``; produced
tables are scored by :mod:`runs` batch grading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import runlog as R
from ..operators.guard import undeclared
from ..session import materialize_all
from . import runs as RN
from . import sqltext as S
from .registry import register, table

DECLARED = ("customers", "orders")
TARGETS = ("daily_activity", "type_summary")
LOG_CLOCK = 240
OFFICIAL_FROM = 10


def actions_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions_from_events(table(spark, sf_dir, "events"))


def actions_from_events(e: DataFrame) -> DataFrame:
    """Tool calls derived from event rows (works on a batch or a streaming frame)."""
    k = F.get_json_object("props", "$.k").cast("int")
    tool = (F.when(F.col("event_type") == "signup", "configure_el")
            .when(F.col("event_type") == "view", "write_model")
            .when(F.col("event_type") == "click", "run_transforms")
            .when(F.col("event_type") == "purchase", "submit_pipeline")
            .when(F.col("event_type") == "error", F.when((F.col("user_id") % RN.N_TASKS >= OFFICIAL_FROM) & (k % 2 == 0), "run_el")
                  .otherwise("preview_sql")))
    tables = F.when(tool == "configure_el",
                    F.when(k % 4 == 0, F.array(F.lit("customers"), F.lit("orders")))
                    .when(k % 4 == 1, F.array(F.lit("customers")))
                    .when(k % 4 == 2, F.array(F.lit("orders"), F.lit("customers"), F.lit("orders")))
                    .otherwise(F.array(F.lit("customers"), F.lit("returns"))))
    model = F.when(tool == "write_model",
                   F.when(k % 3 == 0, "daily_activity").when(k % 3 == 1, "type_summary").otherwise("unknown_model"))
    sql = F.when(tool.isin("write_model", "preview_sql"),
                 F.when(k % 7 == 3, F.concat(F.lit("SELECT "), k.cast("string"), F.lit("; DROP TABLE x")))
                 .otherwise(F.concat(F.lit("select * from events where k = "), k.cast("string"))))
    return e.select("event_id", F.col("user_id").alias("run_id"), RN.task_of(F.col("user_id")).alias("task_id"),
                    "ts", F.col("event_id").alias("turn"), tool.alias("tool"), tables.alias("tables"), model.alias("model"), sql.alias("sql"),
                    ((tool == "run_el") & (k % 11 == 5)).alias("failed"))


def tasks_frame(spark: SparkSession) -> DataFrame:
    """The tasks that the mapping fixes (no scan: runs name them)."""
    names = lambda values: F.array(*[F.lit(t) for t in values])
    return spark.range(RN.N_TASKS).select(RN.task_of(F.col("id")).alias("task_id"), names(DECLARED).alias("declared"),
                                          names(TARGETS).alias("targets"), (F.col("id") >= OFFICIAL_FROM).alias("official"))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fold_runs(actions_frame(spark, sf_dir), tasks_frame(spark))


def graded(spark: SparkSession, sf_dir: str, es: RN.EventSummaries | None = None):
    """Graded runs and their per-target scores.

    The run fold (one row per run) and the batch scores (one row per run and target)
    are written once to the shared checkpoint folder: rewards, metrics, group means
    and the transition log each read them in several branches, which would otherwise
    replay every log and grade every table once per branch.
    """
    es = es or RN.event_summaries(spark, sf_dir)
    tasks = tasks_frame(spark)
    out = materialize_all({"batch-scores": lambda: RN.batch_scores(spark, sf_dir, es),
                           "run-fold": lambda: R.fold_runs(actions_frame(spark, sf_dir), tasks)})
    return R.grade_runs(out["run-fold"], tasks, out["batch-scores"], RN.source_counts(es))


# ---------------------------------------------------------------- oracle SQL pieces

ACTIONS_SQL = f"""
SELECT event_id, user_id AS run_id, {RN.TASK_SQL} AS task_id, ts, event_id AS turn, tool,
  CASE WHEN tool = 'configure_el' THEN CASE k % 4 WHEN 0 THEN ['customers', 'orders'] WHEN 1 THEN ['customers']
       WHEN 2 THEN ['orders', 'customers', 'orders'] ELSE ['customers', 'returns'] END END AS tables,
  CASE WHEN tool = 'write_model' THEN CASE k % 3 WHEN 0 THEN 'daily_activity' WHEN 1 THEN 'type_summary'
       ELSE 'unknown_model' END END AS model,
  CASE WHEN tool IN ('write_model', 'preview_sql') THEN CASE WHEN k % 7 = 3
       THEN 'SELECT ' || CAST(k AS VARCHAR) || '; DROP TABLE x'
       ELSE 'select * from events where k = ' || CAST(k AS VARCHAR) END END AS sql,
  user_id % 15 >= {OFFICIAL_FROM} AS official, tool = 'run_el' AND k % 11 = 5 AS failed
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        CASE event_type WHEN 'signup' THEN 'configure_el' WHEN 'view' THEN 'write_model'
          WHEN 'click' THEN 'run_transforms' WHEN 'purchase' THEN 'submit_pipeline'
          WHEN 'error' THEN CASE WHEN user_id % 15 >= {OFFICIAL_FROM} AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0
            THEN 'run_el' ELSE 'preview_sql' END END AS tool FROM events)"""

SELECT_OK_SQL = (f"({S.strip('sql')} <> '' AND strpos({S.strip('sql')}, ';') = 0 AND "
                 f"regexp_matches({S.strip('sql')}, '^(?i:select|with)([^\\pL\\pN_]|$)'))")

FOLD_CTES = f"""
a AS ({ACTIONS_SQL}),
sub AS (SELECT run_id, min(ts) AS submit_ts FROM a WHERE tool = 'submit_pipeline' GROUP BY run_id),
f AS (SELECT a.*,
        tool = 'configure_el' AND len(tables) > 0
          AND list_has_all(['customers', 'orders'], tables) AS cfg,
        coalesce(list_has_all(tables, ['customers', 'orders']), FALSE) AS covers,
        coalesce(tool = 'write_model' AND model IN ('daily_activity', 'type_summary') AND {SELECT_OK_SQL}, FALSE) AS wm
      FROM a LEFT JOIN sub USING (run_id) WHERE sub.submit_ts IS NULL OR a.ts <= sub.submit_ts),
st AS (SELECT run_id, task_id, bool_or(tool = 'submit_pipeline') AS submitted, count(*) AS n_calls,
         count(DISTINCT turn) AS n_turns, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS elapsed_s,
         coalesce(arg_max(covers, ts) FILTER (WHERE cfg AND NOT official), FALSE)
           OR coalesce(bool_or(tool = 'run_el' AND NOT failed), FALSE) AS el_succeeded,
         max(ts) FILTER (WHERE tool = 'run_el' AND NOT failed) AS last_el,
         max(ts) FILTER (WHERE tool = 'run_transforms') AS last_tr
       FROM f GROUP BY run_id, task_id),
ld AS (SELECT run_id, list_sort(list(DISTINCT t)) AS loaded
       FROM (SELECT run_id, unnest(tables) AS t FROM f LEFT JOIN (SELECT run_id, last_el FROM st) USING (run_id)
             WHERE cfg AND (NOT official OR ts < last_el)) GROUP BY run_id),
wr AS (SELECT run_id, model, min(ts) AS fw, arg_max(sql, ts) AS sql FROM f WHERE wm GROUP BY run_id, model),
md AS (SELECT wr.run_id, string_agg(wr.model || ': ' || wr.sql, ' | ' ORDER BY wr.fw) AS models,
         list_sort(list(wr.model) FILTER (WHERE st.last_tr > wr.fw)) AS materialized
       FROM wr JOIN st USING (run_id) GROUP BY wr.run_id),
fold AS (SELECT st.run_id, st.task_id, st.submitted, st.n_calls, st.n_turns, st.elapsed_s, st.el_succeeded,
           coalesce(ld.loaded, []) AS loaded, CAST(2 AS BIGINT) AS n_declared,
           coalesce(md.models, '') AS models, st.last_tr IS NOT NULL AS transform_ran,
           coalesce(md.materialized, []) AS materialized
         FROM st LEFT JOIN ld USING (run_id) LEFT JOIN md USING (run_id))"""
FOLD_SQL = f"""
WITH {FOLD_CTES}
SELECT run_id, task_id, submitted, n_calls, n_turns, round(elapsed_s, 3) AS elapsed_s, el_succeeded,
       array_to_string(loaded, ',') AS loaded, n_declared, models, transform_ran,
       coalesce(array_to_string(materialized, ','), '') AS materialized FROM fold"""

GRADE_CTES = f"""{FOLD_CTES},
ct AS ({RN.SOURCE_COUNTS_SQL}),
rf AS (SELECT fold.run_id, count(*) FILTER (WHERE list_contains(fold.loaded, ct.table_name) AND ct.expected = ct.actual)
         / 2.0 AS raw_fraction FROM fold LEFT JOIN ct ON ct.run_id = fold.run_id GROUP BY fold.run_id),
bs AS ({RN.BATCH_SQL}),
pt AS (SELECT fold.run_id, t.table_name,
         CASE WHEN list_contains(fold.materialized, t.table_name) THEN coalesce(bs.score, 0.0) ELSE 0.0 END AS score
       FROM fold CROSS JOIN (VALUES ('daily_activity'), ('type_summary')) t(table_name)
       LEFT JOIN bs ON bs.run_id = fold.run_id AND bs.table_name = t.table_name),
tf AS (SELECT run_id, sum(score) / greatest(count(*), 1) AS target_fraction FROM pt GROUP BY run_id),
gr AS (SELECT fold.*, rf.raw_fraction, CASE WHEN fold.submitted AND fold.el_succeeded AND rf.raw_fraction = 1.0
                          THEN coalesce(tf.target_fraction, 0.0) END AS graded_fraction,
         CAST(CASE WHEN NOT fold.submitted THEN 0.0
              WHEN NOT (fold.el_succeeded AND rf.raw_fraction = 1.0)
                THEN CASE WHEN fold.el_succeeded THEN 0.2 * rf.raw_fraction ELSE 0.0 END
              WHEN fold.transform_ran THEN round(0.2 + 0.8 * coalesce(tf.target_fraction, 0.0), 6)
              ELSE 0.2 END AS DOUBLE) AS reward
       FROM fold JOIN rf USING (run_id) LEFT JOIN tf USING (run_id))"""


def fold_columns(state: DataFrame) -> DataFrame:
    """A folded state as flat columns: names and model texts joined in order."""
    return state.select(
        "run_id", "task_id", "submitted", F.col("n_calls").cast("long").alias("n_calls"),
        F.col("n_turns").cast("long").alias("n_turns"), F.round("elapsed_s", 3).alias("elapsed_s"), "el_succeeded",
        F.array_join("loaded", ",").alias("loaded"), "n_declared",
        F.array_join(F.transform("models", lambda m: F.concat(m["model"], F.lit(": "), m["sql"])), " | ").alias("models"),
        "transform_ran", F.array_join("materialized", ",").alias("materialized"))


@register("run_fold", oracle=FOLD_SQL)
def run_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run state after replaying each run's log up to its first submit."""
    return fold_columns(folded(spark, sf_dir))


@register("run_reward", oracle=f"WITH {GRADE_CTES} SELECT run_id, task_id, reward FROM gr")
def run_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated reward of every run: extraction gate, then 0.2 + 0.8 x mean target score."""
    g, _ = graded(spark, sf_dir)
    return g.select("run_id", "task_id", "reward")


@register("run_fractions", oracle=f"""
WITH {GRADE_CTES}
SELECT run_id, round(raw_fraction, 6) AS raw_fraction, round(graded_fraction, 6) AS target_fraction FROM gr""")
def run_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = graded(spark, sf_dir)
    return g.select("run_id", F.round("raw_fraction", 6).alias("raw_fraction"),
                    F.round("graded_fraction", 6).alias("target_fraction"))


@register("run_metrics", oracle=f"""
WITH {GRADE_CTES}
SELECT run_id, 'submitted' AS metric, CASE WHEN submitted THEN 1.0 ELSE 0.0 END AS value FROM gr
UNION ALL SELECT run_id, 'el_success', CASE WHEN el_succeeded THEN 1.0 ELSE 0.0 END FROM gr WHERE submitted
UNION ALL SELECT run_id, 'raw_fraction', round(raw_fraction, 6) FROM gr WHERE submitted
UNION ALL SELECT pt.run_id, 'target/' || pt.table_name, round(pt.score, 6) FROM pt JOIN gr USING (run_id)
  WHERE gr.submitted AND gr.el_succeeded AND gr.raw_fraction = 1.0
UNION ALL SELECT run_id, 'target_fraction', round(graded_fraction, 6) FROM gr
  WHERE submitted AND el_succeeded AND raw_fraction = 1.0""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, per_target = graded(spark, sf_dir)
    m = R.run_metrics(g, per_target)
    return m.select("run_id", "metric", F.round("value", 6).alias("value"))


@register("limit_policy", oracle=f"""
WITH {GRADE_CTES}
SELECT run_id, task_id, n_turns, n_calls, round(elapsed_s, 3) AS elapsed_s, reward,
       CASE WHEN n_turns > 12 OR n_calls > 50 OR elapsed_s > 1800 * {LOG_CLOCK} OR NOT submitted THEN 0.0
            ELSE reward END AS policy_reward FROM gr""")
def limit_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward after the turn (12), tool-call (50) and time (1800 s, on the log's clock) limits."""
    g, _ = graded(spark, sf_dir)
    out = R.limit_policy(g, max_turns=12, max_calls=50, max_seconds=1800 * LOG_CLOCK)
    return out.select("run_id", "task_id", F.col("n_turns").cast("long").alias("n_turns"),
                      F.col("n_calls").cast("long").alias("n_calls"), F.round("elapsed_s", 3).alias("elapsed_s"),
                      "reward", "policy_reward")


@register("group_advantage", oracle=f"""
WITH {GRADE_CTES}, gm AS (SELECT task_id, avg(reward) AS group_mean FROM gr GROUP BY task_id)
SELECT run_id, task_id, reward, round(group_mean, 6) AS group_mean, round(reward - group_mean, 6) AS advantage
FROM gr JOIN gm USING (task_id)""")
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward centred on the mean reward of the run's task group."""
    g, _ = graded(spark, sf_dir)
    adv = R.group_advantage(g.select("run_id", "task_id", "reward"))
    return adv.select("run_id", "task_id", "reward", F.round("group_mean", 6).alias("group_mean"), "advantage")


@register("undeclared_sources", oracle=f"""
WITH a AS ({ACTIONS_SQL})
SELECT DISTINCT run_id, t AS table_name FROM (SELECT run_id, unnest(tables) AS t FROM a WHERE tool = 'configure_el')
WHERE t NOT IN ('customers', 'orders')""")
def undeclared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected source tables that the run's task does not declare (anti-join)."""
    acts = actions_frame(spark, sf_dir).where(F.col("tool") == "configure_el")
    selected = acts.select("run_id", "task_id", F.explode("tables").alias("table_name")).distinct()
    declared = tasks_frame(spark).select("task_id", F.explode("declared").alias("table_name"))
    return undeclared(selected, declared, ["task_id"]).select("run_id", "table_name")


@register("duplicate_selection", oracle=f"""
WITH a AS ({ACTIONS_SQL})
SELECT event_id, run_id, CAST(len(tables) AS BIGINT) AS n_selected,
       CAST(len(list_distinct(tables)) AS BIGINT) AS n_distinct,
       len(list_distinct(tables)) < len(tables) AS has_duplicates,
       len(tables) = 0 AS empty_selection
FROM a WHERE tool = 'configure_el'""")
def duplicate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source selection: duplicates and empty selections."""
    acts = actions_frame(spark, sf_dir).where(F.col("tool") == "configure_el")
    return acts.select("event_id", "run_id", F.size("tables").cast("long").alias("n_selected"),
                       F.size(F.array_distinct("tables")).cast("long").alias("n_distinct"),
                       (F.size(F.array_distinct("tables")) < F.size("tables")).alias("has_duplicates"),
                       (F.size("tables") == 0).alias("empty_selection"))


@register("task_summary", oracle=f"""
WITH c AS (SELECT {RN.TASK_SQL} AS task_id, count(DISTINCT user_id) AS customers, count(*) AS orders FROM events GROUP BY 1)
SELECT task_id, 'Task: ' || task_id || chr(10) || 'Destination: spark' || chr(10) ||
  'Raw tables: customers (' || customers || ' rows), orders (' || orders || ' rows)' || chr(10) ||
  'Required final models: daily_activity, type_summary' AS summary FROM c""")
def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public task summary text per task, with the expected rows of its raw tables."""
    es = RN.event_summaries(spark, sf_dir)
    expected = RN.source_counts(es).select("task_id", "table_name", "expected").distinct()
    return R.task_summaries(tasks_frame(spark).join(es.runs.select("task_id").distinct(), "task_id"), expected, "spark")


# ---------------------------------------------------------------- job rollup

JOB_DEADLINE = "2024-01-02 12:00:00"


def observations_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task is a sync run; each of its users a connection with one job; events are polls."""
    e = table(spark, sf_dir, "events")
    status = (F.when(F.col("event_type") == "purchase", "succeeded")
              .when(F.col("event_type") == "error", "Failed")
              .when(F.col("event_type") == "click", "RUNNING")
              .when(F.col("event_type") == "view", "pending"))
    return e.select(RN.task_of(F.col("user_id")).alias("run_id"), F.col("user_id").alias("connection_id"),
                    F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
                    status.alias("status"), "ts")


@register("job_rollup", oracle=f"""
WITH o AS (SELECT {RN.TASK_SQL} AS run_id, user_id AS connection_id, 'job-' || CAST(user_id AS VARCHAR) AS job_id,
             lower(coalesce(CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'Failed'
                   WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'pending' END, 'unknown')) AS status, ts
           FROM events),
j AS (SELECT run_id, connection_id, job_id,
        arg_min(status, ts) FILTER (WHERE status IN ('succeeded', 'failed', 'cancelled', 'canceled', 'incomplete')
                                     AND ts <= TIMESTAMP '{JOB_DEADLINE}') AS outcome
      FROM o GROUP BY ALL),
r AS (SELECT run_id, CAST(count(DISTINCT connection_id) AS BIGINT) AS n_connections,
        CAST(count(*) FILTER (WHERE outcome = 'succeeded') AS BIGINT) AS n_succeeded,
        CAST(count(*) FILTER (WHERE outcome IS NOT NULL AND outcome <> 'succeeded') AS BIGINT) AS n_failed,
        CAST(count(*) FILTER (WHERE outcome IS NULL) AS BIGINT) AS n_unfinished FROM j GROUP BY run_id)
SELECT *, CAST(CASE WHEN n_connections = 0 THEN 2 WHEN n_unfinished > 0 THEN 3 WHEN n_failed = 0 THEN 0 ELSE 4 END
  AS INTEGER) AS exit_code FROM r""")
def job_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit code per sync run from polled job statuses (first terminal status by the deadline)."""
    obs = observations_frame(spark, sf_dir)
    outcomes = J.job_outcomes(obs, F.lit(JOB_DEADLINE).cast("timestamp_ntz"))
    connections = RN.runs_frame(spark, sf_dir).select(F.col("task_id").alias("run_id"),
                                                      F.col("run_id").alias("connection_id"))
    return J.rollup(outcomes, connections=connections)

