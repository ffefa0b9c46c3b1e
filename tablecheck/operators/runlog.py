"""Run logs: fold many runs' action logs into run state, grade, and apply limits.

Input ``actions``: ``(run_id, task_id, ts, turn, tool, tables ARRAY<STRING>, model, sql)`` and
optionally ``failed BOOLEAN``, one row per tool call, ``turn`` counting the run's turns (several
calls may share one); ``tasks``: ``(task_id, declared ARRAY<STRING>, targets ARRAY<STRING>)``
and optionally ``official BOOLEAN``.

Fold rules (per run, actions ordered by ``(ts, turn)``):

* actions after the first ``submit_pipeline`` are ignored (the submit itself counts);
* a failing action changes nothing;
* ``configure_el`` fails on an empty list or an undeclared table; otherwise its tables
  are loaded (and stay loaded) and ``el_succeeded`` becomes "this call covered every
  declared table", so a later partial call clears it;
* in an official task ``configure_el`` only declares its tables; a ``run_el`` that did not
  fail loads those declared before it and sets ``el_succeeded`` for good (elsewhere
  ``run_el`` changes nothing);
* ``write_model`` fails for an undeclared target or a non-SELECT text; the first
  valid write of a model fixes its order, the last one its text;
* ``run_transforms`` sets ``transform_ran`` (even with no models) and materialises
  every model written before it.

The fold is a mergeable summary.  :func:`action_facets` turns an action into facets, each with
a key: the call itself, its turn, a table, a model's text, a transform, a submit.  Of each
(run, facet, key) only a count, the first and the last place and the last value are kept;
such summaries of any rows of a run merge by :func:`merged`, and :func:`run_states` reads the
run's state off them.  The stream keeps the same summary as its state.  In batch the log is
read twice: for the first submits (one small row per run) and for the facets; the cut at
the submit joins on (run, salt), and a run of any length is pre-aggregated in all tasks.
No join is hinted: adaptive execution measures the sides at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guard import select_only_reason

TERMINAL_TOOL = "submit_pipeline"
# Weights of a complete extraction and of the target tables, run limits, error text cut.
EXTRACT_WEIGHT, TARGET_WEIGHT = 0.2, 0.8
MAX_TURNS, MAX_CALLS, MAX_SECONDS = 12, 50, 1800
ERROR_CHARS = 1200
# Parts in which a run's actions are cut at its submit; the place of a call without a turn among calls of its time.
SALTS = 16
FIRST_TURN = -(1 << 63)


def valid_configure(tables: Column, declared: Column) -> Column:
    return (F.col("tool") == "configure_el") & (F.size(tables) > 0) & \
        (F.size(F.array_except(tables, declared)) == 0)


def valid_write(model: Column, sql: Column, targets: Column) -> Column:
    return (F.col("tool") == "write_model") & F.array_contains(targets, model) & \
        select_only_reason(sql).isNull()


def call_order() -> Column:
    return F.struct("ts", "turn")


def until_submit(actions: DataFrame, salts: int = 1) -> DataFrame:
    """Actions up to and including each run's first submit (all actions if none).

    With ``salts`` above 1 a run's actions are joined in that many parts.
    """
    submit = (actions.where(F.col("tool") == TERMINAL_TOOL)
              .groupBy("run_id").agg(F.min(call_order()).alias("_submit")))
    on = ["run_id"]
    if salts > 1:
        on = ["run_id", "_salt"]
        actions = actions.withColumn("_salt", F.pmod(F.xxhash64("ts", "turn"), F.lit(salts)))
        submit = submit.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    joined = actions.join(submit, on, "left")
    return joined.where(F.col("_submit").isNull() | (call_order() <= F.col("_submit"))).drop("_submit", "_salt")


def _optional(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def faceted_actions(actions: DataFrame, tasks: DataFrame) -> DataFrame:
    """``run_id, task_id, n_declared, ts, at, turn, facets``: each action with what it adds to its run, as an
    array of (facet, key, text, flag).

    ``at`` is the time in microseconds; a missing turn comes first in the order of calls and
    has no turn facet.  Actions of unknown tasks are left out.
    """
    known = tasks.select("task_id", "declared", "targets", _optional(tasks, "official").alias("_official"))
    acts = (actions.withColumn("_failed", _optional(actions, "failed")).join(known, "task_id")
            .withColumn("_cfg", F.coalesce(valid_configure(F.col("tables"), F.col("declared")), F.lit(False)))
            .withColumn("_wm", F.coalesce(valid_write(F.col("model"), F.col("sql"), F.col("targets")), F.lit(False))))
    official, tool = F.col("_official"), F.col("tool")
    covers = F.coalesce(F.size(F.array_except("declared", "tables")) == 0, F.lit(False))
    none, text = F.lit(None).cast("boolean"), F.lit(None).cast("string")

    def facet(name, key=F.lit(""), value=text, flag=none):  # noqa: B008
        name = F.lit(name) if isinstance(name, str) else name
        return F.struct(name.alias("facet"), key.alias("key"), value.alias("text"), flag.alias("flag"))

    empty = F.array().cast("array<struct<facet:string,key:string,text:string,flag:boolean>>")
    when = lambda condition, *facets: F.when(condition, F.array(*facets)).otherwise(empty)
    each_table = F.transform(F.array_distinct("tables"), lambda t: facet(
        F.when(official, "source").otherwise("table"), F.coalesce(t, F.lit(""))))
    facets = F.concat(
        F.array(facet("call")),
        when(F.col("turn").isNotNull(), facet("turn", F.col("turn").cast("string"))),
        when(tool == TERMINAL_TOOL, facet("submit")),
        when(tool == "run_transforms", facet("transform")),
        when((tool == "run_el") & official & ~F.col("_failed"), facet("extract")),
        when(F.col("_cfg") & ~official, facet("configure", flag=covers)),
        F.when(F.col("_cfg"), each_table).otherwise(empty),
        when(F.col("_wm"), facet("model", F.col("model"), F.col("sql"))))
    return (acts.select("run_id", "task_id", F.size("declared").cast("long").alias("n_declared"), "ts",
                        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
                        F.coalesce(F.col("turn").cast("long"), F.lit(FIRST_TURN)).alias("turn"), facets.alias("facets")))


def action_facets(actions: DataFrame, tasks: DataFrame) -> DataFrame:
    """``run_id, task_id, n_declared, ts, at, turn, facet, key, text, flag``: :func:`faceted_actions`, one row a facet."""
    names = ["run_id", "task_id", "n_declared", "ts", "at", "turn"]
    return faceted_actions(actions, tasks).select(*names, F.explode("facets").alias("f")).select(*names, "f.*")


def summarised(facets: DataFrame) -> DataFrame:
    """The summary of raw facets: one row per (run, facet, key)."""
    place = F.struct("at", "turn")
    return merged(facets.select("run_id", "task_id", "n_declared", "facet", "key", F.lit(1).cast("long").alias("n"),
                                place.alias("first"), place.alias("last"), F.struct("text", "flag").alias("value")))


def merged(summaries: DataFrame) -> DataFrame:
    """Summaries of disjoint parts of runs as one: ``run_id, facet, key, task_id, n_declared, n, first, last, value``."""
    return summaries.groupBy("run_id", "facet", "key").agg(
        F.max("task_id").alias("task_id"), F.max("n_declared").alias("n_declared"), F.sum("n").alias("n"),
        F.min("first").alias("first"), F.max_by("value", "last").alias("value"), F.max("last").alias("last"))


def run_states(summary: DataFrame) -> DataFrame:
    """One row per run from a summary cut at the first submit; see :func:`fold_runs`."""
    only = lambda name, c: F.when(F.col("facet") == name, c)
    place = only("call", F.col("first.at")), only("call", F.col("last.at"))
    state = summary.groupBy("run_id").agg(
        F.max("task_id").alias("task_id"), F.max("n_declared").alias("n_declared"),
        F.max(F.col("facet") == "submit").alias("submitted"),
        F.sum(only("call", F.col("n"))).alias("n_calls"), F.count(only("turn", F.lit(1))).alias("n_turns"),
        (F.max(place[1]) - F.min(place[0])).alias("_elapsed"),
        F.max(only("configure", F.col("value.flag"))).alias("_covers"),
        F.max(only("extract", F.col("last"))).alias("_extract"),
        F.max(only("transform", F.col("last"))).alias("_transform"),
        # at most the declared tables and the declared targets of a run
        F.collect_list(only("table", F.col("key"))).alias("_tables"),
        F.collect_list(only("source", F.struct("first", "key"))).alias("_sources"),
        F.collect_list(only("model", F.struct("first", F.col("key").alias("model"), F.col("value.text").alias("sql"))))
        .alias("_writes"))
    extracted = F.transform(F.filter("_sources", lambda s: F.coalesce(s["first"] < F.col("_extract"), F.lit(False))),
                            lambda s: s["key"])
    writes = F.sort_array("_writes")
    built = F.filter("_writes", lambda w: F.coalesce(w["first"] < F.col("_transform"), F.lit(False)))
    return state.select(
        "run_id", "task_id", "submitted", "n_calls", "n_turns", (F.col("_elapsed") / 1_000_000).alias("elapsed_s"),
        (F.coalesce("_covers", F.lit(False)) | F.col("_extract").isNotNull()).alias("el_succeeded"),
        F.sort_array(F.array_union("_tables", extracted)).alias("loaded"), "n_declared",
        F.transform(writes, lambda w: F.struct(w["model"].alias("model"), w["sql"].alias("sql"))).alias("models"),
        F.col("_transform").isNotNull().alias("transform_ran"),
        F.sort_array(F.transform(built, lambda w: w["model"])).alias("materialized"))


def fold_runs(actions: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per run: ``run_id, task_id, submitted, n_calls, n_turns, elapsed_s, el_succeeded,
    loaded, n_declared, models, transform_ran, materialized``.

    ``loaded`` and ``materialized`` are sorted names; ``models`` holds (model, sql), the
    last valid text of each model in the order of their first valid writes.
    """
    return run_states(summarised(action_facets(until_submit(actions, SALTS), tasks)))


def raw_fractions(state: DataFrame, counts: DataFrame) -> DataFrame:
    """``run_id, raw_fraction``: share of the declared tables that the run loaded with exactly
    the expected row count.  ``counts``: ``(run_id, table_name, expected, actual)``; a
    declared table without a row there does not match."""
    exact = (counts.join(state.select("run_id", "loaded"), "run_id")
             .where(F.array_contains("loaded", F.col("table_name")) & (F.col("expected") == F.col("actual")))
             .groupBy("run_id").agg(F.countDistinct("table_name").alias("_exact")))
    return state.select("run_id", "n_declared").join(exact, "run_id", "left").select(
        "run_id", (F.coalesce("_exact", F.lit(0)) / F.greatest("n_declared", F.lit(1))).alias("raw_fraction"))


def grade_runs(state: DataFrame, tasks: DataFrame, table_scores: DataFrame, counts: DataFrame
               ) -> tuple[DataFrame, DataFrame]:
    """Gated reward per run, and the per-(run, target) scores it used.

    ``table_scores``: ``(run_id, table_name, score)`` for produced tables; ``counts``: see
    :func:`raw_fractions`.  Not submitted gives 0; extraction incomplete gives
    ``0.2 * raw_fraction`` when ``el_succeeded`` else 0 (unrounded); otherwise
    ``0.2 + 0.8 * mean(target scores)`` rounded to 6 places, or 0.2 when transforms never
    ran.  A target that was not materialised, or has no score, scores 0 and still counts.
    """
    targets = state.join(tasks.select("task_id", "targets"), "task_id") \
                   .select("run_id", F.explode("targets").alias("table_name"), "materialized")
    per_target = (targets.join(table_scores.select("run_id", "table_name", "score"),
                               ["run_id", "table_name"], "left")
                  .select("run_id", "table_name",
                          F.when(F.array_contains("materialized", F.col("table_name")),
                                 F.coalesce("score", F.lit(0.0))).otherwise(F.lit(0.0)).alias("score")))
    fraction = per_target.groupBy("run_id").agg(
        (F.sum("score") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("target_fraction"))
    s = state.join(raw_fractions(state, counts), "run_id").join(fraction, "run_id", "left")
    complete = F.col("el_succeeded") & (F.col("raw_fraction") == 1.0)
    tf = F.coalesce(F.col("target_fraction"), F.lit(0.0))
    reward = (F.when(~F.col("submitted"), F.lit(0.0))
              .when(~complete, F.when(F.col("el_succeeded"), EXTRACT_WEIGHT * F.col("raw_fraction"))
                    .otherwise(F.lit(0.0)))
              .when(F.col("transform_ran"), F.round(EXTRACT_WEIGHT + TARGET_WEIGHT * tf, 6))
              .otherwise(F.lit(EXTRACT_WEIGHT)))
    return s.select("*", F.when(F.col("submitted") & complete, tf).alias("graded_fraction"),
                    reward.cast("double").alias("reward")), per_target


def run_metrics(graded: DataFrame, per_target: DataFrame) -> DataFrame:
    """Long metrics ``(run_id, metric, value)``: submitted; el_success and raw_fraction once
    submitted; target/<table> and target_fraction once extraction is complete."""
    complete = F.col("el_succeeded") & (F.col("raw_fraction") == 1.0)
    base = graded.select("run_id", F.explode(F.when(
        F.col("submitted"),
        F.array(F.struct(F.lit("submitted").alias("metric"), F.lit(1.0).alias("value")),
                F.struct(F.lit("el_success").alias("metric"), F.col("el_succeeded").cast("double").alias("value")),
                F.struct(F.lit("raw_fraction").alias("metric"), F.col("raw_fraction").cast("double").alias("value"))))
        .otherwise(F.array(F.struct(F.lit("submitted").alias("metric"), F.lit(0.0).alias("value"))))).alias("m"))
    base = base.select("run_id", "m.metric", "m.value")
    done = graded.where(F.col("submitted") & complete)
    targets = per_target.join(done.select("run_id"), "run_id", "left_semi").select(
        "run_id", F.concat(F.lit("target/"), F.col("table_name")).alias("metric"), F.col("score").alias("value"))
    fraction = done.select("run_id", F.lit("target_fraction").alias("metric"),
                           F.col("graded_fraction").alias("value"))
    return base.unionByName(targets).unionByName(fraction)


def limit_policy(graded: DataFrame, max_turns: int = MAX_TURNS, max_calls: int = MAX_CALLS,
                 max_seconds: float = MAX_SECONDS) -> DataFrame:
    """Reward after the run limits: over ``max_turns`` turns, ``max_calls`` tool calls or
    ``max_seconds`` from the first call to the last, or not submitted, gives 0."""
    over = (F.col("n_turns") > max_turns) | (F.col("n_calls") > max_calls) | \
        (F.col("elapsed_s") > max_seconds) | ~F.col("submitted")
    return graded.select("run_id", "task_id", "n_turns", "n_calls", "elapsed_s", "reward",
                         F.when(over, F.lit(0.0)).otherwise(F.col("reward")).alias("policy_reward"))


def group_advantage(rewards: DataFrame, group_col: str = "task_id", reward_col: str = "reward") -> DataFrame:
    """Reward minus the mean reward of its group (aggregate + join, so a large group is
    pre-aggregated map-side instead of landing in one window partition)."""
    means = rewards.groupBy(group_col).agg(F.avg(reward_col).alias("group_mean"))
    return (rewards.join(means, group_col)
            .withColumn("advantage", F.round(F.col(reward_col) - F.col("group_mean"), 6)))


def task_summaries(tasks: DataFrame, expected: DataFrame, destination: str) -> DataFrame:
    """``task_id, summary``: the public text of each task, its raw tables with their expected rows.

    ``expected``: ``(task_id, table_name, expected)``; tables follow the task's declared order.
    """
    rows = expected.groupBy("task_id").agg(F.map_from_entries(
        F.collect_list(F.struct("table_name", "expected"))).alias("_rows"))
    table = lambda t: F.concat(t, F.lit(" ("), F.element_at("_rows", t).cast("string"), F.lit(" rows)"))
    shown = F.transform("declared", lambda t: F.coalesce(table(t), t))
    return tasks.join(rows, "task_id", "left").select("task_id", F.concat_ws(
        "\n", F.concat(F.lit("Task: "), F.col("task_id")), F.lit(f"Destination: {destination}"),
        F.concat(F.lit("Raw tables: "), F.array_join(shown, ", ")),
        F.concat(F.lit("Required final models: "), F.array_join("targets", ", "))).alias("summary"))


def transition_log(actions: DataFrame, graded: DataFrame, metrics: DataFrame | None = None,
                   id_cols: tuple[str, ...] = ("ts",)) -> DataFrame:
    """One transition per applied action ``(run_id, <id_cols>, tool, observation, done, reward,
    metrics)``, up to and including the submit, which is done and carries the run's reward.

    ``actions`` holds what each call returned, as recorded: ``observation`` and
    ``is_error``; error texts are cut to 1,200 characters.  ``metrics``
    (:func:`run_metrics`) go to the submit row as a map.
    """
    recorded = F.when(F.col("is_error"), F.substring("observation", 1, ERROR_CHARS)).otherwise(F.col("observation"))
    done = F.col("tool") == TERMINAL_TOOL
    out = until_submit(actions).join(graded.select("run_id", F.col("reward").alias("_reward")), "run_id", "left")
    if metrics is not None:
        per_run = metrics.groupBy("run_id").agg(F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("_metrics"))
        out = out.join(per_run, "run_id", "left")
    else:
        out = out.withColumn("_metrics", F.lit(None).cast("map<string,double>"))
    return out.select(
        "run_id", *id_cols, "tool", recorded.alias("observation"), done.alias("done"),
        F.when(done, F.col("_reward")).otherwise(F.lit(0.0)).alias("reward"),
        F.when(done, F.col("_metrics")).alias("metrics"))


def write_transition_log(log: DataFrame, path: str) -> None:
    """JSON-lines sink of transitions, one folder per write (overwrite keeps reruns idempotent)."""
    log.write.mode("overwrite").json(path)
