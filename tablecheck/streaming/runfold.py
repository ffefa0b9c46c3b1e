"""Run-log fold as a Structured Streaming job with typed state per run.

The batch fold (:func:`tablecheck.operators.runlog.fold_runs`) needs the whole log; here
actions arrive as a stream, in any order within the watermark.  The stream carries the batch
fold's own facets (:func:`~tablecheck.operators.runlog.faceted_actions`, JVM-side columns), and
``transformWithState`` keeps per run

* a ``MapState`` (facet, key) -> count, first and last place, last value: the mergeable
  summary of all rows up to the watermark, one entry per model, table and turn;
* a ``ListState`` of the actions, with their facets, beyond the watermark, before which others may still come;
* a ``ValueState`` with the run's segment, its timer, whether it is closed, and whether the
  other two hold anything.

Rows after a known submit are never kept.  Every micro-batch emits the summary of the runs it
changed, settled and waiting facets merged.  State always goes: a run whose submit the
watermark has passed gives up its summary at once and its closed mark ``closed_seconds``
after the submit; any other run expires ``limit_seconds`` after its last action.  What
arrives for a run after that starts a new segment, and as every row of a segment lies before
the next one's, :func:`latest_states` merges a run's segments, up to the first that was
submitted, with the batch fold's own aggregate: the result is that of the batch fold
whenever the timers fire.

Actions of a task that the task table does not know move the watermark on and do nothing
else, so a source without news can flush the state with them.  ``foreachBatch`` writes each
batch to its own folder under the shared checkpoint folder (idempotent on replay).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.runlog import MAX_SECONDS, faceted_actions, merged, run_states
from ..session import scratch_path

WAITING = ["at", "turn", "facet", "key", "text", "flag"]
WAITING_SCHEMA = "at long, turn long, facet array<string>, key array<string>, text array<string>, flag array<boolean>"
SUMMARY = ["n", "first_at", "first_turn", "last_at", "last_turn", "text", "flag"]
SUMMARY_SCHEMA = "n long, first_at long, first_turn long, last_at long, last_turn long, text string, flag boolean"
OUTPUT_SCHEMA = f"run_id long, task_id string, n_declared long, segment long, facet string, key string, {SUMMARY_SCHEMA}"
OUTPUT = Row("run_id", "task_id", "n_declared", "segment", "facet", "key", *SUMMARY)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def cut(actions: list[tuple]) -> list[tuple]:
    """Actions (as ``WAITING``) in call order, up to and including the first submit."""
    actions = sorted(actions, key=itemgetter(0, 1))
    submit = next((action[:2] for action in actions if "submit" in action[2]), None)
    return actions if submit is None else [action for action in actions if action[:2] <= submit]


def summary_of(actions: list[tuple]) -> dict[tuple, tuple]:
    """(facet, key) -> count, first place, last place and value of the facets of ordered actions."""
    found: dict[tuple, tuple] = {}
    for at, turn, *facets in actions:
        for facet, key, text, flag in zip(*facets, strict=True):
            n, *first = found.get((facet, key), (0, at, turn))[:3]
            found[facet, key] = (n + 1, *first, at, turn, text, flag)
    return found


def merge(known: tuple | None, new: tuple) -> tuple:
    """Two summaries of one key."""
    if known is None:
        return tuple(new)
    first = min(tuple(known[1:3]), tuple(new[1:3]))
    later = max((known, new), key=lambda s: tuple(s[3:5]))
    return (known[0] + new[0], *first, *later[3:])


class RunFold(StatefulProcessor):
    """State of one run; see the module's text."""

    def __init__(self, limit_seconds: float, closed_seconds: float):
        self.limit_ms, self.closed_ms = int(limit_seconds * 1000), int(closed_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "segment long, timer long, closed boolean, waits boolean, settled boolean")
        self.waiting = handle.getListState("waiting", WAITING_SCHEMA)
        self.facets = handle.getMapState("facets", "facet string, key string", SUMMARY_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # Each call of the state is a message to the JVM: what the run's value rules out is not asked for or written.
        known = self.run.get()
        if known is not None and known[2]:
            return
        new = [tuple(row) for row in rows]
        if not new:
            return
        waits, had_settled = (known[3], known[4]) if known is not None else (False, False)
        held = [tuple(row) for row in self.waiting.get()] if waits else []
        every = cut(held + [row[-len(WAITING):] for row in new])
        watermark = timerValues.getCurrentWatermarkInMs()
        final = [row for row in every if row[0] <= watermark * 1000]
        rest = every[len(final):]
        if known is not None and not final and rest == held:
            return  # all of it comes after the submit that waits
        settled = {tuple(k): tuple(v) for k, v in self.facets.iterator()} if had_settled else {}
        changed = {name: merge(settled.get(name), value) for name, value in summary_of(final).items()}
        settled |= changed
        whole = dict(settled)
        for name, value in summary_of(rest).items():
            whole[name] = merge(whole.get(name), value)
        closed = ("submit", "") in settled
        end = whole["submit", ""][3] // 1000 + self.closed_ms if closed else whole["call", ""][3] // 1000 + self.limit_ms
        segment = every[0][0] if known is None else known[0]
        timer = max(end, watermark) + 1
        if known is None or known[1] != timer:
            if known is not None:
                self.handle.deleteTimer(known[1])
            self.handle.registerTimer(timer)
        if closed:
            changed, rest, settled = {}, [], {}
            if had_settled:
                self.facets.clear()
        for name, value in changed.items():
            self.facets.updateValue(name, value)
        if rest:
            self.waiting.put(rest)
        elif waits:
            self.waiting.clear()
        self.run.update((segment, timer, closed, bool(rest), bool(settled)))
        task_id, n_declared = new[0][1:3]
        for name, value in whole.items():
            yield OUTPUT(key[0], task_id, n_declared, segment, *name, *value)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.run.clear()
        self.waiting.clear()
        self.facets.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The state store that typed state needs, for queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def start_fold_stream(spark: SparkSession, actions: DataFrame, tasks: DataFrame, out_dir: str, watermark: str = "1 hour",
                      limit_seconds: float = MAX_SECONDS, closed_seconds: float | None = None) -> StreamingQuery:
    """Start the streaming fold over all available input; summaries go to ``out_dir``, one folder per micro-batch.

    ``tasks``: ``(task_id, declared, targets)``, a static table joined to the stream.
    ``closed_seconds`` is ``limit_seconds`` unless given.
    """
    # Watermarks need TIMESTAMP; a TIMESTAMP_NTZ log is read as UTC wall time.
    timed = actions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    fold = RunFold(limit_seconds, limit_seconds if closed_seconds is None else closed_seconds)
    steps = faceted_actions(timed, tasks).select("run_id", "task_id", "n_declared", "ts", "at", "turn", *[
        F.col(f"facets.{name}").alias(name) for name in ("facet", "key", "text", "flag")])
    summaries = steps.groupBy("run_id").transformWithState(
        statefulProcessor=fold, outputStructType=OUTPUT_SCHEMA, outputMode="Update", timeMode="EventTime")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    with rocksdb_state(spark):
        return (summaries.writeStream.outputMode("update").foreachBatch(sink)
                .option("checkpointLocation", scratch_path(spark, "runfold-stream-ckpt")).trigger(availableNow=True).start())


def latest_states(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per run, as :func:`~tablecheck.operators.runlog.fold_runs` returns it, from the summaries written so far."""
    emitted = spark.read.parquet(out_dir)
    newest = emitted.groupBy("run_id", "segment").agg(
        F.max("batch").alias("batch"))
    latest = emitted.join(newest, ["run_id", "segment", "batch"])
    submitted = latest.filter("facet = 'submit'").groupBy("run_id").agg(F.min("segment").alias("_final"))
    applied = (latest.join(submitted, "run_id", "left")
               .filter(F.col("_final").isNull() | (F.col("segment") <= F.col("_final"))))
    place = lambda which: F.struct(F.col(f"{which}_at").alias("at"), F.col(f"{which}_turn").alias("turn")).alias(which)
    return run_states(merged(applied.select("run_id", "task_id", "n_declared", "facet", "key", "n", place("first"),
                                            place("last"), F.struct("text", "flag").alias("value"))))


def run_fold_stream(spark: SparkSession, actions: DataFrame, tasks: DataFrame, watermark: str = "1 hour",
                    limit_seconds: float = MAX_SECONDS, closed_seconds: float | None = None) -> DataFrame:
    """Run the streaming fold until the input is drained; return the final state per run."""
    out_dir = scratch_path(spark, "runfold-stream")
    start_fold_stream(spark, actions, tasks, out_dir, watermark, limit_seconds, closed_seconds).awaitTermination()
    return latest_states(spark, out_dir)
