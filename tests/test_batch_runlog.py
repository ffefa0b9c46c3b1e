"""Batch grading equals pairwise grading; run-log fold rules on a hand-made log."""

import datetime as dt



from tablecheck.operators import batch as B
from tablecheck.operators import compare as C
from tablecheck.operators import runlog as R


def test_batch_equals_pairwise(spark):
    gold_rows = [("a", "1", "x"), ("b", "2", "Y"), ("c", "3.5", None)]
    gold = spark.createDataFrame(gold_rows, "k string, v string, t string")
    actuals = {
        "r1": spark.createDataFrame([(1.0, "b", "y"), (3.5, "c", None), (1.0, "a", "X")], "v double, k string, t string"),
        "r2": spark.createDataFrame([(1.5, "a", "x"), (2.0, "b", "y"), (3.5, "c", None)], "v double, k string, t string"),
        "r3": spark.createDataFrame([(1.0, "a")], "v double, k string"),
        "r4": spark.createDataFrame([("a", "1", "x", 9), ("b", "2", "y", 9), ("c", "3.5", "q", 9)],
                                    "K string, V string, T string, extra int"),
    }
    g_cells, g_names = B.to_cells(gold, task_id="t1", table_name="tbl")
    parts = [B.to_cells(df, run_id=r, table_name="tbl") for r, df in actuals.items()]
    a_cells = B.union_all([p[0] for p in parts])
    a_names = B.union_all([p[1] for p in parts])
    runs = spark.createDataFrame([(r, "t1") for r in list(actuals) + ["r5"]], "run_id string, task_id string")
    got = {r.run_id: (r.score, r.matched_columns, r.total_columns, r.row_count_match)
           for r in B.batch_grade(g_cells, g_names, a_cells, a_names, runs).collect()}
    for run, df in actuals.items():
        s = C.compare_tables(gold, df)
        assert got[run] == (round(s.score, 6), s.matched_columns, s.total_columns, s.row_count_match), run
    assert got["r5"] == (0.0, 0, 3, None)


def _log(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    data = [("r", "t", t0 + dt.timedelta(hours=i), i // 2, tool, tables, model, sql)
            for i, (tool, tables, model, sql) in enumerate(rows)]
    return spark.createDataFrame(data, "run_id string, task_id string, ts timestamp, turn long, tool string, "
                                       "tables array<string>, model string, sql string")


def test_fold_rules(spark):
    tasks = spark.createDataFrame([("t", ["a", "b"], ["m1", "m2"])],
                                  "task_id string, declared array<string>, targets array<string>")
    acts = _log(spark, [
        ("configure_el", ["a", "b"], None, None),      # covers all: el ok
        ("configure_el", ["a"], None, None),           # partial: clears el ok, a and b stay loaded
        ("configure_el", ["a", "zz"], None, None),     # undeclared: fails, no change
        ("write_model", None, "m1", "SELECT 1"),
        ("write_model", None, "m9", "SELECT 1"),       # unknown target: fails
        ("write_model", None, "m2", "SELECT 1; x"),    # not a single SELECT: fails
        ("run_transforms", None, None, None),
        ("write_model", None, "m2", "with q as (select 1) select * from q"),
        ("submit_pipeline", None, None, None),
        ("run_transforms", None, None, None),          # after submit: ignored
    ])
    row = R.fold_runs(acts, tasks).first()
    assert row.submitted and row.n_calls == 9
    assert row.el_succeeded is False
    assert row.loaded == ["a", "b"] and row.n_declared == 2 and row.n_turns == 5 and row.elapsed_s == 8 * 3600
    assert [m.model for m in row.models] == ["m1", "m2"] and row.transform_ran
    assert row.materialized == ["m1"]


def test_grade_and_limits(spark):
    state = spark.createDataFrame(
        [("r1", "t", True, 3, 1, 9.0, True, ["a", "b"], 2, True, ["m1", "m2"]),
         ("r2", "t", True, 60, 1, 9.0, True, ["a", "b"], 2, True, ["m1"]),
         ("r3", "t", True, 3, 1, 9.0, True, ["a"], 2, True, []),
         ("r4", "t", False, 3, 1, 9.0, True, ["a", "b"], 2, True, []),
         ("r5", "t", True, 3, 1, 9.0, True, ["a", "b"], 2, False, ["m1"]),
         ("r6", "t", True, 3, 1, 1801.0, True, ["a", "b"], 2, True, ["m1", "m2"]),
         ("r7", "t", True, 3, 1, 9.0, True, ["a", "b"], 2, True, ["m1", "m2"])],
        "run_id string, task_id string, submitted boolean, n_calls long, n_turns long, elapsed_s double, "
        "el_succeeded boolean, loaded array<string>, n_declared long, transform_ran boolean, materialized array<string>")
    counts = spark.createDataFrame(
        [(f"r{k}", t, 10, 9 if (k, t) == (7, "b") else 10) for k in range(1, 8) for t in "ab"],
        "run_id string, table_name string, expected long, actual long")
    tasks = spark.createDataFrame([("t", ["a"], ["m1", "m2"])], "task_id string, declared array<string>, targets array<string>")
    scores = spark.createDataFrame([("r1", "m1", 1.0), ("r1", "m2", 0.5), ("r2", "m1", 1.0), ("r5", "m1", 1.0),
                                    ("r6", "m1", 1.0), ("r6", "m2", 1.0), ("r7", "m1", 1.0), ("r7", "m2", 1.0)],
                                   "run_id string, table_name string, score double")
    graded, _ = R.grade_runs(state, tasks, scores, counts)
    reward = {r.run_id: r.reward for r in graded.collect()}
    assert reward == {"r1": 0.8, "r2": 0.6, "r3": 0.2 * 0.5, "r4": 0.0, "r5": 0.2, "r6": 1.0, "r7": 0.2 * 0.5}
    limited = {r.run_id: r.policy_reward for r in R.limit_policy(graded, 12, 50).collect()}
    assert limited["r2"] == limited["r6"] == 0.0 and limited["r1"] == 0.8
    adv = {r.run_id: r.advantage for r in R.group_advantage(graded.select("run_id", "task_id", "reward")).collect()}
    mean = sum(reward.values()) / 7
    assert all(abs(adv[k] - round(reward[k] - mean, 6)) < 1e-9 for k in reward)


def test_stream_fold_equals_batch_fold(spark):
    from tablecheck.plans import QUERIES
    sf = "/root/testdata/sf0.001"
    stream = QUERIES["run_fold_stream"](spark, sf)
    batch = QUERIES["run_fold"](spark, sf)
    cols = batch.columns
    assert sorted(map(tuple, stream.select(*cols).collect())) == sorted(map(tuple, batch.collect()))


def test_stream_over_unordered_files_equals_batch(spark, tmp_path):
    """Several files, the earlier actions in later files: one micro-batch each."""
    from tablecheck.plans import actions as A
    from tablecheck.streaming.runfold import run_fold_stream
    start = dt.datetime(2024, 1, 1)
    tools = ["configure_el", "write_model", "run_transforms", "write_model", "submit_pipeline", "run_transforms"]
    rows = [(run, "t", start + dt.timedelta(minutes=3 * i + run), i, tool,
             ["a", "b"] if tool == "configure_el" else None, f"m{i % 2 + 1}" if tool == "write_model" else None,
             f"SELECT {i}" if tool == "write_model" else None) for run in (1, 2, 3) for i, tool in enumerate(tools)]
    schema = ("run_id long, task_id string, ts timestamp, turn long, tool string, tables array<string>, model string, "
              "sql string")
    files = [rows[i::4] for i in (3, 1, 2, 0)]
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    tasks = spark.createDataFrame([("t", ["a", "b"], ["m1", "m2"])],
                                  "task_id string, declared array<string>, targets array<string>")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = A.fold_columns(run_fold_stream(spark, stream, tasks, limit_seconds=86_400))
    want = A.fold_columns(R.fold_runs(spark.createDataFrame(rows, schema), tasks))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stream_goes_on_after_the_time_limit(spark, tmp_path):
    """Runs whose timer fired, submitted or not, and act again days later."""
    from tablecheck.plans import actions as A
    from tablecheck.streaming.runfold import run_fold_stream
    log = [  # (day, run, turn, tool, model)
        [(1, 1, 0, "configure_el", None), (1, 1, 1, "write_model", "m1"), (1, 1, 3, "submit_pipeline", None),
         (1, 2, 0, "configure_el", None), (1, 2, 1, "write_model", "m1"), (1, 2, 2, "write_model", "m2"),
         (1, 2, 2, "run_transforms", None), (1, 3, 0, "write_model", "m2")],
        [(2, 3, 1, "write_model", "m1")], [(3, 3, 2, "configure_el", None)], [(4, 3, 2, "run_transforms", None)],
        [(5, 1, 9, "write_model", "m2"), (5, 2, 3, "write_model", "m1"), (5, 2, 5, "submit_pipeline", None)],
        [(6, 3, 4, "submit_pipeline", None)], [(7, 2, 7, "run_transforms", None)]]
    schema = ("run_id long, task_id string, ts timestamp, turn long, tool string, tables array<string>, model string, "
              "sql string")
    files = [[(run, "t", dt.datetime(2024, 1, day) + dt.timedelta(minutes=10 * turn, seconds=k), turn, tool,
               ["a", "b"] if tool == "configure_el" else None, model, f"SELECT {day}{k}" if model else None)
              for k, (day, run, turn, tool, model) in enumerate(part)] for part in log]
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    tasks = spark.createDataFrame([("t", ["a", "b"], ["m1", "m2"])],
                                  "task_id string, declared array<string>, targets array<string>")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = A.fold_columns(run_fold_stream(spark, stream, tasks, limit_seconds=3_600))
    want = A.fold_columns(R.fold_runs(spark.createDataFrame(sum(files, []), schema), tasks))
    rows = sorted(map(tuple, got.select(*want.columns).collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) == 3


def _landed(spark, path, files, schema):
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_state_is_typed_and_goes(spark, tmp_path):
    """Closed runs leave at once but for a mark, idle ones at their limit; segments merge to the batch fold."""
    from tablecheck.plans import actions as A
    from tablecheck.session import scratch_path
    from tablecheck.streaming.runfold import latest_states, start_fold_stream
    schema = ("run_id long, task_id string, ts timestamp, turn long, tool string, tables array<string>, model string, "
              "sql string, failed boolean")
    day = lambda d, minutes=0: dt.datetime(2024, 1, d) + dt.timedelta(minutes=minutes)
    act = lambda run, at, turn, tool, model=None, task="t", failed=False: (
        run, task, at, turn, tool, ["a", "b"] if tool == "configure_el" else None, model, f"SELECT {turn}" if model else None, failed)
    files = [
        [act(1, day(1, 5), 3, "submit_pipeline"), act(1, day(1, 2), 1, "write_model", "m1"), act(2, day(1), 0, "write_model", "m2"),
         act(3, day(1), None, "run_el", task="o"), act(3, day(1, 1), 1, "configure_el", task="o")],
        [act(1, day(1, 1), 0, "configure_el"), act(1, day(1, 3), 2, "run_transforms"), act(1, day(1, 9), 4, "write_model", "m2"),
         act(3, day(1, 2), 2, "run_el", task="o"), act(3, day(1, 3), 3, "configure_el", task="o"), act(3, day(1, 4), 4, "run_el", task="o", failed=True)],
        [act(2, day(4), 1, "write_model", "m1"), act(4, day(4), 0, "submit_pipeline"), act(1, day(4), 9, "submit_pipeline")],
        [act(2, day(8), 1, "run_transforms"), act(2, day(8, 1), 2, "write_model", "m2"), act(1, day(8), 10, "write_model", "m1")],
        [act(2, day(12), 3, "submit_pipeline"), act(2, day(12, 1), 4, "write_model", "m1")],
        [(None, "", day(28), None, None, None, None, None, None)]]
    tasks = spark.createDataFrame([("t", ["a", "b"], ["m1", "m2"], False), ("o", ["a", "b"], ["m1"], True)],
                                  "task_id string, declared array<string>, targets array<string>, official boolean")
    out = scratch_path(spark, "test-fold")
    query = start_fold_stream(spark, _landed(spark, tmp_path / "log", files, schema), tasks, out, limit_seconds=3_600)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] == 0 and max(held) > 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    got = latest_states(spark, out)
    want = R.fold_runs(spark.createDataFrame(sum(files[:-1], []), schema), tasks)
    rows = {r["run_id"]: r for r in got.collect()}
    flat = A.fold_columns(want)
    assert sorted(map(tuple, A.fold_columns(got).select(*flat.columns).collect())) == sorted(map(tuple, flat.collect()))
    assert rows[1]["models"][0]["sql"] == "SELECT 1" and rows[1]["n_calls"] == 4 and rows[1]["materialized"] == ["m1"]
    assert [m["model"] for m in rows[2]["models"]] == ["m2", "m1"] and rows[2]["materialized"] == ["m1", "m2"]
    assert rows[2]["models"][0]["sql"] == "SELECT 2" and rows[2]["submitted"] and rows[2]["n_calls"] == 5
    # official: tables are loaded by the run_el after their declaration; a failed one does nothing
    assert rows[3]["el_succeeded"] and rows[3]["loaded"] == ["a", "b"] and rows[3]["n_turns"] == 4


def test_landings_of_many_files_take_one_micro_batch_each(spark, tmp_path, monkeypatch):
    """A log of many splits lands in as many files a landing, and still in one micro-batch a landing."""
    from pyspark.sql import functions as F
    from tablecheck.plans import actions as A
    from tablecheck.plans import streams
    from tablecheck.session import scratch_path
    from tablecheck.streaming.runfold import latest_states, start_fold_stream
    kinds = F.array(*[F.lit(k) for k in ("signup", "view", "click", "purchase", "error")])
    events = spark.range(600, numPartitions=6).select(
        F.col("id").alias("event_id"), (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(mins=F.col("id") * 70)).alias("ts"),
        (F.col("id") * 7 % 20).alias("user_id"), F.get(kinds, (F.col("id") * 11 % 13 % 5).cast("int")).alias("event_type"),
        F.lit(1.0).alias("value"), F.format_string('{"k": %d}', F.col("id") % 77).alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    batches = []

    def run(spark, actions, tasks, **limits):
        out = scratch_path(spark, "test-fold")
        query = start_fold_stream(spark, actions, tasks, out, **limits)
        query.awaitTermination()
        batches.extend(p["numInputRows"] for p in query.recentProgress if p["numInputRows"])
        return latest_states(spark, out)

    monkeypatch.setattr(streams, "run_fold_stream", run)
    stream = streams.run_fold_stream_query(spark, str(tmp_path))
    want = A.run_fold(spark, str(tmp_path))
    assert sorted(map(tuple, stream.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert sum(batches) == 601 and len(batches) <= streams.LANDINGS + 1


def test_official_tasks_load_by_run_el(spark):
    schema = ("run_id string, task_id string, ts timestamp, turn long, tool string, tables array<string>, model string, "
              "sql string, failed boolean")
    at = dt.datetime(2024, 1, 1)
    steps = {  # run -> (tool, tables, failed)
        "all": [("configure_el", ["a", "b"], None), ("run_el", None, False)],
        "late": [("configure_el", ["a"], None), ("run_el", None, None), ("configure_el", ["b"], None)],
        "failed": [("configure_el", ["a", "b"], None), ("run_el", None, True)],
        "none": [("configure_el", ["a", "b"], None)], "bare": [("run_el", None, False)],
        "wrong": [("configure_el", ["a", "x"], None), ("run_el", None, False)]}
    rows = [(run, task, at, k, tool, tables, None, None, failed) for task in ("official", "local")
            for run, part in ((f"{task}/{r}", p) for r, p in steps.items()) for k, (tool, tables, failed) in enumerate(part)]
    tasks = spark.createDataFrame([("official", ["a", "b"], ["m"], True), ("local", ["a", "b"], ["m"], None)],
                                  "task_id string, declared array<string>, targets array<string>, official boolean")
    got = {r.run_id: (r.el_succeeded, r.loaded) for r in R.fold_runs(spark.createDataFrame(rows, schema), tasks).collect()}
    assert got == {
        "official/all": (True, ["a", "b"]), "official/late": (True, ["a"]), "official/failed": (False, []),
        "official/none": (False, []), "official/bare": (True, []), "official/wrong": (True, []),
        "local/all": (True, ["a", "b"]), "local/late": (False, ["a", "b"]), "local/failed": (True, ["a", "b"]),
        "local/none": (True, ["a", "b"]), "local/bare": (False, []), "local/wrong": (False, [])}


def test_fold_reads_the_log_twice(spark):
    """A hot run is cut and pre-aggregated in parts; summaries of parts merge to the whole."""
    from pyspark.sql import functions as F
    from tablecheck.plans import actions as A
    acts, tasks = A.actions_frame(spark, "/root/testdata/sf0.001"), A.tasks_frame(spark)
    whole = R.fold_runs(acts, tasks)
    rows = sorted(map(repr, whole.collect()))
    plan = whole._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan parquet") <= 2
    facets = R.action_facets(R.until_submit(acts), tasks)
    parts = [R.summarised(facets.filter(F.pmod(F.xxhash64("at", "turn"), F.lit(3)) == k)) for k in range(3)]
    assert sorted(map(repr, R.run_states(R.merged(parts[2].unionByName(parts[0]).unionByName(parts[1]))).collect())) == rows


def test_ties_on_time_follow_turns(spark):
    tasks = spark.createDataFrame([("t", ["a"], ["m"])], "task_id string, declared array<string>, targets array<string>")
    at = dt.datetime(2024, 1, 1)
    rows = [("r", "t", at, 3, "run_transforms", None, None, None), ("r", "t", at, 2, "submit_pipeline", None, None, None),
            ("r", "t", at, 1, "write_model", None, "m", "SELECT 2"), ("r", "t", at, 0, "write_model", None, "m", "SELECT 1")]
    row = R.fold_runs(spark.createDataFrame(rows, "run_id string, task_id string, ts timestamp, turn long, tool string, "
                                                  "tables array<string>, model string, sql string"), tasks).first()
    assert row.n_calls == 3 and not row.transform_ran and [tuple(m) for m in row.models] == [("m", "SELECT 2")]


def test_hot_group_is_spread_and_scored(spark):
    """One run holds almost all rows, many of them equal; ranges split it all the same."""
    from pyspark.sql import functions as F

    from tablecheck.operators import positions as P
    gold = spark.range(0, 3000).select((F.col("id") % 5).cast("string").alias("k"))
    hot = spark.range(0, 3000).select((F.col("id") % 5).alias("k"))
    cold = spark.range(0, 10).select(F.col("id").alias("k"))
    g_cells, g_names = B.to_cells(gold, task_id="t", table_name="x")
    h = B.to_cells(hot, run_id="hot", table_name="x")
    c = B.to_cells(cold, run_id="cold", table_name="x")
    runs = spark.createDataFrame([("hot", "t"), ("cold", "t")], "run_id string, task_id string")
    out = B.batch_grade(g_cells, g_names, B.union_all([h[0], c[0]]), B.union_all([h[1], c[1]]), runs).collect()
    assert {r.run_id: r.score for r in out} == {"hot": 1.0, "cold": 0.0}
    placed = P.with_positions(spark.range(0, 20_000).select((F.col("id") % 2).alias("k")), [F.col("k").asc()],
                              num_partitions=8)
    assert placed.select(F.countDistinct("pos"), F.max("pos")).first()[:] == (20_000, 19_999)


def test_tables_without_rows_are_known_by_name(spark):
    """An empty table pairs its columns by name; a table that no run produced has no row count."""
    gold = spark.createDataFrame([], "a string, b string")
    named = B.to_cells(gold, task_id="t", table_name="x")
    empty = B.to_cells(spark.createDataFrame([], "B int"), run_id="r", table_name="x")
    runs = spark.createDataFrame([("r", "t"), ("none", "t")], "run_id string, task_id string")
    out = {r.run_id: (r.score, r.matched_columns, r.total_columns, r.row_count_match)
           for r in B.batch_grade(*named, *empty, runs).collect()}
    assert out == {"r": (0.5, 1, 2, True), "none": (0.0, 0, 2, None)}


def test_no_rows_on_either_side_grade_to_nothing(spark):
    gold = B.to_cells(spark.createDataFrame([], "task_id string, a string"), ["task_id"], table_name="x")
    made = B.to_cells(spark.createDataFrame([], "run_id string, a int"), ["run_id"], table_name="x")
    runs = spark.createDataFrame([("r", "t")], "run_id string, task_id string")
    assert B.batch_grade(*gold, *made, runs).collect() == []
