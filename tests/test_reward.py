"""End-to-end on the mini fixture: load, model, grade (1.0, 0.6 and 0.0 cases), isolation."""

import os
import contextlib
import io
import uuid

import pytest

from tablecheck.operators import batch as B
from tablecheck.operators import models as M
from tablecheck.operators import runlog as R
from tablecheck.sources import csv as CSV

# The fixture tables and the fixture model.
CUSTOMERS = "customer_id,customer_name\n1,Ada\n2,Ben\n3,Cy\n"
ORDERS = "order_id,customer_id,amount\n1,1,10\n2,1,5\n3,2,7\n"
GOLD = "customer_id,customer_name,order_count,total_spend\n1,Ada,2,15\n2,Ben,1,7\n3,Cy,0,0\n"
CORRECT = """SELECT c.customer_id, c.customer_name,
COUNT(o.order_id) AS order_count,
COALESCE(SUM(o.amount), 0) AS total_spend
FROM customers c LEFT JOIN orders o ON c.customer_id = o.customer_id
GROUP BY c.customer_id, c.customer_name"""
PARTIAL = "SELECT customer_id, customer_name FROM customers"


@pytest.fixture()
def fixture_dir(tmp_path):
    for name, text in (("customers", CUSTOMERS), ("orders", ORDERS), ("gold", GOLD)):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "part-0.csv").write_text(text)
    return tmp_path


STATE = ("run_id string, task_id string, submitted boolean, n_calls long, n_turns long, elapsed_s double, "
         "el_succeeded boolean, loaded array<string>, n_declared long, transform_ran boolean, materialized array<string>")


def _grade(spark, wh, gold, loaded, submitted=True, built=("customer_totals",)):
    """One run, through the batch operators: its tables as cells, its counts against the declared ones."""
    tasks = spark.createDataFrame([("t", ["customers", "orders"], ["customer_totals"])],
                                  "task_id string, declared array<string>, targets array<string>")
    state = spark.createDataFrame([("r", "t", submitted, 5, 5, 1.0, bool(loaded), sorted(loaded), 2, True, list(built))], STATE)
    counts = spark.createDataFrame([("r", n, 3, wh.count(n)) for n in ("customers", "orders")],
                                   "run_id string, table_name string, expected long, actual long")
    runs = spark.createDataFrame([("r", "t")], "run_id string, task_id string")
    g, a = B.to_cells(gold, task_id="t", table_name="customer_totals"), \
        B.to_cells(wh.fetch("customer_totals"), run_id="r", table_name="customer_totals")
    scores = B.batch_grade(*g, *a, runs)
    graded, per_target = R.grade_runs(state, tasks, scores, counts)
    metrics = {m.metric: m.value for m in R.run_metrics(graded, per_target).collect()}
    return graded.first().reward, metrics


def _run(spark, d, load=True, sql=CORRECT, **kw):
    wh = M.RunWarehouse(spark, "mini_" + uuid.uuid4().hex[:8])
    sources = {n: CSV.read_typed_csv(spark, str(d / n)) for n in ("customers", "orders")}
    loaded = list(wh.load(sources, ["customers", "orders"])) if load else []
    status = wh.run_models({"customer_totals": sql})
    return status, _grade(spark, wh, CSV.read_string_csv(spark, str(d / "gold")), loaded, **kw)


def test_correct_pipeline_scores_one(spark, fixture_dir):
    status, (reward, metrics) = _run(spark, fixture_dir)
    assert status["customer_totals"] == M.ModelStatus(3)
    assert reward == 1.0 and metrics["target_fraction"] == 1.0


def test_partial_columns_score_point_six(spark, fixture_dir):
    assert _run(spark, fixture_dir, sql=PARTIAL)[1][0] == pytest.approx(0.6)


def test_fabricated_table_without_load_scores_zero(spark, fixture_dir):
    assert _run(spark, fixture_dir, load=False, sql="SELECT 1 AS customer_id")[1][0] == 0.0


def test_short_source_fails_the_count_gate(spark, fixture_dir):
    wh = M.RunWarehouse(spark, "short_" + uuid.uuid4().hex[:8])
    sources = {n: CSV.read_typed_csv(spark, str(fixture_dir / n)) for n in ("customers", "orders")}
    wh.load(sources | {"orders": sources["orders"].limit(2)}, ["customers", "orders"])
    wh.run_models({"customer_totals": CORRECT})
    reward, metrics = _grade(spark, wh, CSV.read_string_csv(spark, str(fixture_dir / "gold")), ["customers", "orders"])
    assert reward == pytest.approx(0.1) and metrics["raw_fraction"] == 0.5


def test_unsubmitted_scores_zero(spark, fixture_dir):
    assert _run(spark, fixture_dir, submitted=False)[1] == (0.0, {"submitted": 0.0})


BYPASSES = ["SELECT `reflect`('java.lang.System', 'getProperty', 'user.name') AS u",
            "SELECT reflect/**/('java.lang.System', 'getProperty', 'user.name') AS u",
            "SELECT * FROM (MAP a USING 'cat' AS (b) FROM (SELECT 1 AS a) t) x",
            "SELECT * FROM (REDUCE a USING 'cat' AS (b) FROM (SELECT 1 AS a) t) x",
            "SELECT `try_reflect`('java.lang.System', 'getProperty', 'user.name') AS u"]


@pytest.mark.parametrize("sql", BYPASSES)
def test_host_code_is_refused_from_the_plan(spark, sql):
    with M.RunWarehouse(spark, "host_" + uuid.uuid4().hex[:8]) as wh:
        try:
            status = wh.run_models({"m": sql})["m"]
        except ValueError:
            return
        assert not status.ok and wh.fetch("m") is None


def test_unlisted_functions_and_operators_are_refused(spark):
    """What a session or a later Spark adds is refused without being named."""
    with M.RunWarehouse(spark, "list_" + uuid.uuid4().hex[:8]) as wh:
        wh.session.udf.register("run_on_host", lambda x: x, "string")
        for sql in ("SELECT run_on_host('ls') AS x", "SELECT 1 AS x WHERE EXISTS (SELECT run_on_host(a) FROM (SELECT 'b' AS a))",
                    "SELECT input_file_name() AS x", "SELECT * FROM python_worker_logs()",
                    "WITH t AS (SELECT `reflect`('a', 'b') AS y) SELECT * FROM t", "SELECT transform(array(1), x -> run_on_host(x)) AS y"):
            status = wh.run_models({"m": sql})["m"]
            assert "not_allowed" in status.error, sql
        good = ("SELECT k, sum(v) OVER (PARTITION BY k ORDER BY v) AS s, coalesce(upper(t), 'x') AS u, count(*) OVER () AS n "
                "FROM (SELECT id % 3 AS k, id AS v, CAST(id AS STRING) AS t FROM range(9)) q WHERE k IN (SELECT max(id) % 3 FROM range(4))")
        assert wh.run_models({"m": good})["m"] == M.ModelStatus(3)
        assert wh.run_models({"m": "SELECT explode(transform(array(1, 2), x -> x + 1)) AS e"})["m"].ok


def test_models_run_side_by_side_with_the_outcome_of_their_order(spark):
    models = {
        "base": "SELECT id AS k FROM range(10)", "left_side": "SELECT k, k * 2 AS d FROM base", "bad": "SELECT nope FROM base",
        "right_side": "SELECT k, k * 3 AS t FROM BASE WHERE k IN (SELECT k FROM base WHERE k > 4)",
        "meet": "WITH l AS (SELECT * FROM left_side) SELECT l.d, r.t FROM l JOIN right_side r ON l.k = r.k",
        "reads_bad": "SELECT * FROM bad", "old": "SELECT count(*) AS n FROM src", "src": "SELECT 7 AS k",
        "new": "SELECT count(*) AS n FROM src"}
    for parallel in (1, 4):
        with M.RunWarehouse(spark, f"graph{parallel}_" + uuid.uuid4().hex[:8]) as wh:
            wh.write_table("src", spark.range(5))
            status = wh.run_models(models, parallel=parallel)
            assert list(status) == list(models)
            assert [s.rows for s in status.values()] == [10, 10, None, 5, 5, None, 1, 1, 1]
            assert wh.fetch("old").first().n == 5 and wh.fetch("new").first().n == 1
            assert sorted(tuple(r) for r in wh.fetch("meet").collect()) == [(2 * k, 3 * k) for k in range(5, 10)]
            assert wh.references(models["meet"]) == {"l", "left_side", "right_side"}


def test_model_replaces_a_source_of_its_name(spark):
    with M.RunWarehouse(spark, "src_" + uuid.uuid4().hex[:8]) as wh:
        wh.register_parquet("nation", "/root/testdata/sf0.001/nation.parquet")
        status = wh.run_models({"nation": "SELECT max(n_nationkey) AS top FROM nation", "n2": "SELECT * FROM nation"})
        assert [s.rows for s in status.values()] == [1, 1]
        assert wh.fetch("nation").columns == ["top"] and wh.fetch("n2").first().top == 24
        assert wh.fetch("n2", evaluation="SELECT top + 1 AS t FROM n2").first().t == 25
        database = wh.database
    assert not spark.catalog.databaseExists(database)


def test_file_reads_and_non_select_refused(spark, fixture_dir):
    wh = M.RunWarehouse(spark, "guard_" + uuid.uuid4().hex[:8])
    status = wh.run_models({"leak": f"SELECT * FROM csv.`{fixture_dir / 'gold'}`"})
    assert not status["leak"].ok
    assert wh.fetch("leak") is None
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "", "SELECT reflect('java.lang.System', 'exit', '0')"):
        with pytest.raises(ValueError):
            wh.run_models({"m": bad})
    with pytest.raises(ValueError):
        wh.run_models({"bad name": "SELECT 1"})


def test_model_can_replace_itself_and_failures_keep_old_table(spark):
    wh = M.RunWarehouse(spark, "self_" + uuid.uuid4().hex[:8])
    assert wh.run_models({"t": "SELECT 1 AS x"}) == {"t": M.ModelStatus(1)}
    assert wh.run_models({"t": "SELECT x + 1 AS x FROM t UNION ALL SELECT 5"}) == {"t": M.ModelStatus(2)}
    assert wh.run_models({"t": "SELECT nope FROM t"})["t"].error
    assert sorted(r.x for r in wh.fetch("t").collect()) == [2, 5]


def test_runs_are_isolated(spark, fixture_dir):
    a = M.RunWarehouse(spark, "iso_a_" + uuid.uuid4().hex[:8])
    b = M.RunWarehouse(spark, "iso_b_" + uuid.uuid4().hex[:8])
    a.load({"customers": CSV.read_typed_csv(spark, str(fixture_dir / "customers"))}, ["customers"])
    assert a.exists("customers") and not b.exists("customers")
    assert a.count("customers") == 3 and b.count("customers") is None


def test_load_refusals(spark, fixture_dir):
    wh = M.RunWarehouse(spark, "ref_" + uuid.uuid4().hex[:8])
    src = {"customers": CSV.read_typed_csv(spark, str(fixture_dir / "customers"))}
    with pytest.raises(ValueError):
        wh.load(src, ["returns"])
    with pytest.raises(ValueError):
        wh.load(src, [])
    with pytest.raises(ValueError):
        wh.load(None, ["customers"])


def test_preview_clamps_limit(spark):
    wh = M.RunWarehouse(spark, "prev_" + uuid.uuid4().hex[:8])
    assert wh.preview("SELECT id FROM range(100)", limit=50).count() == 20
    assert wh.preview("SELECT id FROM range(100)", limit=0).count() == 1
    assert wh.preview("SELECT id FROM range(100)").count() == 10
    assert wh.preview_json("SELECT id FROM range(3) ORDER BY id") == '[{"id":0},{"id":1},{"id":2}]'
    assert wh.preview_json("SELECT 1 AS a, 2 AS a, NULL AS b") == '[{"a":2,"b":null}]'


def test_counts_come_from_footers(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "a"))
    spark.range(0).write.parquet(str(tmp_path / "b"))
    df = M.file_counts(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")})
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("formatted")
    assert shown.getvalue().count("PushedAggregation: [COUNT(*)]") >= 1 and "ReadSchema: struct<count(*):bigint>" in shown.getvalue()
    assert {r.table_name: r.row_count for r in df.collect()} == {"a": 1000, "b": 0}
