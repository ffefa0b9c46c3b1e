"""Physical-plan properties of the flagship model query: filter and column pushdown."""

from tablecheck.plans import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_customer_totals_pushes_filter_and_prunes_columns(spark):
    df = QUERIES["customer_totals"](spark, "/root/testdata/sf0.001")
    plan = _plan(df)
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "o_orderdate" not in plan and "c_acctbal" not in plan
    assert df.count() > 0


def test_graded_run_queries_read_written_tables_not_the_raw_log(spark):
    # Rewards, metrics and group means are planned over the written run fold, batch
    # scores and event summaries, so none of them scans events.parquet again.
    for key in ("run_reward", "run_metrics", "group_advantage"):
        df = QUERIES[key](spark, "/root/testdata/sf0.001")
        files = df.inputFiles()
        assert files, key
        assert not any("events.parquet" in f for f in files), (key, files)
        assert df.count() > 0
