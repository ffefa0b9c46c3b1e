"""CSV typing rules, text checks, redaction and routing pieces."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions import text as TX
from tablecheck.operators import guard as G
from tablecheck.sources import csv as CSV


def _csv(tmp_path, text, name="src"):
    d = tmp_path / name
    d.mkdir()
    (d / "part-0.csv").write_text(text)
    return str(d)


def test_typed_csv_inference(spark, tmp_path):
    text = ("i,i_null,f,b,d,s,n,u,a,a\n"
            "1,1,1.5,True,2024-01-01,x,NA,18446744073709551615,p,q\n"
            "2,,2,false,2024-01-02,None,null,1,r,s\n"
            "-3,3,inf,TRUE,2024-01-03,\"y, \"\"z\"\"\",,2,t,u\n")
    df = CSV.read_typed_csv(spark, _csv(tmp_path, text))
    types = {f.name: f.dataType for f in df.schema.fields}
    assert df.columns == ["i", "i_null", "f", "b", "d", "s", "n", "u", "a", "a.1"]
    assert types["i"] == T.LongType() and types["i_null"] == T.DoubleType()
    assert types["f"] == T.DoubleType() and types["b"] == T.BooleanType()
    assert types["d"] == T.StringType() and types["s"] == T.StringType()
    assert types["n"] == T.DoubleType() and types["u"] == T.DecimalType(20, 0)
    rows = df.orderBy("i").collect()
    assert [r.s for r in rows] == ['y, "z"', "x", None]
    assert rows[0].f == float("inf") and rows[2].b is False


def test_string_csv_quotes_and_line_breaks(spark, tmp_path):
    text = 'a,b\n"line1\nline2","  padded  "\nNA,-\n'
    rows = CSV.read_string_csv(spark, _csv(tmp_path, text)).collect()
    assert rows[0].a == "line1\nline2" and rows[0].b == "  padded  "
    assert rows[1].a is None and rows[1].b == "-"


def test_repeated_and_case_variant_headers(spark, tmp_path):
    df = CSV.read_typed_csv(spark, _csv(tmp_path, "ID,id,a,a,a.1\n1,x, 2, 2.5,3\n"))
    assert df.columns == ["ID", "id", "a", "a.1", "a.1.1"]
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "bigint", "double", "bigint"]
    assert tuple(df.first()) == (1, "x", 2, 2.5, 3)


def test_over_long_row_raises(spark, tmp_path):
    df = CSV.read_string_csv(spark, _csv(tmp_path, "a,b\n1,2\n3,4,5\n"))
    with pytest.raises(Exception):
        df.collect()


def test_short_row_is_padded(spark, tmp_path):
    rows = CSV.read_string_csv(spark, _csv(tmp_path, "a,b\n1\n")).collect()
    assert rows[0].a == "1" and rows[0].b is None


def test_select_only_reasons(spark):
    cases = [("SELECT 1", None), ("  with q as (select 1) select * from q", None), ("", "empty"),
             ("   ", "empty"), ("SELECT 1; SELECT 2", "semicolon"), ("select 'a;b'", "semicolon"),
             ("DELETE FROM t", "not_select"), ("SELECTX 1", "not_select"), ("EXPLAIN SELECT 1", "not_select"),
             ("SELECT reflect('java.lang.System', 'exit', '0')", "host_code"),
             ("SELECT TRANSFORM(a) USING 'cat' FROM t", "host_code")]
    df = spark.createDataFrame(cases, "sql string, want string")
    for r in df.select("want", G.model_sql_reason(F.col("sql")).alias("got")).collect():
        assert r.got == r.want


def test_identifier_rule(spark):
    cases = [("abc", True), ("_a1", True), ("1a", False), ("a-b", False), ("abc\n", False), ("", False),
             ("Customer#1", False)]
    df = spark.createDataFrame(cases, "n string, want boolean")
    assert all(r.got == r.want for r in df.select("want", G.identifier_ok(F.col("n")).alias("got")).collect())


def test_plan_policy(spark):
    ok = 'provider "airbyte" {}\nresource "airbyte_source_file" "x" { url = local.cfg.flat_files[0].path }'
    cases = [(ok, None), ('resource "aws_s3_bucket" "b" {}', "resource_type"),
             ('provider "aws" {}', "provider"), ('data "http" "x" {}', "data_source"),
             ('module "m" {}', "forbidden:module"), ('output "x" {}', "forbidden:output \""),
             (ok + ' password = "hunter22"', "embedded_secret"), ("x" * 100_001, "too_large")]
    df = spark.createDataFrame(cases, "plan string, want string")
    secrets = F.array(F.lit("hunter22"), F.lit("abc"))
    for r in df.select("want", G.plan_violation(F.col("plan"), secrets).alias("got")).collect():
        assert r.got == r.want


def test_plan_policy_names_every_violation(spark):
    both = 'module "m" {}\nresource "aws_x" "y" { provisioner "local-exec" {} key = "hunter22" }'
    rows = spark.createDataFrame([(both,), (None,), ("",), ('provider "airbyte" {}',)], "plan string")
    got = [r.got for r in rows.select(G.plan_violations(F.col("plan"), F.array(F.lit("hunter22"), F.lit("abc"))).alias("got")).collect()]
    assert got == [["forbidden:provisioner", "forbidden:local-exec", "forbidden:module", "resource_type", "embedded_secret"],
                   None, [], []]


def test_namespace_and_redaction(spark):
    df = spark.createDataFrame([("select * FROM  db.t join X.y on 1=1 from z",)], "q string")
    assert df.select(TX.qualify_namespace(F.col("q"))).first()[0] == \
        "select * FROM db.AIRBYTE_SCHEMA.t join X.AIRBYTE_SCHEMA.y on 1=1 from z"
    df = spark.createDataFrame([("pw is s3cret and s3cret", ["s3cret", "", None])], "t string, s array<string>")
    assert df.select(TX.redact_literals(F.col("t"), F.col("s"))).first()[0] == "pw is [REDACTED] and [REDACTED]"
    cfg = spark.createDataFrame([({"user": "u", "Password": "p"}, [{"token": "t", "k": "v"}])],
                                "m map<string,string>, l array<map<string,string>>")
    m = TX.redact_by_key(F.col("m"), cfg.schema["m"].dataType)
    lst = TX.redact_by_key(F.col("l"), cfg.schema["l"].dataType)
    row = cfg.select(m.alias("m"), lst.alias("l")).first()
    assert row.m == {"user": "u", "Password": "[configured]"}
    assert row.l == [{"token": "[configured]", "k": "v"}]


def test_map_values_of_any_type_are_redacted(spark):
    df = spark.sql("""SELECT map('access_key', array('AKIA1'), 'k', array('v')) AS a, map('client_id', 42, 'n', 7) AS b,
                             map('secret', named_struct('a', 's3cr'), 'o', named_struct('a', 'x')) AS c""")
    row = df.select(*[TX.redact_by_key(F.col(c), df.schema[c].dataType).alias(c) for c in "abc"]).first()
    assert row.a == {"access_key": "[configured]", "k": '["v"]'}
    assert row.b == {"client_id": "[configured]", "n": "7"}
    assert row.c == {"secret": "[configured]", "o": '{"a":"x"}'}


def test_expectations_of_unknown_tasks_raise(spark):
    from tablecheck.sources.records import explode_expectations
    docs = spark.createDataFrame([('{"t1": {"a": 1}}',)], "doc string")
    known = spark.createDataFrame([("t1",)], "task_id string")
    assert [tuple(r) for r in explode_expectations(docs, "doc", known).collect()] == [("t1", "a", 1)]
    more = docs.union(spark.createDataFrame([('{"zz": {"a": 1}}',)], "doc string"))
    with pytest.raises(Exception, match="zz"):
        explode_expectations(more, "doc", known).collect()


def test_routing_refuses_formats_and_paths(spark):
    from tablecheck.operators.routing import connections, route_sources
    selected = spark.createDataFrame([(1, "cars"), (1, "train"), (2, "train"), (3, "train"), (4, "zz"), (5, "cars")],
                                     "run_id long, table_name string")
    api = spark.createDataFrame([(r, "cars") for r in range(1, 6)], "run_id long, table_name string")
    files = spark.createDataFrame([(1, "train", "csv", "/local/t.csv"), (2, "train", "csv", "http://x/t.csv"),
                                   (3, "train", "json", "https://x/t"), (5, "cars", "csv", "https://x/c.csv")],
                                  "run_id long, table_name string, format string, path string")
    routes = route_sources(selected, api, files)
    assert {(r.run_id, r.refused) for r in routes.collect() if r.refused} == {(2, "path"), (3, "format"), (4, "no_source")}
    got = {(r.run_id, r.connection, r.provider, tuple(r.streams)) for r in connections(routes).collect()}
    assert got == {(1, "api", "custom_api", ("cars",)), (1, "train", "local_filesystem_limited", ("train",)),
                   (5, "api", "custom_api", ("cars",)), (5, "cars", "https_public_web", ("cars",))}


def test_data_model_documents(spark, tmp_path):
    from tablecheck.sources.datamodel import read_data_models
    (tmp_path / "a.yaml").write_text("task_id: t\nmodels:\n  - name: m\n    columns:\n      - {name: x, description: d}\n")
    assert [tuple(r) for r in read_data_models(spark, str(tmp_path)).collect()] == [("t", "m", "x", "d")]
