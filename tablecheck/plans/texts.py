"""Checks and rewrites over whole texts of the test tables.

Submitted SQL, plan files, evaluation queries and logs are built from whole
``documents``, ``pages`` and ``conversations`` texts (a fixed prefix or wrapper per
row, chosen by the row id), so every check runs over every full text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as SC
from ..functions import text as TX
from ..operators import guard as G
from ..operators.routing import connections, route_sources
from . import actions as A
from . import sqltext as S
from .registry import register, table


def _q(s: str) -> str:
    return s.replace("'", "''")


# ---------------------------------------------------------------- submitted SQL

SUBMISSIONS_SQL = """
SELECT doc_id, CASE doc_id % 6
  WHEN 0 THEN 'SELECT count(*) FROM documents WHERE text = ''' || replace(text, '''', '''''') || ''''
  WHEN 1 THEN '   with t AS (SELECT 1) SELECT * FROM t -- ' || text
  WHEN 2 THEN 'DELETE FROM documents -- ' || text
  WHEN 3 THEN 'SELECT reflect(''java.lang.Runtime'', ''getRuntime'') -- ' || text
  WHEN 4 THEN repeat(' ', CAST(doc_id % 3 AS INTEGER))
  ELSE 'SELECTX ' || text END AS sql
FROM documents"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 6
    sql = (F.when(k == 0, F.concat(F.lit("SELECT count(*) FROM documents WHERE text = '"),
                                   F.replace("text", F.lit("'"), F.lit("''")), F.lit("'")))
           .when(k == 1, F.concat(F.lit("   with t AS (SELECT 1) SELECT * FROM t -- "), "text"))
           .when(k == 2, F.concat(F.lit("DELETE FROM documents -- "), "text"))
           .when(k == 3, F.concat(F.lit("SELECT reflect('java.lang.Runtime', 'getRuntime') -- "), "text"))
           .when(k == 4, F.repeat(F.lit(" "), (F.col("doc_id") % 3).cast("int")))
           .otherwise(F.concat(F.lit("SELECTX "), "text")))
    return d.select("doc_id", sql.alias("sql"))


@register("sql_guard_scan", oracle=f"""
SELECT doc_id, CASE
  WHEN {S.strip('sql')} = '' THEN 'empty'
  WHEN strpos({S.strip('sql')}, ';') > 0 THEN 'semicolon'
  WHEN NOT regexp_matches({S.strip('sql')}, '^(?i:select|with)([^\\pL\\pN_]|$)') THEN 'not_select'
  WHEN regexp_matches(sql, '{_q(G.HOST_CODE_RE)}') THEN 'host_code' END AS reason
FROM ({SUBMISSIONS_SQL})""")
def sql_guard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SELECT-only rule (plus host-code refusal) over one submission per document."""
    return submissions(spark, sf_dir).select("doc_id", G.model_sql_reason(F.col("sql")).alias("reason"))


IDENT_SOURCES = [("part.p_name", "part", "p_name"), ("customer.c_name", "customer", "c_name"),
                 ("part.p_brand", "part", "p_brand"), ("nation.n_name", "nation", "n_name"),
                 ("events.event_type", "events", "event_type"), ("documents.source", "documents", "source")]


@register("identifier_check", oracle=" UNION ".join(
    [f"SELECT DISTINCT '{src}' AS source, {c} AS candidate, "
     f"coalesce(regexp_full_match({c}, '[A-Za-z_][A-Za-z0-9_]*'), FALSE) AS valid FROM {t}"
     for src, t, c in IDENT_SOURCES] +
    ["SELECT DISTINCT 'part.p_name_underscored', replace(p_name, ' ', '_'), "
     "coalesce(regexp_full_match(replace(p_name, ' ', '_'), '[A-Za-z_][A-Za-z0-9_]*'), FALSE) FROM part"]))
def identifier_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier syntax over distinct names drawn from several tables."""
    frames = [table(spark, sf_dir, t).select(F.lit(src).alias("source"), F.col(c).alias("candidate"))
              for src, t, c in IDENT_SOURCES]
    frames.append(table(spark, sf_dir, "part").select(
        F.lit("part.p_name_underscored").alias("source"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("candidate")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    out = out.distinct()
    return out.select("source", "candidate", G.identifier_ok(F.col("candidate")).alias("valid"))


# ---------------------------------------------------------------- plan files

PLANS_SQL = """
SELECT page_id, ['pw-' || CAST(page_id AS VARCHAR) || '-x', 'abc'] AS secrets, CASE page_id % 7
  WHEN 0 THEN 'resource "airbyte_source_file" "p' || CAST(page_id AS VARCHAR) || '" { html = <<EOT' || chr(10) || html || chr(10) || 'EOT }'
  WHEN 1 THEN 'provider "aws" {}' || chr(10) || html
  WHEN 2 THEN 'data "http" "x" {}' || chr(10) || html
  WHEN 3 THEN 'resource "null_resource" "x" { provisioner "local-exec" {} }' || html
  WHEN 4 THEN 'resource "airbyte_source_file" "x" { password = "pw-' || CAST(page_id AS VARCHAR) || '-x" }' || html
  WHEN 5 THEN repeat(html, 120)
  ELSE 'provider "airbyte" {}' || chr(10) || 'resource "airbyte_connection" "c" {}' || chr(10) || html END AS plan
FROM pages"""


def plan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 7
    pid = F.col("page_id").cast("string")
    nl = F.lit("\n")
    plan = (F.when(k == 0, F.concat(F.lit('resource "airbyte_source_file" "p'), pid, F.lit('" { html = <<EOT'), nl,
                                    "html", nl, F.lit("EOT }")))
            .when(k == 1, F.concat(F.lit('provider "aws" {}'), nl, "html"))
            .when(k == 2, F.concat(F.lit('data "http" "x" {}'), nl, "html"))
            .when(k == 3, F.concat(F.lit('resource "null_resource" "x" { provisioner "local-exec" {} }'), "html"))
            .when(k == 4, F.concat(F.lit('resource "airbyte_source_file" "x" { password = "pw-'), pid,
                                   F.lit('-x" }'), "html"))
            .when(k == 5, F.repeat("html", 120))
            .otherwise(F.concat(F.lit('provider "airbyte" {}'), nl, F.lit('resource "airbyte_connection" "c" {}'),
                                nl, "html")))
    secrets = F.array(F.concat(F.lit("pw-"), pid, F.lit("-x")), F.lit("abc"))
    return p.select("page_id", secrets.alias("secrets"), plan.alias("plan"))


def _plan_violation_sql() -> str:
    parts = ["WHEN length(plan) > 100000 THEN 'too_large'"]
    parts += [f"WHEN strpos(lower(plan), '{_q(w)}') > 0 THEN 'forbidden:{_q(w.strip())}'" for w in G.PLAN_FORBIDDEN]
    parts += [
        f"WHEN regexp_matches(plan, '{_q(G.PLAN_DATA_RE)}') THEN 'data_source'",
        f"WHEN coalesce(list_bool_or(list_transform(regexp_extract_all(plan, '{_q(G.PLAN_RESOURCE_RE)}', 1), "
        f"lambda r: NOT starts_with(r, 'airbyte_'))), FALSE) THEN 'resource_type'",
        f"WHEN coalesce(list_bool_or(list_transform(regexp_extract_all(plan, '{_q(G.PLAN_PROVIDER_RE)}', 1), "
        f"lambda p: p <> 'airbyte')), FALSE) THEN 'provider'",
        "WHEN (length(secrets[1]) >= 4 AND strpos(plan, secrets[1]) > 0) OR "
        "(length(secrets[2]) >= 4 AND strpos(plan, secrets[2]) > 0) THEN 'embedded_secret'",
    ]
    broken = ", ".join(f"CASE {p} END" for p in parts)
    return (f"SELECT page_id, CASE {' '.join(parts)} END AS violation, "
            f"array_to_string(list_filter([{broken}], lambda v: v IS NOT NULL), ',') AS violations FROM ({PLANS_SQL})")


@register("plan_policy_scan", oracle=_plan_violation_sql())
def plan_policy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policy violations of a plan file built around each whole page, and the first one."""
    found = plan_files(spark, sf_dir).select("page_id", G.plan_violations(F.col("plan"), F.col("secrets")).alias("found"))
    return found.select("page_id", F.get("found", 0).alias("violation"), F.array_join("found", ",").alias("violations"))


# ---------------------------------------------------------------- evaluation queries and logs

EVAL_SQL = """
SELECT conv_id, turn, 'SELECT * FROM task_' || CAST(conv_id % 15 AS VARCHAR) || '.daily_activity d JOIN   Task_'
  || CAST(conv_id % 7 AS VARCHAR) || '.type_summary t ON d.event_type = t.event_type WHERE note = '''
  || replace(text, '''', '''''') || '''' AS sql
FROM conversations"""


@register("namespace_rewrite", oracle=f"""
SELECT conv_id, turn, regexp_replace(sql, '\\b(FROM|JOIN)\\s+([A-Za-z_][A-Za-z0-9_]*)\\.([A-Za-z_][A-Za-z0-9_]*)',
  '\\1 \\2.AIRBYTE_SCHEMA.\\3', 'gi') AS rewritten
FROM ({EVAL_SQL})""")
def namespace_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation queries (one per conversation turn, whole text inside) qualified with the schema."""
    c = table(spark, sf_dir, "conversations")
    sql = F.concat(F.lit("SELECT * FROM task_"), (F.col("conv_id") % 15).cast("string"),
                   F.lit(".daily_activity d JOIN   Task_"), (F.col("conv_id") % 7).cast("string"),
                   F.lit(".type_summary t ON d.event_type = t.event_type WHERE note = '"),
                   F.replace("text", F.lit("'"), F.lit("''")), F.lit("'"))
    return c.select("conv_id", "turn", TX.qualify_namespace(sql).alias("rewritten"))


@register("log_truncate", oracle="""
SELECT doc_id, substring(text, 1, 4000) AS head_4000, right(text, 3000) AS tail_3000,
       substring(text, 1, 1200) AS head_1200, CAST(length(text) AS BIGINT) AS n_chars_total FROM documents""")
def log_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head and tail cuts of whole documents as the log and error texts are cut."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", SC.head(F.col("text"), 4000).alias("head_4000"),
                    SC.tail(F.col("text"), 3000).alias("tail_3000"), SC.head(F.col("text"), 1200).alias("head_1200"),
                    F.length("text").cast("long").alias("n_chars_total"))


@register("redact_literals", oracle="""
WITH s AS (SELECT conv_id, string_split(arg_min(text, turn), ' ')[3] AS s1, string_split(arg_min(text, turn), ' ')[5] AS s2
           FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn,
  CASE WHEN s.s2 IS NULL OR s.s2 = '' THEN r1 ELSE replace(r1, s.s2, '[REDACTED]') END AS redacted
FROM (SELECT c.*, CASE WHEN s.s1 IS NULL OR s.s1 = '' THEN c.text ELSE replace(c.text, s.s1, '[REDACTED]') END AS r1
      FROM conversations c JOIN s USING (conv_id)) c JOIN s USING (conv_id)""")
def redact_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's configured secrets (two words of its first turn) redacted in all its turns."""
    c = table(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t0"))
    words = F.split("t0", " ")
    secrets = first.select("conv_id", F.array(F.try_element_at(words, F.lit(3)),
                                              F.try_element_at(words, F.lit(5))).alias("secrets"))
    return (c.join(secrets, "conv_id")
            .select("conv_id", "turn", TX.redact_literals(F.col("text"), F.col("secrets")).alias("redacted")))


@register("redact_by_key", oracle="""
SELECT event_id, json_extract_string(props, '$.k') AS k, '[configured]' AS password, event_type AS region,
       '[configured]' AS api_token, 'u' || CAST(user_id AS VARCHAR) AS sf_user, '[configured]' AS sf_password,
       'ANALYST' AS sf_role, '[configured]' AS client_id, event_type AS t_name, '[configured]' AS t_access_key
FROM events""")
def redact_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested configuration per event with secret-looking keys replaced at every level."""
    e = table(spark, sf_dir, "events")
    cfg = F.struct(
        F.get_json_object("props", "$.k").alias("k"),
        F.concat(F.lit("pw"), F.col("event_id").cast("string")).alias("Password"),
        F.col("event_type").alias("region"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("api_token"),
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
                 F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("password"),
                 F.lit("ANALYST").alias("role")).alias("snowflake"),
        F.col("user_id").cast("string").alias("Client_ID"),
        F.array(F.create_map(F.lit("name"), F.col("event_type"), F.lit("access_key"),
                             F.concat(F.lit("ak"), F.col("event_id").cast("string")))).alias("tables"))
    df = e.select("event_id", cfg.alias("cfg"))
    dtype = df.schema["cfg"].dataType
    r = df.select("event_id", TX.redact_by_key(F.col("cfg"), dtype).alias("r"))
    return r.select("event_id", F.col("r.k").alias("k"), F.col("r.Password").alias("password"),
                    F.col("r.region").alias("region"), F.col("r.api_token").alias("api_token"),
                    F.col("r.snowflake.user").alias("sf_user"), F.col("r.snowflake.password").alias("sf_password"),
                    F.col("r.snowflake.role").alias("sf_role"), F.col("r.Client_ID").alias("client_id"),
                    F.col("r.tables")[0]["name"].alias("t_name"), F.col("r.tables")[0]["access_key"].alias("t_access_key"))


# ---------------------------------------------------------------- source routing

def _routing_config(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """API and file rows of every run: customers through the API, orders as a file (for some
    runs JSON, or at a plain http address), and customers as a file too for every fifth."""
    r = F.col("run_id")
    api = runs.select("run_id", F.lit("customers").alias("table_name"))
    orders = runs.select("run_id", F.lit("orders").alias("table_name"),
                         F.when(r % 10 == 7, F.lit("json")).otherwise(F.lit("csv")).alias("format"),
                         F.when(r % 3 == 0, F.lit("/local/orders.csv"))
                         .when(r % 3 == 1, F.lit("https://data.example.org/orders.csv"))
                         .otherwise(F.lit("http://data.example.org/orders.csv")).alias("path"))
    customers = runs.where(r % 5 == 0).select("run_id", F.lit("customers").alias("table_name"),
                                               F.lit("csv").alias("format"), F.lit("/local/customers.csv").alias("path"))
    return api, orders.unionByName(customers)


@register("source_routing", oracle=f"""
WITH a AS ({A.ACTIONS_SQL}),
sel AS (SELECT DISTINCT run_id, unnest(tables) AS table_name FROM a WHERE tool = 'configure_el'),
files AS (SELECT DISTINCT run_id, 'orders' AS table_name, CASE WHEN run_id % 10 = 7 THEN 'json' ELSE 'csv' END AS format,
            CASE WHEN run_id % 3 = 0 THEN '/local/orders.csv' WHEN run_id % 3 = 1 THEN 'https://data.example.org/orders.csv'
                 ELSE 'http://data.example.org/orders.csv' END AS path FROM a
          UNION ALL SELECT DISTINCT run_id, 'customers', 'csv', '/local/customers.csv' FROM a WHERE run_id % 5 = 0),
routes AS (
  SELECT run_id, table_name, 'api' AS connection, 'custom_api' AS provider, NULL AS refused FROM sel
  WHERE table_name = 'customers'
  UNION ALL
  SELECT run_id, table_name, CASE WHEN refused IS NULL THEN table_name END,
    CASE WHEN refused IS NULL THEN CASE WHEN path LIKE '/local/%' THEN 'local_filesystem_limited' ELSE 'https_public_web' END END,
    refused
  FROM (SELECT sel.*, f.path, CASE WHEN f.format <> 'csv' THEN 'format'
          WHEN NOT (f.path LIKE '/local/%' OR f.path LIKE 'https://%') THEN 'path' END AS refused
        FROM sel JOIN files f ON sel.run_id = f.run_id AND sel.table_name = f.table_name)
  UNION ALL
  SELECT run_id, table_name, NULL, NULL, 'no_source' FROM sel WHERE table_name <> 'customers' AND NOT EXISTS
    (SELECT 1 FROM files f WHERE f.run_id = sel.run_id AND f.table_name = sel.table_name))
SELECT run_id, connection, provider, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS streams,
       'full_refresh_overwrite' AS sync_mode, CAST(NULL AS VARCHAR) AS refused
FROM routes WHERE run_id NOT IN (SELECT run_id FROM routes WHERE refused IS NOT NULL) GROUP BY run_id, connection, provider
UNION ALL SELECT run_id, NULL, NULL, table_name, NULL, refused FROM routes WHERE refused IS NOT NULL""")
def source_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of every run whose selected tables can all be read, and the refusals of the others."""
    acts = A.actions_frame(spark, sf_dir).where(F.col("tool") == "configure_el")
    selected = acts.select("run_id", F.explode("tables").alias("table_name")).distinct()
    routes = route_sources(selected, *_routing_config(A.actions_frame(spark, sf_dir).select("run_id").distinct()))
    blank = F.lit(None).cast("string")
    accepted = connections(routes).select("run_id", "connection", "provider", F.array_join("streams", ",").alias("streams"),
                                          "sync_mode", blank.alias("refused"))
    refused = routes.where(F.col("refused").isNotNull()).select(
        "run_id", blank.alias("connection"), blank.alias("provider"), F.col("table_name").alias("streams"),
        blank.alias("sync_mode"), "refused")
    return accepted.unionByName(refused)
