"""Loading, materialising and counting queries over the star tables.

CSV and JSON sources are landed by Spark from the test tables into a fresh folder
under the shared checkpoint folder, then read back through the source operators,
so the whole table goes through the text path every time.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import NULL_TOKENS
from ..operators import models as M
from ..session import materialize, scratch_path
from ..sources import csv as CSV
from ..sources import records as REC
from .registry import register, table

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
NULL_TOKENS_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t in NULL_TOKENS)


def _tokens_sql(col: str) -> str:
    return f"CASE WHEN {col} IN ({NULL_TOKENS_SQL}) THEN NULL ELSE {col} END"


@register("raw_counts", oracle=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {t}" for t in STAR))
def raw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count of every star table from its files' footers, one pushed aggregate per table in one union."""
    return M.file_counts(spark, {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in STAR})


# Expected counts come from the keys, not from counting rows: the first and last key of the
# tables whose keys run on, the distinct keys of lineitem, its order keys for orders.  The
# supplier is declared one too many, and a 'returns' table is declared but never loaded.
KEYED = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
RECONCILE_SQL = f"""
WITH actual AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in STAR)}),
expected AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, max({k}) - min({k}) + 1 + {int(t == 'supplier')} AS n FROM {t}"
                                 for t, k in KEYED.items())}
             UNION ALL SELECT 'orders', count(DISTINCT l_orderkey) FROM lineitem
             UNION ALL SELECT 'lineitem', count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) FROM lineitem
             UNION ALL SELECT 'returns', count(*) FROM lineitem WHERE l_returnflag = 'R')
SELECT e.table_name, CAST(e.n AS BIGINT) AS expected, CAST(a.n AS BIGINT) AS actual,
       coalesce(a.n = e.n, FALSE) AS matches
FROM expected e LEFT JOIN actual a ON e.table_name = a.table_name"""


@register("raw_count_reconcile", oracle=RECONCILE_SQL)
def raw_count_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared expected counts joined to loaded counts; a missing table never matches."""
    actual = M.table_counts({t: table(spark, sf_dir, t) for t in STAR})
    lineitem = table(spark, sf_dir, "lineitem")
    manifest = [table(spark, sf_dir, t).agg((F.max(k) - F.min(k) + 1 + int(t == "supplier")).alias("expected"))
                .select(F.lit(t).alias("table_name"), "expected") for t, k in KEYED.items()]
    for name, rows in (("orders", lineitem.select("l_orderkey").distinct()),
                       ("lineitem", lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()),
                       ("returns", lineitem.where(F.col("l_returnflag") == "R"))):
        manifest.append(rows.agg(F.count(F.lit(1)).alias("expected")).select(F.lit(name).alias("table_name"), "expected"))
    expected = manifest[0]
    for part in manifest[1:]:
        expected = expected.unionByName(part)
    return (expected.join(actual, "table_name", "left")
            .select("table_name", F.col("expected").cast("long").alias("expected"),
                    F.col("row_count").cast("long").alias("actual"),
                    F.coalesce(F.col("row_count") == F.col("expected"), F.lit(False)).alias("matches")))


def _land_csv(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = scratch_path(spark, f"csv-{name}")
    CSV.write_csv(table(spark, sf_dir, name), path)
    return path


@register("declared_load_counts", oracle=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS loaded_rows FROM {t}" for t in STAR))
def declared_load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land every star table as CSV, load the declared set into a fresh run database
    (typed CSV scan + full overwrite), and report the loaded counts."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        paths = dict(zip(STAR, pool.map(lambda t: _land_csv(spark, sf_dir, t), STAR)))
        typed = dict(zip(STAR, pool.map(lambda t: CSV.read_typed_csv(spark, paths[t]), STAR)))
    with M.RunWarehouse(spark, "load_" + uuid.uuid4().hex[:12]) as wh:
        loaded = wh.load(typed, list(STAR))
    return spark.createDataFrame([(t, n) for t, n in loaded.items()], "table_name string, loaded_rows bigint")


@register("csv_typed_scan", oracle="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""")
def csv_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders written as CSV and read back with whole-column type inference (dates stay text)."""
    return CSV.read_typed_csv(spark, _land_csv(spark, sf_dir, "orders"))


@register("csv_string_scan", oracle=f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_tokens_sql('text')} AS text, {_tokens_sql('lang')} AS lang,
       {_tokens_sql('source')} AS source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""")
def csv_string_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents (quotes, line breaks, whole texts) written as CSV and read back as all-text."""
    return CSV.read_string_csv(spark, _land_csv(spark, sf_dir, "documents"))


@register("json_records_load", oracle="""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events""")
def json_records_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events landed as JSON records (an API stream), read with a declared schema and loaded."""
    path = scratch_path(spark, "records-events")
    table(spark, sf_dir, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")) \
        .select("event_id", "ts", "user_id", "event_type", "value", "props").write.mode("overwrite").json(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.StringType()),
                           T.StructField("user_id", T.LongType()),
                           T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
                           T.StructField("props", T.StringType())])
    with M.RunWarehouse(spark, "api_" + uuid.uuid4().hex[:12]) as wh:
        wh.load({"events": REC.read_records(spark, path, schema)}, ["events"])
        return materialize(wh.fetch("events"), "loaded-events")


MANIFEST_SQL = """
SELECT n.n_name AS task_id, t.table_name, CAST(coalesce(c.n, 0) AS BIGINT) AS expected
FROM nation n
CROSS JOIN (VALUES ('customer'), ('supplier')) t(table_name)
LEFT JOIN (SELECT c_nationkey AS k, 'customer' AS table_name, count(*) AS n FROM customer GROUP BY 1
           UNION ALL SELECT s_nationkey, 'supplier', count(*) FROM supplier GROUP BY 1) c
  ON c.k = n.n_nationkey AND c.table_name = t.table_name"""


@register("expectations_explode", oracle=MANIFEST_SQL)
def expectations_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-nation task manifests as nested JSON text ``{task: {table: n}}``, parsed and exploded."""
    nation = table(spark, sf_dir, "nation")
    cust = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    supp = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("s"))
    # No broadcast hints: the per-nation counts are joined as they are, and adaptive
    # execution measures them at run time before choosing a broadcast join.
    docs = (nation.join(cust, nation["n_nationkey"] == cust["k"], "left").drop("k")
            .join(supp, nation["n_nationkey"] == supp["k"], "left")
            .select(F.to_json(F.create_map(F.col("n_name"), F.create_map(
                F.lit("customer"), F.coalesce("c", F.lit(0)), F.lit("supplier"), F.coalesce("s", F.lit(0)))))
                .alias("doc")))
    known = nation.select(F.col("n_name").alias("task_id"))
    return REC.explode_expectations(docs, "doc", known)


MODELS = {
    "nation_region": "SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n "
                     "JOIN region r ON n.n_regionkey = r.r_regionkey",
    "orders_by_region": "SELECT nr.r_name, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue "
                        "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
                        "JOIN nation_region nr ON c.c_nationkey = nr.n_nationkey GROUP BY nr.r_name",
    "customers_by_region": "SELECT nr.r_name, count(*) AS n_customers FROM customer c "
                           "JOIN nation_region nr ON c.c_nationkey = nr.n_nationkey GROUP BY nr.r_name",
    "broken": "SELECT no_such_column FROM nation",
    "after_broken": "SELECT * FROM broken",
    "regions": "SELECT o.r_name, o.n_orders, c.n_customers FROM orders_by_region o "
               "JOIN customers_by_region c ON o.r_name = c.r_name",
}


def _run_models(spark: SparkSession, sf_dir: str) -> tuple[M.RunWarehouse, dict[str, M.ModelStatus]]:
    wh = M.RunWarehouse(spark, "models_" + uuid.uuid4().hex[:12])
    for t in ("nation", "region", "customer", "orders"):
        wh.register_parquet(t, f"{sf_dir.rstrip('/')}/{t}.parquet")
    return wh, wh.run_models(MODELS)


NATION_REGION_SQL = "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"
ORDERS_SQL = """SELECT r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
CUSTOMERS_SQL = """SELECT r_name, count(*) AS n_customers FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""


@register("materialize_models", oracle=f"""
SELECT 'nation_region' AS model_name, TRUE AS ok, n_nationkey || '|' || n_name || '|' || r_name AS contents FROM ({NATION_REGION_SQL})
UNION ALL SELECT 'orders_by_region', TRUE, r_name || '|' || n_orders || '|' || CAST(round(revenue * 100) AS BIGINT) FROM ({ORDERS_SQL})
UNION ALL SELECT 'customers_by_region', TRUE, r_name || '|' || n_customers FROM ({CUSTOMERS_SQL})
UNION ALL SELECT 'regions', TRUE, r_name || '|' || n_orders || '|' || n_customers FROM ({ORDERS_SQL}) JOIN ({CUSTOMERS_SQL}) USING (r_name)
UNION ALL SELECT 'broken', FALSE, NULL UNION ALL SELECT 'after_broken', FALSE, NULL""")
def materialize_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain, a fan of two models that meet again, a failing model and one that reads it: rows of every model."""
    wh, status = _run_models(spark, sf_dir)
    shown = {"orders_by_region": {"revenue": F.round(F.col("revenue") * 100).cast("long")}}
    with wh:
        parts = []
        for name, s in status.items():
            df = wh.fetch(name) if s.ok else spark.range(1).select(F.lit(None).cast("string").alias("contents"))
            cells = [shown.get(name, {}).get(c, F.col(c)).cast("string") for c in df.columns]
            text = F.concat_ws("|", *cells) if s.ok else F.col("contents")
            parts.append(df.select(F.lit(name).alias("model_name"), F.lit(s.ok).alias("ok"), text.alias("contents")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return materialize(out, "models")


@register("table_scan", oracle="""
SELECT r.r_name, CAST(count(*) AS BIGINT) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan of a materialised model by name (a missing name gives None, not an error)."""
    wh, _ = _run_models(spark, sf_dir)
    with wh:
        assert wh.fetch("no_such_model") is None
        df = wh.fetch("orders_by_region").select("r_name", F.col("n_orders").cast("long").alias("n_orders"), "revenue")
        return materialize(df, "scanned-model")


@register("preview_json", oracle="""
WITH q AS (SELECT r.r_name, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name)
SELECT substr('[' || string_agg('{"r_name":"' || r_name || '","n_orders":' || n_orders || ',"revenue_cents":'
  || CAST(round(revenue * 100) AS BIGINT) || '}', ',' ORDER BY r_name) || ']', 1, 4000) AS preview,
  least(20, (SELECT count(*) FROM orders)) AS preview_rows FROM q""")
def preview_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped preview (limit 50 asked, 20 given) of a model query as JSON records text."""
    wh, _ = _run_models(spark, sf_dir)
    with wh:
        text = wh.preview_json("SELECT r_name, n_orders, CAST(round(revenue * 100) AS BIGINT) AS revenue_cents "
                               "FROM orders_by_region ORDER BY r_name", limit=50)
        n = wh.preview("SELECT * FROM orders", limit=50).count()
    return spark.createDataFrame([(text, n)], "preview string, preview_rows bigint")
