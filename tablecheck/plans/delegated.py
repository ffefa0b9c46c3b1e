"""The reference pipeline's own model: customers with their order count and spend.

customer LEFT JOIN orders (priority '1-URGENT' in the ON clause, so some customers
have no match), COUNT of matched orders and COALESCE(SUM, 0) of their price.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import RunWarehouse
from ..session import materialize
from .registry import register, table


def customer_totals_frame(customer: DataFrame, orders: DataFrame) -> DataFrame:
    # Aggregate orders per customer before the join: the shuffle then carries one
    # partial row per (map task, customer) instead of every order, and the
    # aggregate's hash partitioning on the key is reused by the join.
    per_customer = (orders.where(F.col("o_orderpriority") == "1-URGENT")
                    .groupBy("o_custkey")
                    .agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("spend")))
    joined = customer.select("c_custkey", "c_name").join(
        per_customer, customer["c_custkey"] == per_customer["o_custkey"], "left")
    return (joined.groupBy("c_custkey", "c_name")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("order_count"),
                 F.round(F.coalesce(F.sum("spend"), F.lit(0.0)), 6).alias("total_spend"))
            .select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
                    "order_count", "total_spend"))


@register("customer_totals", oracle="""
SELECT c.c_custkey AS customer_id, c.c_name AS customer_name,
       CAST(COUNT(o.o_orderkey) AS BIGINT) AS order_count,
       ROUND(CAST(COALESCE(SUM(o.o_totalprice), 0) AS DOUBLE), 6) AS total_spend
FROM customer c
LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT'
GROUP BY c.c_custkey, c.c_name
""")
def customer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_totals_frame(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))


# Models exercising the SQL surface a pipeline reaches through the destination
# (joins of every kind, grouping sets, windows, set operations, CTEs, top-k).  Each
# is materialised through the run warehouse; the check is its row count and an
# integer checksum over one measure of its result.
CONFORMANCE_MODELS = {
    "inner_join_agg": ("SELECT o.o_orderpriority, count(*) AS n FROM orders o "
                       "JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderpriority", "n"),
    "right_join": ("SELECT n.n_name, count(s.s_suppkey) AS n FROM supplier s "
                   "RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name", "n"),
    "full_outer_join": ("SELECT c.c_custkey, o.o_orderkey FROM customer c FULL OUTER JOIN orders o "
                        "ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT'",
                        "coalesce(o_orderkey, 0) + coalesce(c_custkey, 0)"),
    "semi_join": ("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o "
                  "WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')", "c_custkey"),
    "anti_join": ("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o "
                  "WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')", "c_custkey"),
    "rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem "
               "GROUP BY ROLLUP (l_returnflag, l_linestatus)", "n"),
    "cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders "
             "GROUP BY CUBE (o_orderstatus, o_orderpriority)", "n"),
    "grouping_sets": ("SELECT p_brand, p_size, count(*) AS n FROM part "
                      "GROUP BY GROUPING SETS ((p_brand), (p_size), ())", "n"),
    "rank_window": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER "
                    "(PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t "
                    "WHERE rn = 1", "o_orderkey"),
    "running_window": ("SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey "
                       "ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k "
                       "FROM orders", "k"),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "k"),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "k"),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier", "k"),
    "cte_subquery": ("WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) "
                     "SELECT o_custkey, n FROM t WHERE n > (SELECT avg(n) FROM t)", "n"),
    "top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
              "o_orderkey"),
    "distinct_agg": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
                     "n"),
}
CONFORMANCE_TABLES = ("customer", "orders", "lineitem", "supplier", "nation", "part")


@register("delegated_sql_models", oracle=" UNION ALL ".join(
    f"SELECT '{name}' AS model_name, TRUE AS ok, CAST(count(*) AS BIGINT) AS row_count, "
    f"CAST(sum({measure}) AS BIGINT) AS checksum FROM ({sql}) q"
    for name, (sql, measure) in CONFORMANCE_MODELS.items()))
def delegated_sql_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delegated SQL surface, each model materialised in a run database (K1)."""
    wh = RunWarehouse(spark, "conf_" + uuid.uuid4().hex[:12])
    for t in CONFORMANCE_TABLES:
        wh.register_parquet(t, f"{sf_dir.rstrip('/')}/{t}.parquet")
    status = wh.run_models({name: sql for name, (sql, _) in CONFORMANCE_MODELS.items()})
    parts = []
    for name, (_, measure) in CONFORMANCE_MODELS.items():
        df = wh.fetch(name) if status[name].ok else None
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("model_name"), F.lit(False).alias("ok"),
                                                    F.lit(None).cast("long").alias("row_count"),
                                                    F.lit(None).cast("long").alias("checksum")))
            continue
        parts.append(df.agg(F.lit(name).alias("model_name"), F.lit(True).alias("ok"),
                            F.count(F.lit(1)).alias("row_count"),
                            F.sum(F.expr(measure)).cast("long").alias("checksum")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialize(out, "delegated")
    wh.close()
    return out
