"""Comparator queries: an expected table and perturbed actual tables built from the test data.

Customer pair (unique key, row-level outputs are deterministic):
  gold   = per-customer order summary, every column as text (as expected tables are read);
  actual = the same summary typed, columns reordered and renamed in case, with
           perturbations: spend x1.005 on every fifth customer (inside tolerance),
           priority upper-cased or padded (text rules), order count +1 on some
           customers (a failing column), an extra column, and one gold column absent.
Lineitem pair (large, with duplicate keys) feeds ``table_score``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fold_text, numeric_parse, strip_unicode, tolerant_equal
from ..operators import compare as C
from . import sqltext as S
from .registry import register, table

# ---------------------------------------------------------------- customer pair

CUSTOMER_KEYS = ["custkey"]

GOLD_CUSTOMER_SQL = """
SELECT CAST(o_custkey AS VARCHAR) AS custkey, CAST(count(*) AS VARCHAR) AS n_orders,
       printf('%.2f', round(sum(o_totalprice), 2)) AS spend,
       max(o_orderpriority) AS top_priority, min(o_orderstatus) AS status,
       strftime(min(o_orderdate), '%Y-%m-%d') AS first_order,
       'n' || CAST(o_custkey % 10 AS VARCHAR) AS clerk_note
FROM orders GROUP BY o_custkey"""
GOLD_CUSTOMER_COLS = [S.Col("custkey", "text"), S.Col("n_orders", "text"), S.Col("spend", "text"),
                      S.Col("top_priority", "text"), S.Col("status", "text"),
                      S.Col("first_order", "text"), S.Col("clerk_note", "text")]

ACTUAL_CUSTOMER_SQL = """
SELECT round(round(sum(o_totalprice), 2) * CASE WHEN o_custkey % 5 = 0 THEN 1.005 ELSE 1.0 END, 6) AS "SPEND",
       o_custkey AS custkey,
       CASE WHEN o_custkey % 3 = 0 THEN upper(max(o_orderpriority))
            WHEN o_custkey % 4 = 1 THEN '  ' || max(o_orderpriority)
            ELSE max(o_orderpriority) END AS top_priority,
       count(*) + CASE WHEN o_custkey % 50 = 7 THEN 1 ELSE 0 END AS n_orders,
       min(o_orderstatus) AS status, min(o_orderdate) AS first_order,
       'x' || CAST(o_custkey AS VARCHAR) AS note
FROM orders GROUP BY o_custkey"""
ACTUAL_CUSTOMER_COLS = [S.Col("SPEND", "double"), S.Col("custkey", "int"), S.Col("top_priority", "text"),
                        S.Col("n_orders", "int"), S.Col("status", "text"), S.Col("first_order", "date"),
                        S.Col("note", "text")]


def _customer_summary(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spend"),
        F.max("o_orderpriority").alias("pr"), F.min("o_orderstatus").alias("st"),
        F.min("o_orderdate").alias("first"))


def gold_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customer_summary(table(spark, sf_dir, "orders"))
    k = F.col("o_custkey")
    return s.select(
        k.cast("string").alias("custkey"), F.col("n").cast("string").alias("n_orders"),
        F.format_string("%.2f", F.col("spend")).alias("spend"),
        F.col("pr").alias("top_priority"), F.col("st").alias("status"),
        F.date_format("first", "yyyy-MM-dd").alias("first_order"),
        F.concat(F.lit("n"), (k % 10).cast("string")).alias("clerk_note"))


def actual_customer(spark: SparkSession, sf_dir: str, drop_every: int | None = None) -> DataFrame:
    s = _customer_summary(table(spark, sf_dir, "orders"))
    k = F.col("o_custkey")
    out = s.select(
        F.round(F.col("spend") * F.when(k % 5 == 0, F.lit(1.005)).otherwise(F.lit(1.0)), 6).alias("SPEND"),
        k.alias("custkey"),
        F.when(k % 3 == 0, F.upper("pr")).when(k % 4 == 1, F.concat(F.lit("  "), F.col("pr")))
         .otherwise(F.col("pr")).alias("top_priority"),
        (F.col("n") + F.when(k % 50 == 7, F.lit(1)).otherwise(F.lit(0))).alias("n_orders"),
        F.col("st").alias("status"), F.col("first").alias("first_order"),
        F.concat(F.lit("x"), k.cast("string")).alias("note"))
    if drop_every:
        out = out.where(k % drop_every != 0)
    return out


def typed_gold_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rendered as a typed table (no perturbation): should score 1.0."""
    s = _customer_summary(table(spark, sf_dir, "orders"))
    k = F.col("o_custkey")
    return s.select(k.alias("CustKey"), F.col("n").alias("n_orders"), F.col("spend"),
                    F.col("pr").alias("top_priority"), F.col("st").alias("status"),
                    F.col("first").alias("first_order"),
                    F.concat(F.lit("n"), (k % 10).cast("string")).alias("clerk_note"))


TYPED_GOLD_SQL = """
SELECT o_custkey AS "CustKey", count(*) AS n_orders, round(sum(o_totalprice), 2) AS spend,
       max(o_orderpriority) AS top_priority, min(o_orderstatus) AS status,
       min(o_orderdate) AS first_order, 'n' || CAST(o_custkey % 10 AS VARCHAR) AS clerk_note
FROM orders GROUP BY o_custkey"""
TYPED_GOLD_COLS = [S.Col("CustKey", "int"), S.Col("n_orders", "int"), S.Col("spend", "double"),
                   S.Col("top_priority", "text"), S.Col("status", "text"), S.Col("first_order", "date"),
                   S.Col("clerk_note", "text")]
SHORT_ACTUAL_SQL = f"SELECT * FROM ({ACTUAL_CUSTOMER_SQL}) WHERE custkey % 97 <> 0"


# ---------------------------------------------------------------- typed sort / positions

def _typed_sort_oracle() -> str:
    prof = S.profile_sql("a", ACTUAL_CUSTOMER_COLS)
    return (f"WITH a AS ({ACTUAL_CUSTOMER_SQL}), ap AS ({prof}) "
            f"SELECT CAST(_pos AS BIGINT) AS pos, custkey, n_orders FROM "
            f"({S.positioned_sql('a', ACTUAL_CUSTOMER_COLS, [], 'ap')})")


@register("typed_sort", oracle=_typed_sort_oracle())
def typed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual side sorted by its own columns (no keys: SPEND first, then custkey...)."""
    df, prof = C.positioned(actual_customer(spark, sf_dir), keys=None, keep=True)
    i_key, i_n = prof.names.index("custkey"), prof.names.index("n_orders")
    return df.select(F.col("_pos").alias("pos"), F.col(f"_c{i_key}").alias("custkey"),
                     F.col(f"_c{i_n}").alias("n_orders"))


def _positional_oracle() -> str:
    ctes = S.compare_ctes(GOLD_CUSTOMER_SQL, GOLD_CUSTOMER_COLS, ACTUAL_CUSTOMER_SQL,
                          ACTUAL_CUSTOMER_COLS, CUSTOMER_KEYS)
    pairs = {g.name: (i, g, j, a) for i, g, j, a in S.pairing(GOLD_CUSTOMER_COLS, ACTUAL_CUSTOMER_COLS)}
    return (f"WITH {ctes} SELECT CAST(_pos AS BIGINT) AS pos, custkey AS gold_custkey, "
            f"a_custkey AS actual_custkey, "
            f"{S.verdict_sql(*pairs['spend'])} AS spend_ok, "
            f"{S.verdict_sql(*pairs['n_orders'])} AS n_orders_ok, "
            f"{S.verdict_sql(*pairs['top_priority'])} AS top_priority_ok FROM pj")


@register("positional_join", oracle=_positional_oracle())
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row i of sorted gold next to row i of sorted actual, with per-cell verdicts."""
    with ThreadPoolExecutor(max_workers=2) as pool:
        g, a = (pool.submit(C.positioned, df, CUSTOMER_KEYS, keep=True)
                for df in (gold_customer(spark, sf_dir), actual_customer(spark, sf_dir)))
        (g_pos, gp), (a_pos, ap) = g.result(), a.result()
    plans = {p.gold_name: p for p in C.column_plan(gp, ap)}
    return C.paired(g_pos, a_pos).select(
        F.col("g._pos").alias("pos"),
        F.col(f"g._c{gp.names.index('custkey')}").alias("gold_custkey"),
        F.col(f"a._c{ap.names.index('custkey')}").alias("actual_custkey"),
        C.verdict_expr(plans["spend"], gp, ap).alias("spend_ok"),
        C.verdict_expr(plans["n_orders"], gp, ap).alias("n_orders_ok"),
        C.verdict_expr(plans["top_priority"], gp, ap).alias("top_priority_ok"))


# ---------------------------------------------------------------- profiles and column verdicts

def _profile_oracle() -> str:
    parts = []
    for side, sql, cols in (("gold", GOLD_CUSTOMER_SQL, GOLD_CUSTOMER_COLS),
                            ("actual", ACTUAL_CUSTOMER_SQL, ACTUAL_CUSTOMER_COLS)):
        for c in cols:
            t, n = S.text_of(c, "s"), S.num_of(c, "s")
            parts.append(f"SELECT '{side}' AS side, '{c.name}' AS column_name, "
                         f"CAST(count({t}) AS BIGINT) AS non_null, CAST(count({n}) AS BIGINT) AS numeric_values, "
                         f"count({t}) = count({n}) AS is_numeric FROM ({sql}) s")
    return " UNION ALL ".join(parts)


@register("numeric_profile", oracle=_profile_oracle())
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    sides = (("gold", gold_customer(spark, sf_dir)), ("actual", actual_customer(spark, sf_dir)))
    with ThreadPoolExecutor(max_workers=2) as pool:
        profiles = [(side, pool.submit(C.profile, df)) for side, df in sides]
    for side, done in profiles:
        _, prof = done.result()
        for i, name in enumerate(prof.names):
            rows.append((side, name, prof.non_null[i], prof.numeric[i], prof.is_numeric(i)))
    return spark.createDataFrame(rows, "side string, column_name string, non_null bigint, "
                                       "numeric_values bigint, is_numeric boolean")


def _column_match_oracle() -> str:
    ctes = S.compare_ctes(GOLD_CUSTOMER_SQL, GOLD_CUSTOMER_COLS, ACTUAL_CUSTOMER_SQL,
                          ACTUAL_CUSTOMER_COLS, CUSTOMER_KEYS)
    parts = []
    for i, g, j, a in S.pairing(GOLD_CUSTOMER_COLS, ACTUAL_CUSTOMER_COLS):
        if j is None:
            parts.append(f"SELECT '{g.name}' AS column_name, CAST(NULL AS VARCHAR) AS actual_column, "
                         f"'missing' AS mode, FALSE AS matched")
            continue
        mode = f"CASE WHEN (SELECT eq_num{i} FROM gp) AND (SELECT eq_num{j} FROM ap) THEN 'numeric' ELSE 'text' END"
        parts.append(f"SELECT '{g.name}' AS column_name, '{a.name}' AS actual_column, {mode} AS mode, "
                     f"coalesce((SELECT bool_and({S.verdict_sql(i, g, j, a)}) FROM pj), TRUE) AS matched")
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


@register("column_match", oracle=_column_match_oracle())
def column_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, gp, ap, _ = C.column_verdicts(gold_customer(spark, sf_dir), actual_customer(spark, sf_dir),
                                            CUSTOMER_KEYS)
    rows = [(p.gold_name, ap.names[p.actual_index] if p.actual_index is not None else None,
             "missing" if p.actual_index is None else ("numeric" if p.numeric else "text"), ok)
            for p, ok in verdicts]
    return spark.createDataFrame(rows, "column_name string, actual_column string, mode string, matched boolean")


def _filled_sql(sql: str, cols: list[S.Col], names: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c.name}' AS {names[0]}, count("{c.name}") AS {names[1]} FROM ({sql})"""
                              for c in cols)


@register("schema_match", oracle=f"""
WITH g AS ({_filled_sql(GOLD_CUSTOMER_SQL, GOLD_CUSTOMER_COLS, ("gold_column", "gold_filled"))}),
     a AS ({_filled_sql(ACTUAL_CUSTOMER_SQL, ACTUAL_CUSTOMER_COLS, ("actual_column", "actual_filled"))})
SELECT g.*, a.* FROM g LEFT JOIN a ON lower(g.gold_column) = lower(a.actual_column)""")
def schema_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold columns paired with actual columns by lower-cased name, with each column's non-null rows."""
    return C.schema_join(gold_customer(spark, sf_dir), actual_customer(spark, sf_dir))


# ---------------------------------------------------------------- whole scores

@register("compare_tables", oracle=" UNION ALL ".join(
    f"SELECT * FROM ({q})" for q in [
        S.score_sql("perturbed", GOLD_CUSTOMER_SQL, GOLD_CUSTOMER_COLS, ACTUAL_CUSTOMER_SQL,
                    ACTUAL_CUSTOMER_COLS, CUSTOMER_KEYS),
        S.score_sql("identical", GOLD_CUSTOMER_SQL, GOLD_CUSTOMER_COLS, TYPED_GOLD_SQL,
                    TYPED_GOLD_COLS, CUSTOMER_KEYS),
        S.score_sql("short", GOLD_CUSTOMER_SQL, GOLD_CUSTOMER_COLS, SHORT_ACTUAL_SQL,
                    ACTUAL_CUSTOMER_COLS, CUSTOMER_KEYS),
        S.score_sql("no_keys", GOLD_CUSTOMER_SQL, GOLD_CUSTOMER_COLS, ACTUAL_CUSTOMER_SQL,
                    ACTUAL_CUSTOMER_COLS, []),
    ]))
def compare_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = C.prepare(gold_customer(spark, sf_dir))
    scores = C.compare_many([
        ("perturbed", gold, actual_customer(spark, sf_dir), CUSTOMER_KEYS),
        ("identical", gold, typed_gold_customer(spark, sf_dir), CUSTOMER_KEYS),
        ("short", gold, actual_customer(spark, sf_dir, drop_every=97), CUSTOMER_KEYS),
        ("no_keys", gold, actual_customer(spark, sf_dir), None),
    ])
    return C.score_frame(spark, scores)


# ---------------------------------------------------------------- lineitem pair (large)

LINEITEM_KEYS = ["l_orderkey", "l_linenumber"]
GOLD_LINEITEM_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
       CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey,
       printf('%.2f', l_quantity) AS l_quantity, printf('%.2f', l_extendedprice) AS l_extendedprice,
       l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, printf('%.2f', l_discount) AS l_discount,
       printf('%.2f', l_tax) AS l_tax, l_linestatus
FROM lineitem"""
GOLD_LINEITEM_COLS = [S.Col(n, "text") for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                  "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate", "l_discount",
                                                  "l_tax", "l_linestatus")]
ACTUAL_LINEITEM_SQL = """
SELECT l_shipdate, l_returnflag AS "L_RETURNFLAG", l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_extendedprice * CASE WHEN l_orderkey % 7 = 3 THEN 1.004 ELSE 1.0 END AS l_extendedprice,
       l_quantity + CASE WHEN l_orderkey % 1000 = 17 THEN 1 ELSE 0 END AS l_quantity,
       l_tax, l_discount, lower(l_linestatus) AS l_linestatus
FROM lineitem"""
ACTUAL_LINEITEM_COLS = [S.Col("l_shipdate", "date"), S.Col("L_RETURNFLAG", "text"), S.Col("l_orderkey", "int"),
                        S.Col("l_linenumber", "int"), S.Col("l_partkey", "int"), S.Col("l_suppkey", "int"),
                        S.Col("l_extendedprice", "double"), S.Col("l_quantity", "double"),
                        S.Col("l_tax", "double"), S.Col("l_discount", "double"), S.Col("l_linestatus", "text")]


def gold_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(*[F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey",
                                                                    "l_suppkey")],
                     F.format_string("%.2f", "l_quantity").alias("l_quantity"),
                     F.format_string("%.2f", "l_extendedprice").alias("l_extendedprice"),
                     "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"),
                     F.format_string("%.2f", "l_discount").alias("l_discount"),
                     F.format_string("%.2f", "l_tax").alias("l_tax"), "l_linestatus")


def actual_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        "l_shipdate", F.col("l_returnflag").alias("L_RETURNFLAG"), "l_orderkey", "l_linenumber",
        "l_partkey", "l_suppkey",
        (F.col("l_extendedprice") * F.when(k % 7 == 3, F.lit(1.004)).otherwise(F.lit(1.0))).alias("l_extendedprice"),
        (F.col("l_quantity") + F.when(k % 1000 == 17, F.lit(1)).otherwise(F.lit(0))).alias("l_quantity"),
        "l_tax", "l_discount", F.lower("l_linestatus").alias("l_linestatus"))


@register("table_score", oracle=S.score_sql("lineitem", GOLD_LINEITEM_SQL, GOLD_LINEITEM_COLS,
                                            ACTUAL_LINEITEM_SQL, ACTUAL_LINEITEM_COLS, LINEITEM_KEYS))
def table_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.compare_tables(gold_lineitem(spark, sf_dir), actual_lineitem(spark, sf_dir), LINEITEM_KEYS)
    return C.score_frame(spark, [("lineitem", s)])


# ---------------------------------------------------------------- scalar rules over whole columns

_PARSE_INPUT = """
SELECT p_partkey,
       CASE p_partkey % 6 WHEN 0 THEN CAST(p_retailprice AS VARCHAR)
                          WHEN 1 THEN ' ' || CAST(p_size AS VARCHAR) || ' '
                          WHEN 2 THEN CAST(p_size AS VARCHAR) || 'd'
                          WHEN 3 THEN p_brand
                          WHEN 4 THEN '-' || CAST(p_size AS VARCHAR) || 'e2'
                          ELSE CASE WHEN p_size % 2 = 0 THEN 'inf' ELSE 'nan' END END AS raw
FROM part"""


def _parse_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 6
    raw = (F.when(k == 0, F.col("p_retailprice").cast("string"))
           .when(k == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
           .when(k == 2, F.concat(F.col("p_size").cast("string"), F.lit("d")))
           .when(k == 3, F.col("p_brand"))
           .when(k == 4, F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit("e2")))
           .otherwise(F.when(F.col("p_size") % 2 == 0, F.lit("inf")).otherwise(F.lit("nan"))))
    return p.select("p_partkey", raw.alias("raw"))


@register("numeric_parse", oracle=f"""
SELECT p_partkey, {S.num('raw')} AS parsed FROM ({_PARSE_INPUT})""")
def numeric_parse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient number parse of mixed text: plain numbers, padded, suffixed, words, inf, nan."""
    return _parse_input(spark, sf_dir).select("p_partkey", numeric_parse(F.col("raw")).alias("parsed"))


@register("tolerant_equal", oracle=f"""
SELECT c_custkey, {S.tol_eq('g', 'a')} AS equal_ab, {S.tol_eq('a', 'g')} AS equal_ba FROM (
  SELECT c_custkey, c_acctbal AS g,
         CASE WHEN c_custkey % 4 = 0 THEN c_acctbal * 1.0099
              WHEN c_custkey % 4 = 1 THEN c_acctbal * 1.0101
              WHEN c_custkey % 4 = 2 THEN NULL
              ELSE c_acctbal + 1e-10 END AS a
  FROM customer)""")
def tolerant_equal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asymmetric tolerance near its edge, in both argument orders, with nulls."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    a = (F.when(k == 0, F.col("c_acctbal") * 1.0099).when(k == 1, F.col("c_acctbal") * 1.0101)
         .when(k == 2, F.lit(None).cast("double")).otherwise(F.col("c_acctbal") + 1e-10))
    df = c.select("c_custkey", F.col("c_acctbal").alias("g"), a.alias("a"))
    return df.select("c_custkey", tolerant_equal(F.col("g"), F.col("a")).alias("equal_ab"),
                     tolerant_equal(F.col("a"), F.col("g")).alias("equal_ba"))


@register("text_normalize", oracle=f"""
SELECT doc_id, {S.fold('text')} AS folded, {S.fold('text')} = {S.fold('upper(text)')} AS case_insensitive_equal,
       length({S.strip('text')}) AS stripped_chars
FROM documents""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-document strip + case fold, and fold(text) against fold(upper(text))."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fold_text(F.col("text")).alias("folded"),
                    (fold_text(F.col("text")) == fold_text(F.upper("text"))).alias("case_insensitive_equal"),
                    F.length(strip_unicode(F.col("text"))).cast("long").alias("stripped_chars"))

