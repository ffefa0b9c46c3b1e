"""Batch grading: every target table of every run scored in one set of Spark jobs.

Tables of different shapes travel as rows of cell arrays:

* ``to_cells(df, **ids)`` turns any typed table into rows ``(<ids>, names, cells)`` where
  ``cells`` is ``array<struct<l, n, s, m>>`` in column order (``l`` stripped
  lower-cased text, ``n`` number for equality, ``s`` number for sorting, ``m``
  detail of timestamps) and ``names`` the column names (a constant of the frame).
* gold tables are keyed by ``(task_id, table_name)`` and stored once; actual tables
  by ``(run_id, table_name)``; ``runs`` maps ``run_id`` to ``task_id``.

The comparison rules are those of :mod:`compare`, applied per group.  Both sides go
through the same steps together, told apart by a NULL ``run_id``: one write of all
cells, one grouped aggregate for all profiles (partial aggregation keeps a hot group
to one row per map task), one range exchange that numbers the rows of all groups (a
hot group is spread over many range partitions by its row keys).  Tables that cannot
match, as the row counts differ, are settled by their profiles and never sorted.  The
positional join is on ``(task_id, table_name, pos)`` (a key held by one gold row and
that task's runs), and only failing cells are exploded when the verdicts are folded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import tolerant_equal
from ..session import materialize
from .compare import _TIME_TYPES, TIME_WIDTHS, normal_columns
from .positions import with_positions

CELL = T.StructType([
    T.StructField("l", T.StringType()), T.StructField("n", T.DoubleType()),
    T.StructField("s", T.DoubleType()), T.StructField("m", T.IntegerType()),
])
FLAGS = T.ArrayType(T.StructType([
    T.StructField("i", T.IntegerType()), T.StructField("numeric", T.BooleanType()),
    T.StructField("sort_numeric", T.BooleanType()), T.StructField("detail", T.IntegerType()),
]))


def to_cells(df: DataFrame, id_cols: list[str] = (), **literal_ids: str) -> tuple[DataFrame, DataFrame]:
    """Cell rows ``(ids..., names, cells)`` and the named tables of ``df``.

    ``id_cols`` are columns of ``df`` naming the group of each row (e.g. many runs'
    tables of one shape in one frame); ``literal_ids`` are constant for the frame.
    Every other column becomes a cell, in order.  The second frame ``(ids..., names)``
    tells of a table even if it has no rows: one row where all ids are literals, none
    otherwise, as groups come from rows then.
    """
    id_cols = list(id_cols)
    data_cols = [c for c in df.columns if c not in id_cols]
    ndf, names, types = normal_columns(df.select(*id_cols, *data_cols), keep=True)
    n_id = len(id_cols)
    cells = F.array(*[F.struct(F.col(f"_l{i}").alias("l"), F.col(f"_n{i}").alias("n"),
                               F.col(f"_sn{i}").alias("s"),
                               (F.col(f"_m{i}") if isinstance(t, _TIME_TYPES)
                                else F.lit(None).cast("int")).alias("m"))
                      for i, t in enumerate(types) if i >= n_id]).cast(T.ArrayType(CELL))
    headed = F.array(*[F.lit(n) for n in names[n_id:]]).cast("array<string>").alias("names")
    literals = [F.lit(v).alias(k) for k, v in literal_ids.items()]
    rows = ndf.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(id_cols)], *literals, headed, cells.alias("cells"))
    if id_cols:
        return rows, rows.select(*id_cols, *literal_ids, "names").limit(0)
    return rows, df.sparkSession.range(1).select(*literals, headed)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _profiles(cells: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Per group: ``names``, ``n_rows`` and ``flags`` (each column's profile: wholly numeric
    for equality, for sorting, detail of times), from one aggregate over rows of at most
    ``width`` cells.  Columns of an empty table are numeric by rule, as no value of theirs
    fails to parse."""
    aggs = [F.max("names").alias("names"), F.count("cells").alias("n_rows")]
    for i in range(width):
        c = F.get("cells", F.lit(i))
        aggs += [F.count(c["l"]).alias(f"l{i}"), F.count(c["n"]).alias(f"n{i}"), F.count(c["s"]).alias(f"s{i}"),
                 F.max(c["m"]).alias(f"m{i}")]
    flags = F.array(*[F.struct(F.lit(i).alias("i"), (F.col(f"l{i}") == F.col(f"n{i}")).alias("numeric"),
                               (F.col(f"l{i}") == F.col(f"s{i}")).alias("sort_numeric"), F.col(f"m{i}").alias("detail"))
                      for i in range(width)]).cast(FLAGS)
    return cells.groupBy(*keys).agg(*aggs).select(*keys, "names", "n_rows",
                                                  F.slice(flags, 1, F.size("names")).alias("flags"))


def _sort_plan(names: Column, keys: Column) -> Column:
    """Column indices in sort order: given keys first (case-insensitive, last duplicate
    name wins, absent skipped), then the remaining columns in table order."""
    lower = F.transform(names, lambda x: F.lower(x))
    n = F.size(names)
    key_idx = F.filter(F.transform(F.coalesce(keys, F.array().cast("array<string>")),
                                   lambda k: (n - F.array_position(F.reverse(lower), F.lower(k))).cast("int")),
                       lambda i: i < n)
    key_idx = F.array_distinct(key_idx).cast("array<int>")
    rest = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.array_contains(key_idx, i))
    return F.when(n > 0, F.concat(key_idx, rest)).otherwise(F.array().cast("array<int>"))


def _sort_key(plan: Column, flags: Column, cells: Column) -> Column:
    def elem(i):
        c = F.element_at(cells, i + 1)
        numeric = F.element_at(flags, i + 1)["sort_numeric"]
        return F.struct(
            c["l"].isNull().alias("z"),
            F.when(numeric, c["s"]).alias("v"),
            F.when(~numeric, c["l"]).alias("t"))
    return F.transform(plan, elem)


def _both_sides(gold_cells: DataFrame, gold_names: DataFrame, actual_cells: DataFrame,
                actual_names: DataFrame) -> tuple[DataFrame, int]:
    """All cell rows of both sides, written once, and the greatest number of columns.
    A table of ``*_names`` comes as a row without cells."""
    task_type, run_type = gold_cells.schema["task_id"].dataType, actual_cells.schema["run_id"].dataType

    def rows(df: DataFrame, gold: bool) -> DataFrame:
        own = {"names": F.lit(None).cast("array<string>"), "cells": F.lit(None).cast(T.ArrayType(CELL))}
        return df.select(
            F.col("task_id") if gold else F.lit(None).cast(task_type).alias("task_id"),
            F.lit(None).cast(run_type).alias("run_id") if gold else F.col("run_id"), "table_name",
            *[F.col(c) if c in df.columns else v.alias(c) for c, v in own.items()])

    seen = Observation()
    both = union_all([rows(gold_cells, True), rows(gold_names, True), rows(actual_cells, False), rows(actual_names, False)])
    both = both.observe(seen, F.max(F.size("names")).alias("width"))
    return materialize(both, "cells"), seen.get["width"] or 0


def _pairing(gprof: DataFrame, aprof: DataFrame) -> Column:
    """Per gold column: its actual column (by lower name, last wins) and compare mode."""
    g_names, a_names = gprof["names"], aprof["names"]
    a_lower = F.transform(a_names, lambda x: F.lower(x))
    n_a = F.size(a_names)

    def pair(name, i):
        pos = F.array_position(F.reverse(a_lower), F.lower(name))
        j = F.when(pos > 0, n_a - pos).cast("int")
        g_flag = F.element_at(gprof["flags"], i + 1)
        a_flag = F.element_at(aprof["flags"], j + 1)
        return F.struct(i.alias("gi"), j.cast("int").alias("aj"),
                        (g_flag["numeric"] & a_flag["numeric"]).alias("numeric"),
                        g_flag["detail"].alias("gdetail"), a_flag["detail"].alias("adetail"))
    return F.transform(g_names, pair)


def _cell_text(cells: Column, i: Column, detail: Column) -> Column:
    t = F.element_at(cells, i + 1)["l"]
    width = F.element_at(F.array(*map(F.lit, TIME_WIDTHS)), detail + 1)
    return F.replace(F.when(detail.isNotNull(), t.substr(F.lit(1), width)).otherwise(t), F.lit("ß"), F.lit("ss"))


def batch_grade(gold_cells: DataFrame, gold_names: DataFrame, actual_cells: DataFrame,
                actual_names: DataFrame, runs: DataFrame, sort_keys: DataFrame | None = None) -> DataFrame:
    """Score every (run, target table): ``(run_id, task_id, table_name, score, matched_columns,
    total_columns, row_count_match)``.  A target the run did not produce scores 0 with a
    NULL ``row_count_match``."""
    gk, ak, group = ["task_id", "table_name"], ["run_id", "table_name"], ["task_id", "run_id", "table_name"]
    cells, width = _both_sides(gold_cells, gold_names, actual_cells, actual_names)
    prof = materialize(_profiles(cells, group, width), "cell-profiles")
    gprof = prof.where("run_id IS NULL").drop("run_id")
    if sort_keys is None:
        gprof = gprof.withColumn("keys", F.lit(None).cast("array<string>"))
    else:
        gprof = gprof.join(sort_keys.select(*gk, "keys"), gk, "left")
    aprof = prof.where("run_id IS NOT NULL").drop("task_id")

    # One row per expected (run, target): gold profile, actual profile (may be missing).
    targets = runs.select("run_id", "task_id").join(
        gprof.select(*gk, "keys", F.col("names").alias("g_names"), F.col("n_rows").alias("g_rows"),
                     F.col("flags").alias("g_flags")), "task_id", "inner")
    targets = targets.join(aprof.select(*ak, F.col("names").alias("a_names"), F.col("n_rows").alias("a_rows"),
                                        F.col("flags").alias("a_flags")), ak, "left")
    g = F.struct(F.col("g_names").alias("names"), F.col("g_flags").alias("flags"))
    a = F.struct(F.col("a_names").alias("names"), F.col("a_flags").alias("flags"))
    targets = targets.withColumn("pairing", _pairing(g, a)).withColumn(
        "same_rows", F.col("a_rows").isNotNull() & (F.col("g_rows") == F.col("a_rows")))
    targets = materialize(targets, "graded-targets")

    comparable = targets.where("same_rows AND g_rows > 0")
    # each table to be sorted: its own key and its sort order
    own = [comparable.select(
        F.lit(None).cast(prof.schema["task_id"].dataType).alias("own_task"), F.col("run_id").alias("own_run"),
        "table_name", F.col("task_id").alias("of_task"), _sort_plan(F.col("a_names"), F.col("keys")).alias("plan"),
        F.col("a_flags").alias("flags"))]
    own.append(gprof.where("n_rows > 0").select(
        F.col("task_id").alias("own_task"), F.lit(None).cast(prof.schema["run_id"].dataType).alias("own_run"),
        "table_name", F.col("task_id").alias("of_task"), _sort_plan(F.col("names"), F.col("keys")).alias("plan"),
        "flags"))
    sides = union_all(own).withColumnRenamed("table_name", "own_table")
    planned = cells.where("cells IS NOT NULL").drop("names").join(
        sides, F.col("task_id").eqNullSafe(F.col("own_task")) & F.col("run_id").eqNullSafe(F.col("own_run"))
        & (F.col("table_name") == F.col("own_table")))
    keyed = planned.select(F.col("of_task").alias("task_id"), "run_id", "table_name", "cells",
                           _sort_key(F.col("plan"), F.col("flags"), F.col("cells")).alias("_k"))
    pos = with_positions(keyed, [F.col("_k").asc()], group_cols=group, pos_col="pos").drop("_k")
    joined = pos.where("run_id IS NOT NULL").join(comparable.select(*ak, "pairing"), ak, "inner").join(
        pos.where("run_id IS NULL").select("task_id", "table_name", "pos", F.col("cells").alias("g_cells")),
        ["task_id", "table_name", "pos"], "inner")

    def failed(p):
        num_ok = tolerant_equal(F.element_at(F.col("g_cells"), p["gi"] + 1)["n"],
                                F.element_at(F.col("cells"), p["aj"] + 1)["n"])
        txt_ok = F.coalesce(_cell_text(F.col("g_cells"), p["gi"], p["gdetail"]).eqNullSafe(
            _cell_text(F.col("cells"), p["aj"], p["adetail"])), F.lit(False))
        return F.when(p["aj"].isNull(), F.lit(False)).when(p["numeric"], num_ok).otherwise(txt_ok)

    bad = joined.select(*ak, F.explode(F.transform(
        F.filter(F.col("pairing"), lambda p: p["aj"].isNotNull() & ~failed(p)), lambda p: p["gi"])).alias("gi"))
    bad_cols = bad.groupBy(*ak).agg(F.collect_set("gi").alias("failed"))

    present = F.size(F.filter("pairing", lambda p: p["aj"].isNotNull()))
    total = F.size("g_names")
    matched = F.when(F.col("same_rows"), present - F.size(F.coalesce("failed", F.array().cast("array<int>"))))\
        .otherwise(F.lit(0))
    return (targets.join(bad_cols, ak, "left")
            .select("run_id", "task_id", "table_name",
                    F.when(total > 0, F.round(matched / total, 6)).otherwise(F.lit(0.0)).cast("double")
                    .alias("score"),
                    matched.cast("long").alias("matched_columns"), total.cast("long").alias("total_columns"),
                    F.when(F.col("a_rows").isNotNull(), F.col("same_rows")).alias("row_count_match")))
