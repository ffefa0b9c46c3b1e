"""DuckDB SQL text for the oracles: the grading rules written independently in SQL.

The Spark side implements the rules with DataFrame expressions; these builders
state the same rules as plain SQL so that the driver's DuckDB run is a second,
separate implementation of every verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

# Characters trimmed around text (Python's str.isspace set) and around numbers (ASCII blanks).
UNICODE_SPACE_SQL = " || ".join(f"chr({ord(ch)})" for ch in "".join(
    ch for ch in map(chr, range(0x3001)) if ch.isspace()))
ASCII_SPACE_SQL = " || ".join(f"chr({ord(ch)})" for ch in " \t\n\r\f\v")
NUMBER_RE = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def num(x: str) -> str:
    t = f"trim(CAST({x} AS VARCHAR), {ASCII_SPACE_SQL})"
    return f"(CASE WHEN regexp_matches({t}, '{NUMBER_RE}') THEN TRY_CAST({t} AS DOUBLE) END)"


def strip(x: str) -> str:
    return f"trim({x}, {UNICODE_SPACE_SQL})"


def sort_text(x: str) -> str:
    return f"lower({strip(x)})"


def fold(x: str) -> str:
    return f"replace(lower({strip(x)}), 'ß', 'ss')"


def tol_eq(g: str, a: str) -> str:
    return (f"(CASE WHEN {g} IS NULL AND {a} IS NULL THEN TRUE "
            f"WHEN {g} IS NULL OR {a} IS NULL THEN FALSE "
            f"WHEN {g} = {a} THEN TRUE "
            f"WHEN isinf({g}) OR isinf({a}) THEN FALSE "
            f"ELSE abs({g} - {a}) <= 1e-9 + 1e-2 * abs({a}) END)")


def text_eq(g: str, a: str) -> str:
    return f"coalesce(({fold(g)}) IS NOT DISTINCT FROM ({fold(a)}), FALSE)"


@dataclass(frozen=True)
class Col:
    name: str
    kind: str  # text | int | double | bool | date


def text_of(c: Col, alias: str) -> str:
    x = f'{alias}."{c.name}"'
    if c.kind == "text":
        return x
    if c.kind == "bool":
        return f"(CASE WHEN {x} THEN 'True' WHEN NOT {x} THEN 'False' END)"
    if c.kind == "date":
        return f"strftime({x}, '%Y-%m-%d')"
    return f"CAST({x} AS VARCHAR)"


def num_of(c: Col, alias: str) -> str:
    x = f'{alias}."{c.name}"'
    if c.kind in ("int", "double", "bool"):
        return f"CAST({x} AS DOUBLE)"
    if c.kind == "date":
        return "CAST(NULL AS DOUBLE)"
    return num(x)


def profile_sql(side: str, cols: Sequence[Col]) -> str:
    """One row: n, and per column i flags eq_num{i} (equality numeric), sort_num{i}."""
    parts = ["count(*) AS n"]
    for i, c in enumerate(cols):
        t, n = text_of(c, "s"), num_of(c, "s")
        parts.append(f"count({t}) = count({n}) AS eq_num{i}")
        parts.append(f"count({t}) = count({num(sort_text(t))}) AS sort_num{i}")
    return f"SELECT {', '.join(parts)} FROM {side} s"


def order_sql(cols: Sequence[Col], keys: Sequence[str], prof: str) -> str:
    lookup = {c.name.lower(): i for i, c in enumerate(cols)}
    order = [lookup[k.lower()] for k in keys if k.lower() in lookup]
    order += [i for i in range(len(cols)) if i not in order]
    items = []
    for i in order:
        t = text_of(cols[i], "s")
        items.append(f"CASE WHEN {prof}.sort_num{i} THEN {num(sort_text(t))} END ASC NULLS LAST")
        items.append(f"CASE WHEN {prof}.sort_num{i} THEN NULL ELSE {sort_text(t)} END ASC NULLS LAST")
    return ", ".join(items)


def positioned_sql(side: str, cols: Sequence[Col], keys: Sequence[str], prof: str) -> str:
    return (f"SELECT s.*, row_number() OVER (ORDER BY {order_sql(cols, keys, prof)}) - 1 AS _pos "
            f"FROM {side} s, {prof}")


def compare_ctes(gold_sql: str, gold_cols: Sequence[Col], actual_sql: str, actual_cols: Sequence[Col],
                 keys: Sequence[str]) -> str:
    """CTEs g, a, gp, ap, gs, asrt (sorted with _pos), pj (positional join)."""
    return (f"g AS ({gold_sql}), a AS ({actual_sql}), "
            f"gp AS ({profile_sql('g', gold_cols)}), ap AS ({profile_sql('a', actual_cols)}), "
            f"gs AS ({positioned_sql('g', gold_cols, keys, 'gp')}), "
            f"asrt AS ({positioned_sql('a', actual_cols, keys, 'ap')}), "
            f"pj AS (SELECT gs.* , {', '.join(f'asrt.\"{c.name}\" AS \"a_{c.name}\"' for c in actual_cols)} "
            f"FROM gs JOIN asrt ON gs._pos = asrt._pos)")


def verdict_sql(gi: int, g: Col, aj: int, a: Col) -> str:
    """Per-row verdict of gold column gi against actual column aj inside ``pj``."""
    gt, gn = text_of(g, "pj"), num_of(g, "pj")
    ac = Col(f"a_{a.name}", a.kind)
    at, an = text_of(ac, "pj"), num_of(ac, "pj")
    return (f"CASE WHEN (SELECT eq_num{gi} FROM gp) AND (SELECT eq_num{aj} FROM ap) "
            f"THEN {tol_eq(gn, an)} ELSE {text_eq(gt, at)} END")


def pairing(gold_cols: Sequence[Col], actual_cols: Sequence[Col]) -> list[tuple[int, Col, int | None, Col | None]]:
    lookup = {c.name.lower(): j for j, c in enumerate(actual_cols)}
    out = []
    for i, g in enumerate(gold_cols):
        j = lookup.get(g.name.lower())
        out.append((i, g, j, actual_cols[j] if j is not None else None))
    return out


def score_sql(pair: str, gold_sql: str, gold_cols: Sequence[Col], actual_sql: str,
              actual_cols: Sequence[Col], keys: Sequence[str]) -> str:
    """One row (pair, score, matched_columns, total_columns, row_count_match)."""
    ctes = compare_ctes(gold_sql, gold_cols, actual_sql, actual_cols, keys)
    matched_terms = []
    for i, g, j, a in pairing(gold_cols, actual_cols):
        if j is None:
            continue
        matched_terms.append(f"CASE WHEN coalesce((SELECT bool_and({verdict_sql(i, g, j, a)}) FROM pj), TRUE) "
                             f"THEN 1 ELSE 0 END")
    matched = " + ".join(matched_terms) or "0"
    m = len(gold_cols)
    same = "(SELECT n FROM gp) = (SELECT n FROM ap)"
    return (f"WITH {ctes} SELECT '{pair}' AS pair, "
            f"CAST(CASE WHEN {same} THEN round(({matched}) / {max(m, 1)}.0, 6) ELSE 0.0 END AS DOUBLE) AS score, "
            f"CAST(CASE WHEN {same} THEN {matched} ELSE 0 END AS BIGINT) AS matched_columns, "
            f"CAST({m} AS BIGINT) AS total_columns, {same} AS row_count_match")


def batch_score_sql(table_name: str, gold_sql: str, gold_cols: Sequence[Col], actual_sql: str,
                    actual_cols: Sequence[Col], keys: Sequence[str], runs_sql: str) -> str:
    """Rows (run_id, task_id, table_name, score, matched_columns, total_columns, row_count_match).

    ``gold_sql`` has task_id plus gold_cols; ``actual_sql`` has run_id plus actual_cols;
    ``runs_sql`` has run_id, task_id.  Profiles are per task (gold) and per run (actual).
    """
    def prof(side: str, cols: Sequence[Col], key: str) -> str:
        parts = [key, "count(*) AS n"]
        for i, c in enumerate(cols):
            t, n = text_of(c, "s"), num_of(c, "s")
            parts.append(f"count({t}) = count({n}) AS eq_num{i}")
            parts.append(f"count({t}) = count({num(sort_text(t))}) AS sort_num{i}")
        return f"SELECT {', '.join(parts)} FROM {side} s GROUP BY {key}"

    def positioned(side: str, cols: Sequence[Col], key: str, p: str) -> str:
        return (f"SELECT s.*, row_number() OVER (PARTITION BY s.{key} ORDER BY {order_sql(cols, keys, p)}) - 1 "
                f"AS _pos FROM {side} s JOIN {p} ON s.{key} = {p}.{key}")

    acols = ", ".join(f'asrt."{c.name}" AS "a_{c.name}"' for c in actual_cols)
    pairs = pairing(gold_cols, actual_cols)
    oks = []
    for i, g, j, a in pairs:
        if j is None:
            continue
        gt, gn = text_of(g, "pj"), num_of(g, "pj")
        ac = Col(f"a_{a.name}", a.kind)
        at, an = text_of(ac, "pj"), num_of(ac, "pj")
        oks.append(f"bool_and(CASE WHEN gp.eq_num{i} AND ap.eq_num{j} THEN {tol_eq(gn, an)} "
                   f"ELSE {text_eq(gt, at)} END) AS ok{i}")
    present = [i for i, _, j, _ in pairs if j is not None]
    m = len(gold_cols)
    matched = " + ".join(f"CASE WHEN coalesce(v.ok{i}, TRUE) THEN 1 ELSE 0 END" for i in present) or "0"
    same = "(ap.n IS NOT NULL AND ap.n = gp.n)"
    return f"""
WITH g AS ({gold_sql}), a AS ({actual_sql}), r AS ({runs_sql}),
gp AS ({prof('g', gold_cols, 'task_id')}), ap AS ({prof('a', actual_cols, 'run_id')}),
gs AS ({positioned('g', gold_cols, 'task_id', 'gp')}),
asrt AS ({positioned('a', actual_cols, 'run_id', 'ap')}),
pj AS (SELECT asrt.run_id AS run_id_, gs.*, {acols} FROM asrt JOIN r ON asrt.run_id = r.run_id
       JOIN gs ON gs.task_id = r.task_id AND gs._pos = asrt._pos),
v AS (SELECT pj.run_id_ AS run_id, {', '.join(oks) or 'TRUE AS ok_none'} FROM pj
      JOIN gp ON pj.task_id = gp.task_id JOIN ap ON pj.run_id_ = ap.run_id GROUP BY pj.run_id_)
SELECT r.run_id, r.task_id, '{table_name}' AS table_name,
       CAST(CASE WHEN {same} THEN round(({matched}) / {max(m, 1)}.0, 6) ELSE 0.0 END AS DOUBLE) AS score,
       CAST(CASE WHEN {same} THEN {matched} ELSE 0 END AS BIGINT) AS matched_columns,
       CAST({m} AS BIGINT) AS total_columns,
       CASE WHEN ap.n IS NULL THEN NULL ELSE ap.n = gp.n END AS row_count_match
FROM r JOIN gp ON r.task_id = gp.task_id LEFT JOIN ap ON r.run_id = ap.run_id LEFT JOIN v ON r.run_id = v.run_id"""
