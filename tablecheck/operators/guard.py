"""Checks over tables of submitted text: SQL models, identifiers, plan files.

Each check is a Column expression returning NULL when the text passes and a
reason code otherwise, so one ``select`` checks any number of submissions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import strip_unicode

# The accepted start of a model, and identifier syntax.
SELECT_START_RE = r"(?i)^(SELECT|WITH)\b"
IDENTIFIER_RE = r"^[A-Za-z_][A-Za-z0-9_]*\z"
# Spark functions and clauses that run host code; refused on top of the SELECT rule.
HOST_CODE_RE = r"(?i)(\b(reflect|java_method|try_reflect)\s*\(|\btransform\s*\(.*\)\s*using\b)"

# Plan-file policy.
PLAN_MAX_CHARS = 100_000
PLAN_FORBIDDEN = ("provisioner", "local-exec", "remote-exec", "module ", 'output "', 'backend "')
PLAN_DATA_RE = r'(?i)\bdata\s+"'
PLAN_RESOURCE_RE = r'(?i)\bresource\s+"([^"]+)"'
PLAN_PROVIDER_RE = r'(?i)\bprovider\s+"([^"]+)"'
PLAN_RESOURCE_PREFIX = "airbyte_"
PLAN_PROVIDER = "airbyte"
SECRET_MIN_CHARS = 4


# What a model may be made of.  Functions: Spark's own, by the group they are documented in, and
# the ones of the miscellaneous group that only compute; operators: those of a query over tables.
# Anything else, such as a function that a session or a later Spark adds, is refused unnamed.
ALLOWED_GROUPS = frozenset(f"{g}_funcs" for g in (
    "agg", "array", "bitwise", "collection", "conditional", "conversion", "csv", "datetime", "generator", "hash", "json",
    "lambda", "map", "math", "predicate", "string", "struct", "url", "variant", "window", "xml"))
ALLOWED_MISC = frozenset((
    "assert_true", "bitmap_bit_position", "bitmap_bucket_number", "bitmap_count", "hll_sketch_estimate", "hll_union",
    "monotonically_increasing_id", "raise_error", "range", "typeof", "uuid", "version"))
ALLOWED_OPERATORS = frozenset((
    "Aggregate", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin",
    "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Union",
    "UnresolvedHint", "UnresolvedWith", "Unpivot", "Window", "WithWindowDefinition"))

# Classes of the analysed plan that call host code or start a process.
HOST_NODES = ("CallMethodViaReflection", "TryReflect", "ScriptTransformation")


class Refused(ValueError):
    """A submitted name or statement that breaks a rule; ``reason`` is its code."""

    def __init__(self, reason: str, subject: str):
        super().__init__(f"{reason}: {subject[:80]!r}")
        self.reason = reason


def require_identifier(name: str) -> str:
    """The driver-side form of :func:`identifier_ok`."""
    if not (isinstance(name, str) and re.match(IDENTIFIER_RE.replace(r"\z", r"\Z"), name)):
        raise Refused("not_an_identifier", str(name))
    return name


def require_model_sql(sql: str | None) -> str:
    """The driver-side form of :func:`model_sql_reason`; returns the stripped statement."""
    text = (sql or "").strip()
    rules = (("empty", not text), ("semicolon", ";" in text), ("not_select", not re.search(SELECT_START_RE, text)),
             ("host_code", bool(re.search(HOST_CODE_RE, text, re.S))))
    for reason, broken in rules:
        if broken:
            raise Refused(reason, text)
    return text


def parsed_nodes(session: SparkSession, sql: str) -> list[tuple[str, dict]]:
    """(class name, fields) of every node of a statement's parsed plan: operators and expressions, subqueries included."""
    found: list[tuple[str, dict]] = []

    def walk(value) -> None:
        if isinstance(value, dict):
            if "class" in value:
                found.append((value["class"], value))
            value = value.values()
        elif not isinstance(value, list):
            return
        for inner in value:
            walk(inner)

    walk(json.loads(session._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON()))
    return found


def _name(parts: str) -> str:
    """The last part of a name as a plan shows it, lower-cased."""
    return parts.strip("[]").split(",")[-1].strip().strip("`").lower()


def relation_names(nodes: Sequence[tuple[str, dict]]) -> set[str]:
    """Lower-cased last names of the tables that parsed nodes refer to."""
    return {_name(fields["multipartIdentifier"]) for kind, fields in nodes if kind.endswith(".UnresolvedRelation")}


@cache
def _allowed_functions(jvm) -> frozenset[str]:
    known = jvm.org.apache.spark.sql.api.python.PythonSQLUtils.listBuiltinFunctionInfos()
    return frozenset(i.getName().lower() for i in known if i.getGroup() in ALLOWED_GROUPS) | ALLOWED_MISC


def require_allowed(session: SparkSession, sql: str) -> list[tuple[str, dict]]:
    """Refuse a statement with a function or an operator that is not on the lists; returns its parsed nodes."""
    nodes, allowed = parsed_nodes(session, sql), _allowed_functions(session._jvm)
    for kind, fields in nodes:
        package, _, plain = kind.rpartition(".")
        if package.endswith("plans.logical") and plain not in ALLOWED_OPERATORS:
            raise Refused("operator_not_allowed", plain)
        names = {"UnresolvedFunction": "nameParts", "UnresolvedTableValuedFunction": "name"}
        if plain in names and _name(fields[names[plain]]) not in allowed:
            raise Refused("function_not_allowed", _name(fields[names[plain]]))
    return nodes


def require_no_host_code(df: DataFrame) -> DataFrame:
    """Refuse a query whose analysed plan reflects into the JVM or pipes rows through a process.

    The plan is inspected, not the text: quoting, comments and the MAP / REDUCE forms
    all end as the same nodes.
    """
    plan = df._jdf.queryExecution().analyzed().toJSON()
    for node in HOST_NODES:
        if re.search(rf'"class":"[\w.$]*\b{node}"', plan):
            raise Refused("host_code", node)
    return df


def select_only_reason(sql: Column) -> Column:
    """NULL for one SELECT/WITH statement; else ``empty``, ``semicolon`` or ``not_select``."""
    text = strip_unicode(sql)
    return (F.when(sql.isNull() | (F.length(text) == 0), F.lit("empty"))
            .when(F.instr(text, ";") > 0, F.lit("semicolon"))
            .when(~text.rlike(SELECT_START_RE), F.lit("not_select")))


def model_sql_reason(sql: Column) -> Column:
    """The SELECT rule plus refusal of host-code functions (Spark-specific hardening)."""
    return F.coalesce(select_only_reason(sql),
                      F.when(sql.rlike(HOST_CODE_RE), F.lit("host_code")))


def identifier_ok(name: Column) -> Column:
    return F.coalesce(name.rlike(IDENTIFIER_RE), F.lit(False))


def plan_violations(text: Column, secrets: Column | None = None) -> Column:
    """All policy violations of a plan text, an array in the order of the rules (empty: the plan
    passes; a null text: null).  ``secrets``: array of configured secret strings for that text's
    run (only those of at least 4 characters count).

    The rules that look for words and types share one lower-cased text and one extraction each.
    """
    lower = F.lower(text)
    resources = F.regexp_extract_all(text, F.lit(PLAN_RESOURCE_RE), 1)
    providers = F.regexp_extract_all(text, F.lit(PLAN_PROVIDER_RE), 1)
    checks = [(F.length(text) > PLAN_MAX_CHARS, "too_large")]
    checks += [(F.instr(lower, word) > 0, f"forbidden:{word.strip()}") for word in PLAN_FORBIDDEN]
    checks += [
        (text.rlike(PLAN_DATA_RE), "data_source"),
        (F.exists(resources, lambda r: ~r.startswith(PLAN_RESOURCE_PREFIX)), "resource_type"),
        (F.exists(providers, lambda p: p != PLAN_PROVIDER), "provider"),
    ]
    if secrets is not None:
        checks.append((F.exists(secrets, lambda s: (F.length(s) >= SECRET_MIN_CHARS) & (F.instr(text, s) > 0)),
                       "embedded_secret"))
    return F.when(text.isNotNull(), F.array_compact(F.array(*[F.when(broken, F.lit(reason)) for broken, reason in checks])))


def plan_violation(text: Column, secrets: Column | None = None) -> Column:
    """First policy violation of a plan text, or NULL."""
    return F.get(plan_violations(text, secrets), 0)


def undeclared(selected: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Selected (keys..., table_name) rows whose table is not declared for those keys."""
    return selected.join(declared, [*keys, "table_name"], "left_anti")
