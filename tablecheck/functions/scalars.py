"""Scalar Column expressions used by loading and grading (all JVM-side, codegen friendly).

Every function here takes and returns ``pyspark.sql.Column`` so it can be used in
``select``/``agg`` of any size of table without a Python round trip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text tokens a CSV reader of the graded pipelines treats as null.
# Case-sensitive; "-" and "NIL" stay text.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Spellings recognised as booleans when a CSV column is typed.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

# Tolerances of the numeric column comparison (absolute, relative to actual).
ABS_TOL = 1e-9
REL_TOL = 1e-2

# Whitespace removed around text before comparing: exactly the characters Python's
# str.isspace accepts (derived by rule, 29 code points, all below U+3001).
UNICODE_SPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# A lenient number parse accepts only ASCII blanks around the number.
ASCII_SPACE = " \t\n\r\f\v"
NUMBER_RE = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
INTEGER_RE = r"^[+-]?[0-9]+$"


def null_tokens(c: Column) -> Column:
    """Text value with the CSV null tokens turned into SQL NULL."""
    return F.when(c.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def strip_unicode(c: Column) -> Column:
    return F.trim(c, F.lit(UNICODE_SPACE))


def numeric_parse(c: Column) -> Column:
    """Lenient text-to-double parse: NULL unless the whole value is a plain decimal number.

    ``try_cast`` alone would also accept ``1d``/``1f`` suffixes and ``nan``; the regex
    guard keeps exactly the plain spellings (sign, fraction, exponent, inf/infinity).
    """
    t = F.trim(c.cast("string"), F.lit(ASCII_SPACE))
    return F.when(t.rlike(NUMBER_RE), t.try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def tolerant_equal(gold: Column, actual: Column) -> Column:
    """Null-safe closeness |g - a| <= ABS_TOL + REL_TOL * |a| (tolerance scales with actual).

    Equal infinities match, null matches null; the result is never NULL.
    """
    finite = (F.abs(gold) < F.lit(float("inf"))) & (F.abs(actual) < F.lit(float("inf")))
    close = F.abs(gold - actual) <= F.lit(ABS_TOL) + F.lit(REL_TOL) * F.abs(actual)
    return (F.when(gold.isNull() & actual.isNull(), F.lit(True))
            .when(gold.isNull() | actual.isNull(), F.lit(False))
            .when(gold == actual, F.lit(True))
            .when(finite, close)
            .otherwise(F.lit(False)))


def sort_text(c: Column) -> Column:
    """Text form used to order non-numeric columns: stripped, lower-cased."""
    return F.lower(strip_unicode(c))


def fold_text(c: Column) -> Column:
    """Text form used to compare non-numeric columns: stripped, case-folded."""
    return F.replace(F.lower(strip_unicode(c)), F.lit("ß"), F.lit("ss"))


def text_equal(gold: Column, actual: Column) -> Column:
    g, a = fold_text(gold), fold_text(actual)
    return F.coalesce(g.eqNullSafe(a), F.lit(False))


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def tail(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.substring(c, -n, n)).otherwise(c)


def normalize_status(c: Column) -> Column:
    return F.lower(F.coalesce(c.cast("string"), F.lit("unknown")))
