"""CSV sources read the way the graded pipelines read them.

* ``read_string_csv``: header row, RFC-4180 quoting (doubled quotes, quoted line
  breaks), every column text, the null tokens turned into NULL.  Used for expected
  tables.
* ``read_typed_csv``: the same text, then one aggregate pass decides each column's
  type over the whole column (int64 -> BIGINT; int64 with a null, decimals,
  inf -> DOUBLE; ints past int64 but within uint64 -> DECIMAL(20,0); True/False
  spellings -> BOOLEAN; anything else, including dates, stays STRING) and a
  projection casts.  Spark's ``inferSchema`` is not used: it reads dates as DATE and
  small integers as INT.

A row with more fields than the header is an error (one spare trailing column in
the read schema is non-NULL exactly for such rows); shorter rows are padded with
NULL.  Duplicate header names get ``.1``, ``.2`` suffixes; names that differ by case
only are kept.  Numbers may stand between blanks.

Files are split between tasks wherever they are, quoted line breaks included
(:mod:`tablecheck.sources.csvrecords`).  Every file is read by its own header: the columns
of all files are put in the order of the first file's (by path hash), and files whose headers
hold other names are refused.  A typed read parses the text once: the parsed text is written
to the scratch folder while the same job folds every column's type.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import FALSE_TOKENS, INTEGER_RE, NUMBER_RE, TRUE_TOKENS, null_tokens
from ..session import materialize
from .csvrecords import Blocks, csv_records, scan_blocks

_SPARE = "_extra_field"
UINT64_MAX = 18446744073709551615
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"',
               "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false", "nullValue": None, "emptyValue": ""}


def unique_names(raw: Sequence[str | None]) -> list[str]:
    """Header names made distinct: a repeated name takes the next free ``.1``, ``.2`` suffix."""
    given = ["" if name is None else str(name) for name in raw]
    taken: set[str] = set()
    names = []
    for name in given:
        free, k = name, 0
        while free in taken:
            k += 1
            free = f"{name}.{k}"
        taken.add(free)
        names.append(free)
    return names


def header_fields(header: str) -> list[str]:
    """The distinct names of a header record."""
    return unique_names(next(csv.reader(io.StringIO(header, newline=""))))


def _layouts(blocks: Blocks) -> tuple[list[str], list[list[int]], dict[int, int]]:
    """Column names, the distinct orders they come in (places from 1), and the number of each file's order."""
    if not blocks.headers:
        return [], [], {}
    headers = {file: header.decode().removesuffix("\r") for file, header in sorted(blocks.headers.items())}
    names = header_fields(next(iter(headers.values())))
    orders: dict[str, int] = {}
    for header in dict.fromkeys(headers.values()):
        own = header_fields(header)
        if sorted(own) != sorted(names):
            raise ValueError(f"CSV files of one source have different columns: {names} and {own}")
        orders[header] = len(orders)
    places = [[header_fields(h).index(name) + 1 for name in names] for h in orders]
    return names, places, {file: orders[header] for file, header in headers.items()}


def _text(spark: SparkSession, path: str, check_shape: bool) -> tuple[DataFrame, list[str]]:
    """All fields as text under positional names ``_f0`` ..., null tokens turned into NULL; and the columns' names."""
    blocks = scan_blocks(spark, path)
    names, places, layouts = _layouts(blocks)
    if not names:
        return spark.createDataFrame([], T.StructType([])), []
    fields = [f"_f{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in [*fields, _SPARE])
    options = {k: v for k, v in CSV_OPTIONS.items() if v is not None and k != "header"}
    parsed = csv_records(spark, path, blocks, layouts).select(
        F.from_csv("record", schema, options).alias("r"), "layout")
    if check_shape:
        # A filter (not a dropped column) so that column pruning cannot remove the check.
        parsed = parsed.where(F.when(F.col(f"r.{_SPARE}").isNotNull(),
                                     F.raise_error(F.lit("CSV row has more fields than the header")).cast("boolean"))
                              .otherwise(F.lit(True)))
    if len(places) == 1:
        given = [F.col(f"r._f{place - 1}") for place in places[0]]
    else:
        every, order = F.array(*[F.col(f"r.{c}") for c in fields]), F.array(*[F.array(*map(F.lit, p)) for p in places])
        given = [F.element_at(every, F.element_at(F.element_at(order, F.col("layout") + 1), F.lit(k + 1)))
                 for k in range(len(names))]
    return parsed.select(*[null_tokens(c).alias(f) for c, f in zip(given, fields, strict=True)]), names


def read_string_csv(spark: SparkSession, path: str, check_shape: bool = True) -> DataFrame:
    text, names = _text(spark, path, check_shape)
    return text.toDF(*names)


def type_marks(columns: Sequence[str]) -> list[Column]:
    """Aggregates from which :func:`column_types` reads every text column's type; marks of parts add up."""
    aggs = []
    u64_max = F.lit(str(UINT64_MAX)).cast("decimal(20,0)")
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        bare = F.trim(col)
        is_int = bare.rlike(INTEGER_RE)
        aggs += [F.count(col).alias(f"nn{i}"),
                 F.count(F.when(is_int, F.lit(1))).alias(f"int{i}"),
                 F.count(F.when(is_int, bare.try_cast("long"))).alias(f"i64{i}"),
                 F.count(F.when(is_int & (bare.try_cast("decimal(20,0)") <= u64_max), F.lit(1))).alias(f"u64{i}"),
                 F.count(F.when(F.lower(bare).rlike(NUMBER_RE), F.lit(1))).alias(f"num{i}"),
                 F.count(F.when(col.isin(*TRUE_TOKENS, *FALSE_TOKENS), F.lit(1))).alias(f"bool{i}")]
    return [*aggs, F.count(F.lit(1)).alias("rows")]


def column_types(columns: Sequence[str], row: Mapping[str, int]) -> dict[str, T.DataType]:
    """Whole-column types from the values of :func:`type_marks`."""
    out: dict[str, T.DataType] = {}
    for i, c in enumerate(columns):
        nn, rows = row[f"nn{i}"], row["rows"]
        if nn == 0:
            out[c] = T.DoubleType()
        elif row[f"int{i}"] == nn and row[f"i64{i}"] == nn:
            out[c] = T.LongType() if nn == rows else T.DoubleType()
        elif row[f"int{i}"] == nn and row[f"u64{i}"] == nn:
            out[c] = T.DecimalType(20, 0)
        elif row[f"num{i}"] == nn and row[f"int{i}"] < nn:
            out[c] = T.DoubleType()
        elif row[f"bool{i}"] == nn:
            out[c] = T.BooleanType()
        else:
            out[c] = T.StringType()
    return out


def infer_types(df: DataFrame) -> dict[str, T.DataType]:
    """Whole-column type of every text column, from one aggregate pass."""
    return column_types(df.columns, df.agg(*type_marks(df.columns)).first().asDict())


def cast_typed(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    cols = []
    for c in df.columns:
        col, t = F.col(f"`{c}`"), types[c]
        if isinstance(t, T.BooleanType):
            cols.append(F.when(col.isin(*TRUE_TOKENS), F.lit(True))
                        .when(col.isin(*FALSE_TOKENS), F.lit(False)).alias(c))
        elif isinstance(t, T.StringType):
            cols.append(col.alias(c))
        else:
            cols.append(F.trim(col).cast(t).alias(c))
    return df.select(*cols)


def read_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    text, names = _text(spark, path, True)
    if not names:
        return text
    marks = Observation(f"types_{uuid.uuid4().hex[:8]}")
    landed = materialize(text.observe(marks, *type_marks(text.columns)), "csv-text")
    return cast_typed(landed, column_types(landed.columns, marks.get)).toDF(*names)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a DataFrame as headed RFC-4180 CSV (quotes doubled, blanks kept)."""
    (df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"')
     .option("quoteAll", "false").option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
     .option("nullValue", "").csv(path))
