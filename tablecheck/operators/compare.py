"""Tolerant column-wise comparison of an expected ("gold") table with an actual table.

Rules (one table pair):

1. Different row counts: score 0, no column matched, ``row_count_match`` false.
2. Each side is sorted on its own: the given key columns first (matched
   case-insensitively, absent ones skipped), then its remaining columns in its own
   order.  A column sorts by number when all its non-null values parse as numbers,
   else by stripped lower-cased text; nulls last.
3. Row *i* of sorted gold is paired with row *i* of sorted actual.
4. A gold column with a case-insensitive namesake in actual matches when every
   pair is equal: by tolerance (|g-a| <= 1e-9 + 1e-2*|a|) if both columns are wholly
   numeric, else by stripped case-folded text, null equal to null.
5. Score = matched gold columns / gold columns (0 when gold has none).

Per side: one pass writes the normalised cells (text, number and sort views) to
scratch while ``observe`` collects the profile (row count, non-null and numeric
counts); one range-partitioned sort numbers the rows.  After the positional join
a single aggregate yields every column's verdict at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import ASCII_SPACE, nan_to_null, numeric_parse, sort_text, strip_unicode, tolerant_equal
from ..session import materialize, scratch_path
from .positions import LOCAL_BITS, with_positions


@dataclass(frozen=True)
class TableScore:
    """Verdict on every gold column, in order; the figures follow from it."""

    verdicts: tuple[tuple[str, bool], ...]
    row_count_match: bool

    @property
    def total_columns(self) -> int:
        return len(self.verdicts)

    @property
    def matched_columns(self) -> int:
        return sum(ok for _, ok in self.verdicts)

    @property
    def score(self) -> float:
        return self.matched_columns / max(self.total_columns, 1)


SCORE_SCHEMA = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("matched_columns", T.LongType()),
    T.StructField("total_columns", T.LongType()),
    T.StructField("row_count_match", T.BooleanType()),
])

_NUMBER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
_TIME_TYPES = (T.TimestampType, T.TimestampNTZType)


# Codec of the written sides: whole tables, each read a few times.
COMPRESSION = "zstd"
# Characters shown of a time column, by its finest value: days, seconds, milli-, microseconds.
TIME_WIDTHS = (10, 19, 23, 26)


def time_detail(c: Column) -> Column:
    """Index into ``TIME_WIDTHS`` that a time value needs."""
    micros = F.unix_micros(c.cast("timestamp")) % F.lit(1_000_000)
    midnight = (F.hour(c) == 0) & (F.minute(c) == 0) & (F.second(c) == 0)
    return F.when(c.isNotNull(), F.when(micros % 1000 != 0, F.lit(3)).when(micros != 0, F.lit(2))
                  .when(~midnight, F.lit(1)).otherwise(F.lit(0)))


def text_form(c: Column, dtype: T.DataType) -> Column:
    """Text of a typed value as the comparator sees it (NULL stays NULL); times in full,
    to be cut to what their column needs."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return nan_to_null(c.cast("double")).cast("string")
    if isinstance(dtype, _NUMBER_TYPES):
        return c.cast("string")
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, _TIME_TYPES):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def number_form(c: Column, dtype: T.DataType) -> Column:
    """Numeric value of a typed cell, NULL where the cell does not parse as a number.

    Booleans count as 1/0.  Dates and timestamps never count as numbers (documented
    deviation: an epoch reading would only ever match epoch gold values).
    """
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if isinstance(dtype, _NUMBER_TYPES):
        return nan_to_null(c.cast("double"))
    if isinstance(dtype, T.StringType):
        return numeric_parse(c)
    return F.lit(None).cast("double")


@dataclass(frozen=True)
class SideProfile:
    rows: int
    names: tuple[str, ...]
    types: tuple[T.DataType, ...]
    non_null: tuple[int, ...]
    numeric: tuple[int, ...]
    sort_numeric: tuple[int, ...]
    time_detail: tuple[int, ...]

    def is_numeric(self, i: int) -> bool:
        return self.non_null[i] == self.numeric[i]

    def sorts_numeric(self, i: int) -> bool:
        return self.non_null[i] == self.sort_numeric[i]


def normal_columns(df: DataFrame, keep: bool = False) -> tuple[DataFrame, list[str], list[T.DataType]]:
    """Per source column i: ``_l{i}`` stripped lower-cased text, ``_n{i}`` its number
    (equality view), ``_sn{i}`` the number of ``_l{i}`` (sort view), and for timestamps
    ``_m{i}`` how fine the value is (``time_detail``).  Every later step reads only these,
    so the regular expressions run once per cell.  ``keep`` also carries the
    original values as ``_c{i}``.
    """
    names = list(df.columns)
    types = [f.dataType for f in df.schema.fields]
    idf = df.toDF(*[f"_c{i}" for i in range(len(names))])
    cols = [F.col(f"_c{i}") for i in range(len(names))] if keep else []
    for i, t in enumerate(types):
        c = F.col(f"_c{i}")
        txt = text_form(c, t)
        cols.append(sort_text(txt).alias(f"_l{i}"))
        num = number_form(c, t)
        cols.append(num.alias(f"_n{i}"))
        if isinstance(t, _NUMBER_TYPES):
            cols.append(num.alias(f"_sn{i}"))
        elif isinstance(t, T.StringType):
            # The sort view parses the Unicode-stripped lower-cased text; the parse is
            # case-insensitive, so it equals the equality parse unless Unicode-only
            # blanks surround the value.  Only those rows pay for a second parse.
            same = strip_unicode(c) == F.trim(c, F.lit(ASCII_SPACE))
            cols.append(F.when(same, num).otherwise(numeric_parse(sort_text(c))).alias(f"_sn{i}"))
        else:
            cols.append(F.lit(None).cast("double").alias(f"_sn{i}"))
        if isinstance(t, _TIME_TYPES):
            cols.append(time_detail(c).alias(f"_m{i}"))
    return idf.select(*cols), names, types


def _profile_marks(types: Sequence[T.DataType]) -> list[Column]:
    """Aggregates of a side's profile."""
    marks = [F.count(F.lit(1)).alias("_rows")]
    for i, t in enumerate(types):
        marks += [F.count(f"_l{i}").alias(f"_nn{i}"), F.count(f"_n{i}").alias(f"_num{i}"),
                  F.count(f"_sn{i}").alias(f"_snum{i}")]
        if isinstance(t, _TIME_TYPES):
            marks.append(F.coalesce(F.max(f"_m{i}"), F.lit(0)).alias(f"_detail{i}"))
    return marks


def _observed_profile(row: dict, names: Sequence[str], types: Sequence[T.DataType]) -> SideProfile:
    n = range(len(names))
    return SideProfile(
        rows=int(row["_rows"]), names=tuple(names), types=tuple(types),
        non_null=tuple(int(row[f"_nn{i}"]) for i in n), numeric=tuple(int(row[f"_num{i}"]) for i in n),
        sort_numeric=tuple(int(row[f"_snum{i}"]) for i in n),
        time_detail=tuple(int(row[f"_detail{i}"]) if isinstance(types[i], _TIME_TYPES) else 0 for i in n))


def normalize(df: DataFrame, keep: bool = False) -> tuple[DataFrame, SideProfile]:
    """Write the normalised side to scratch once; its profile is observed by the same job.

    The input keeps its partitioning: a large table arrives in many splits.  Of a text column
    only the text is written: where all its values are numbers, their parse is a plain cast
    (elsewhere nobody reads it).
    """
    spark = df.sparkSession
    ndf, names, types = normal_columns(df, keep)
    obs = Observation(f"profile_{uuid.uuid4().hex[:8]}")
    path = scratch_path(spark, "normalized")
    parsed = {f"_{view}{i}" for i, t in enumerate(types) for view in ("n", "sn")
              if view == "sn" or isinstance(t, T.StringType)}
    kept = [c for c in ndf.columns if c not in parsed]
    ndf.observe(obs, *_profile_marks(types)).select(*kept).write.mode("overwrite").parquet(path, compression=COMPRESSION)
    prof = _observed_profile(obs.get, names, types)

    def number(i: int, whole: bool) -> Column:
        if not isinstance(types[i], T.StringType):
            return F.col(f"_n{i}") if whole else F.lit(None).cast("double")
        return (F.trim(f"_l{i}", F.lit(ASCII_SPACE)).try_cast("double") if whole else F.lit(None).cast("double"))

    again = {f"_{view}{i}": number(i, whole(i)) for i in range(len(types))
             for view, whole in (("n", prof.is_numeric), ("sn", prof.sorts_numeric)) if f"_{view}{i}" in parsed}
    return spark.read.parquet(path).withColumns(again).select(*ndf.columns), prof


def profile(df: DataFrame) -> tuple[DataFrame, SideProfile]:
    return normalize(df)


def name_lookup(names: Sequence[str]) -> dict[str, int]:
    """Lower-cased name to column index; the last of case-insensitive duplicates wins."""
    return {str(c).lower(): i for i, c in enumerate(names)}


def sort_order(prof: SideProfile, keys: Sequence[str] | None) -> list[int]:
    """Column indices by sort rank: a key's place among the keys, or behind all keys its own place."""
    by_name, rank = name_lookup(prof.names), {}
    for place, key in enumerate(keys or ()):
        rank.setdefault(by_name.get(key.lower()), place)
    behind = len(rank) + len(keys or ())
    return sorted(range(len(prof.names)), key=lambda i: rank.get(i, behind + i))


def sort_exprs(prof: SideProfile, keys: Sequence[str] | None) -> list[Column]:
    """Numeric view for wholly numeric columns, else the stripped lower-cased text; nulls last."""
    return [(F.col(f"_sn{i}") if prof.sorts_numeric(i) else F.col(f"_l{i}")).asc_nulls_last()
            for i in sort_order(prof, keys)]


def positioned(df: DataFrame, keys: Sequence[str] | None = None, keep: bool = False
               ) -> tuple[DataFrame, SideProfile]:
    """Normalised side plus its 0-based sorted position ``_pos``."""
    ndf, prof = normalize(df, keep)
    if prof.rows == 0 or not prof.names:
        return ndf.withColumn("_pos", F.lit(0).cast("long")), prof
    return with_positions(ndf, sort_exprs(prof, keys), pos_col="_pos"), prof


def filled_counts(df: DataFrame, name_col: str, count_col: str) -> DataFrame:
    """One row per column of ``df``: its name and how many of its values are not null (one aggregate)."""
    positional = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    counts = positional.agg(*[F.count(c).alias(c) for c in positional.columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias(name_col), F.col(f"_{i}").alias(count_col)) for i, name in enumerate(df.columns)])))


def schema_join(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """Every gold column with its case-insensitive namesake in actual, or none."""
    g = filled_counts(gold, "gold_column", "gold_filled")
    a = filled_counts(actual, "actual_column", "actual_filled")
    return g.join(a, F.lower(g["gold_column"]) == F.lower(a["actual_column"]), "left")


@dataclass(frozen=True)
class ColumnPlan:
    gold_index: int
    gold_name: str
    actual_index: int | None
    numeric: bool


def column_plan(gp: SideProfile, ap: SideProfile) -> list[ColumnPlan]:
    lookup = name_lookup(ap.names)
    out = []
    for i, name in enumerate(gp.names):
        j = lookup.get(str(name).lower())
        out.append(ColumnPlan(i, name, j, j is not None and gp.is_numeric(i) and ap.is_numeric(j)))
    return out


def _folded(c: Column, i: int, prof: SideProfile) -> Column:
    if isinstance(prof.types[i], _TIME_TYPES):
        c = F.substring(c, 1, TIME_WIDTHS[prof.time_detail[i]])
    return F.replace(c, F.lit("ß"), F.lit("ss"))


def verdict_expr(p: ColumnPlan, gp: SideProfile, ap: SideProfile) -> Column:
    if p.numeric:
        return tolerant_equal(F.col(f"g._n{p.gold_index}"), F.col(f"a._n{p.actual_index}"))
    g, a = _folded(F.col(f"g._l{p.gold_index}"), p.gold_index, gp), _folded(F.col(f"a._l{p.actual_index}"), p.actual_index, ap)
    return F.coalesce(g.eqNullSafe(a), F.lit(False))


def paired(gold_pos: DataFrame, actual_pos: DataFrame) -> DataFrame:
    return gold_pos.alias("g").join(actual_pos.alias("a"), F.col("g._pos") == F.col("a._pos"), "inner")


@dataclass(frozen=True)
class Prepared:
    """A side normalised once (written to scratch) with its profile; reusable across comparisons."""
    frame: DataFrame
    profile: SideProfile


def prepare(df: DataFrame) -> Prepared:
    return Prepared(*normalize(df))


def _side(x: DataFrame | Prepared) -> tuple[DataFrame, SideProfile]:
    return (x.frame, x.profile) if isinstance(x, Prepared) else normalize(x)


def _sides(gold: DataFrame | Prepared, actual: DataFrame | Prepared):
    """Both sides normalised; when both still need their pass, the two jobs run concurrently."""
    if isinstance(gold, Prepared) or isinstance(actual, Prepared):
        return _side(gold), _side(actual)
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=2) as pool:
        g, a = pool.submit(normalize, gold), pool.submit(normalize, actual)
        return g.result(), a.result()


def _sort_values(prof: SideProfile, keys: Sequence[str] | None) -> list[Column]:
    return [F.col(f"_sn{i}") if prof.sorts_numeric(i) else F.col(f"_l{i}") for i in sort_order(prof, keys)]


def verdict_row(gdf: DataFrame, gp: SideProfile, adf: DataFrame, ap: SideProfile, present: Sequence[ColumnPlan],
                keys: Sequence[str] | None):
    """One row, ``_v{i}`` 1 where all positions of gold column i agree.

    Both sides go through one range exchange.  Each side follows its own sort: place k of the
    order is a number, a text, or (when the sides differ) both, one of which is null all over a
    side.  A cell that its column's sort value yields is taken from that behind the exchange and
    does not travel beside it.  Rows are numbered per side inside a partition as they are
    written, without their sort values; the driver adds up the rows of each (partition, side),
    two numbers a partition, and the verdicts of all columns come from one aggregate over the
    pairs.
    """
    spark = gdf.sparkSession
    orders = [_sort_values(gp, keys), _sort_values(ap, keys)]
    numeric = [[prof.sorts_numeric(i) for i in sort_order(prof, keys)] for prof in (gp, ap)]
    sides, again = [], []
    for side, (df, prof) in enumerate(((gdf, gp), (adf, ap))):
        places = sort_order(prof, keys)
        values = []
        for k in range(max(map(len, orders))):
            kinds = {n[k] for n in numeric if k < len(n)}
            for is_number in sorted(kinds):
                own = k < len(orders[side]) and numeric[side][k] == is_number
                value = orders[side][k] if own else F.lit(None).cast("double" if is_number else "string")
                values.append(value.alias(f"_s{k}{'n' if is_number else 't'}"))
        cells, found = {}, {}
        for p in present:
            i = p.actual_index if side else p.gold_index
            sorted_by = F.col(f"_s{places.index(i)}{'n' if prof.sorts_numeric(i) else 't'}")
            if p.numeric and prof.sorts_numeric(i) and isinstance(prof.types[i], (*_NUMBER_TYPES, T.StringType)):
                found[p.gold_index] = sorted_by
            elif not p.numeric and not prof.sorts_numeric(i):
                found[p.gold_index] = _folded(sorted_by, i, prof)
            else:
                cells[p.gold_index] = F.col(f"_n{i}") if p.numeric else _folded(F.col(f"_l{i}"), i, prof)
                found[p.gold_index] = F.col(f"_x{p.gold_index}")
        sides.append((df, values, cells))
        again.append(found)
    carried = sorted(sides[0][2].keys() | sides[1][2].keys())
    kinds = {p.gold_index: "double" if p.numeric else "string" for p in present}
    sides = [df.select(F.lit(side).alias("_side"), *values,
                       *[cells.get(i, F.lit(None).cast(kinds[i])).alias(f"_x{i}") for i in carried])
             for side, (df, values, cells) in enumerate(sides)]
    cells = [F.when(F.col("_side") == 0, again[0][p.gold_index]).otherwise(again[1][p.gold_index]).alias(f"_x{p.gold_index}")
             for p in present]
    both = sides[0].unionByName(sides[1]).withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_last() for c in both.columns if c.startswith("_s") and c != "_side"] + [F.col("_tie").asc()]
    ranged = (both.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
              .sortWithinPartitions(F.col("_side"), *order).withColumn("_mid", F.monotonically_increasing_id())
              .select("_side", "_mid", *cells))
    fixed = materialize(ranged, "ranged-pair", COMPRESSION).withColumn("_part", F.shiftright("_mid", LOCAL_BITS).cast("int"))
    counts = fixed.groupBy("_part", "_side").agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("first")).collect()
    before, shifts = [0, 0], {}
    for r in sorted(counts, key=lambda r: (r["_part"], r["_side"])):
        shifts[r["_part"], r["_side"]] = before[r["_side"]] - r["first"]
        before[r["_side"]] += r["n"]
    parts = 1 + max(part for part, _ in shifts)
    shift = F.lit([shifts.get((part, side), 0) for part in range(parts) for side in (0, 1)]).cast("array<bigint>")
    placed = fixed.withColumn("_pos", F.col("_mid") + F.element_at(shift, F.col("_part") * 2 + F.col("_side") + 1))
    g, a = (placed.filter(F.col("_side") == side).alias("ga"[side]) for side in (0, 1))
    pairs = g.join(a, F.col("g._pos") == F.col("a._pos"))

    def agree(p: ColumnPlan) -> Column:
        left, right = F.col(f"g._x{p.gold_index}"), F.col(f"a._x{p.gold_index}")
        return tolerant_equal(left, right) if p.numeric else F.coalesce(left.eqNullSafe(right), F.lit(False))

    return pairs.agg(*[F.coalesce(F.min(agree(p).cast("int")), F.lit(1)).alias(f"_v{p.gold_index}") for p in present]).first()


def column_verdicts(gold: DataFrame | Prepared, actual: DataFrame | Prepared, keys: Sequence[str] | None = None
                    ) -> tuple[list[tuple[ColumnPlan, bool]], SideProfile, SideProfile, bool]:
    """Per gold column (plan, matched); also both profiles and whether row counts agree."""
    (gdf, gp), (adf, ap) = _sides(gold, actual)
    plans = column_plan(gp, ap)
    if gp.rows != ap.rows:
        return [(p, False) for p in plans], gp, ap, False
    present = [p for p in plans if p.actual_index is not None]
    results: dict[int, bool] = {}
    if present and gp.rows > 0:
        row = verdict_row(gdf, gp, adf, ap, present, keys)
        results = {p.gold_index: bool(row[f"_v{p.gold_index}"]) for p in present}
    else:
        results = {p.gold_index: True for p in present}
    return [(p, results.get(p.gold_index, False)) for p in plans], gp, ap, True


def compare_tables(gold: DataFrame | Prepared, actual: DataFrame | Prepared,
                   keys: Sequence[str] | None = None) -> TableScore:
    verdicts, _, _, same_rows = column_verdicts(gold, actual, keys)
    return TableScore(tuple((plan.gold_name, ok) for plan, ok in verdicts), same_rows)


def compare_many(pairs: Sequence[tuple[str, DataFrame | Prepared, DataFrame | Prepared, Sequence[str] | None]],
                 parallel: int = 4) -> list[tuple[str, TableScore]]:
    """Score independent ``(name, gold, actual, keys)`` pairs, their jobs submitted concurrently.

    Each comparison is a handful of small jobs with driver round trips between
    them; running several at once keeps the executors busy in those gaps.
    """
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(pairs)))) as pool:
        futures = [(name, pool.submit(compare_tables, gold, actual, keys)) for name, gold, actual, keys in pairs]
        return [(name, f.result()) for name, f in futures]


def score_frame(spark, rows: Sequence[tuple[str, TableScore]]) -> DataFrame:
    """Scores as a small DataFrame ``(pair, score, matched_columns, total_columns, row_count_match)``."""
    schema = T.StructType([T.StructField("pair", T.StringType())] + SCORE_SCHEMA.fields)
    data = [(name, round(s.score, 6), s.matched_columns, s.total_columns, s.row_count_match) for name, s in rows]
    return spark.createDataFrame(data, schema)
