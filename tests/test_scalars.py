import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tablecheck.functions import scalars as SC

EDGE = [" 5 ", "+5", "-5", ".5", "5.", "1e5", "1E+5", "inf", "-inf", "INF", "Infinity", "-Infinity",
        "+inf", "nan", "NaN", "1,000", "1_000", "0x10", "1d", "1f", "2.5D", "$4", "True", "", " ",
        "5 .", "1e", "e5", "\t7\n", "00012", "-0", "+.5e2", "1.5e-3", None]


def test_numeric_parse_matches_pandas(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(EDGE)], "i int, v string")
    got = {r.i: r.p for r in df.select("i", SC.numeric_parse(F.col("v")).alias("p")).collect()}
    expected = pd.to_numeric(pd.Series(EDGE, dtype="string"), errors="coerce")
    for i, v in enumerate(EDGE):
        e = expected[i]
        if pd.isna(e):
            assert got[i] is None, (v, got[i])
        else:
            assert got[i] == float(e), (v, got[i], e)


def test_tolerant_equal_matches_isclose(spark):
    pairs = [(100.0, 101.005), (101.005, 100.0), (1.0, 1.0 + 5e-10), (0.0, 1e-10), (float("inf"), float("inf")),
             (float("inf"), float("-inf")), (5.0, float("inf")), (None, None), (None, 1.0), (2.0, None),
             (1.0, 1.0099), (1.0, 1.0101), (-3.0, -2.97)]
    df = spark.createDataFrame(pairs, "g double, a double")
    got = [r.e for r in df.select(SC.tolerant_equal(F.col("g"), F.col("a")).alias("e")).collect()]
    for (g, a), e in zip(pairs, got):
        if g is None or a is None:
            assert e == (g is None and a is None)
        else:
            assert e == bool(np.isclose(g, a, rtol=1e-2, atol=1e-9)), (g, a, e)


def test_text_normalisation(spark):
    vals = ["  Ab  ", "\tSTRASSE\n", "Straße", " x　", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    rows = df.select(SC.strip_unicode(F.col("v")).alias("s"), SC.fold_text(F.col("v")).alias("f")).collect()
    for v, r in zip(vals, rows):
        if v is None:
            assert r.s is None and r.f is None
            continue
        assert r.s == v.strip()
        assert r.f == v.strip().casefold()


def test_null_tokens(spark):
    df = spark.createDataFrame([(t,) for t in SC.NULL_TOKENS + ("-", "NIL", "none")], "v string")
    got = [r.v for r in df.select(SC.null_tokens(F.col("v")).alias("v")).collect()]
    assert got[: len(SC.NULL_TOKENS)] == [None] * len(SC.NULL_TOKENS)
    assert got[len(SC.NULL_TOKENS):] == ["-", "NIL", "none"]
    assert not any(isinstance(x, float) and math.isnan(x) for x in got)
