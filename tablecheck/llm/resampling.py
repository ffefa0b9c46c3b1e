"""Target-distribution importance resampling over hashed n-grams.

Words are runs of digits, ASCII letters (lower-cased) and all characters beyond ASCII;
features are the runs of 1 to ``max_n`` consecutive words, each in the bucket that the
crc32 of its UTF-8 bytes names.  A bucket's gain is the scaled, floored log ratio of its
smoothed share in the target texts to that in the raw texts; a text's weight is the
floored mean gain of its features, its score adds Gumbel noise from a hash of its id, and
the highest scores are drawn: sampling without replacement in proportion to the ratio.

A batch of texts is joined into one byte string with a sentinel after each text.  One
regular expression finds all words and sentinels, ``searchsorted`` over the sentinels'
places says which text each word belongs to, features that would cross two texts are
masked, and ``bincount`` adds up buckets or gains.  The checksum of a longer feature comes
from those of its words (:func:`appended`), so no feature is ever spelled out.

The corpus is read twice: for the bucket counts (every task adds one count per bucket, at
most ``buckets`` rows each, summed before and after the shuffle) and for the weights.
Between the passes the driver holds two arrays of ``buckets`` numbers, whatever the input,
which is also all that is sent to the executors.  Ranks come from a distributed sort.

Defined cases: null and empty texts have no words, no features and weight 0; rows that
repeat an id are rows of their own (equal scores of one id are ranked in any order); a
null id takes the noise of the empty id and loses ties; an empty target makes every gain
that of smoothing alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import with_positions
from .common import small_batches, text_rows, written

BUCKETS = 10_000
MAX_N = 2
SCALE = 1000
SENTINEL = b"\x00"
# Words as UTF-8 bytes after lower-casing: no byte below 0x80 but digits and small letters.
TOKENS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|\x00")
_SENTINEL_CRC = zlib.crc32(SENTINEL)


@cache
def _zero_operators() -> np.ndarray:
    """[k, byte place, byte value] -> what 2**k appended zero bytes make of these bits of a checksum."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    values = np.arange(256, dtype=np.uint32)
    one = np.stack([values << np.uint32(8 * place) for place in range(4)])
    one = table[one & 255] ^ (one >> np.uint32(8))
    operators = [one]
    for _ in range(31):
        operators.append(_apply(operators[-1], operators[-1]))
    return np.stack(operators)


def _apply(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (operator[0][crc & 255] ^ operator[1][(crc >> 8) & 255]
            ^ operator[2][(crc >> 16) & 255] ^ operator[3][crc >> 24])


def appended(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """crc32 of byte strings a + b from those of a and b and the length of b."""
    out = left.astype(np.uint32)
    for k in range(int(right_length.max(initial=0)).bit_length()):
        at = np.flatnonzero((right_length >> k) & 1)
        out[at] = _apply(_zero_operators()[k], out[at])
    return out ^ right


def batch_features(texts: list[str], buckets: int = BUCKETS, max_n: int = MAX_N
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature, bucket of each feature, words of each text)."""
    joined = b"".join([t.encode().replace(SENTINEL, b" ") + SENTINEL for t in texts]).lower()
    found = TOKENS.findall(joined)
    crc = np.fromiter(map(zlib.crc32, found), np.uint32, len(found))
    length = np.fromiter(map(len, found), np.int64, len(found))
    del found
    ends = np.flatnonzero((length == 1) & (crc == _SENTINEL_CRC))  # crc32 tells single bytes apart
    place = np.delete(np.arange(len(crc)), ends)
    text = np.searchsorted(ends, place)
    crc, length = crc[place], length[place]
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    after_space = appended(space, crc, length)
    owners, found_buckets, run = [text], [crc % buckets], crc
    for n in range(2, max_n + 1):
        inside = text[n - 1:] == text[:max(len(text) - n + 1, 0)]
        run = appended(run[:max(len(run) - 1, 0)], after_space[n - 1:], length[n - 1:] + 1)
        owners.append(text[n - 1:][inside])
        found_buckets.append(run[inside] % buckets)
    return np.concatenate(owners), np.concatenate(found_buckets), np.bincount(text, minlength=len(texts))


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N) -> np.ndarray:
    """Features of all ``rows`` (text) by bucket: an array of ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in small_batches(batches, "text"):
            totals += np.bincount(batch_features(batch.column("text").to_pylist(), buckets, max_n)[1],
                                  minlength=buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(totals[used])})

    totals = (rows.select("text").mapInArrow(count, "bucket int, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most `buckets` rows
    out = np.zeros(buckets, np.int64)
    for row in totals:
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE * ln of the smoothed target share over the smoothed raw share), by bucket."""
    n = float(len(raw))
    ratio = (target + 1.0) * (raw.sum() + n) / ((raw + 1.0) * (target.sum() + n))
    return np.floor(SCALE * np.log(ratio))


def weigh(rows: DataFrame, gains: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """doc_id, n_words, n_features, weight of ``rows`` (doc_id, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(gains)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            text, bucket, words = batch_features(batch.column("text").to_pylist(), len(shared.value), max_n)
            n = np.bincount(text, minlength=batch.num_rows)
            total = np.bincount(text, shared.value[bucket], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(words.astype(np.int64)),
                "n_features": pa.array(n.astype(np.int64)), "weight": pa.array(total // np.maximum(n, 1))})

    return rows.mapInArrow(one, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = 7) -> Column:
    """floor(SCALE * Gumbel noise) from the hash of ``seed:doc_id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(df: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = BUCKETS,
             max_n: int = MAX_N, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: rank 1, 2, 3... of the drawn rows, null of all others.

    Of the N texts with at least ``min_words`` words, floor(``percent`` * N / 100) are drawn.
    """
    rows = text_rows(df, id_col, text_col)
    wanted = target.select(F.coalesce(F.col(target_text_col).cast("string"), F.lit("")).alias("text"))
    gains = bucket_gains(bucket_counts(rows, buckets, max_n), bucket_counts(wanted, buckets, max_n))
    scored = written(weigh(rows, gains, max_n).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)),
                     "resampling-scores")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    ranked = with_positions(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], pos_col="place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long")
    rest = scored.filter(F.col("n_words") < min_words)
    return (ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
            .unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))))
