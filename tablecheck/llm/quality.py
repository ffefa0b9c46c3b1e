"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words (hashed), its words' shapes (upper, lower, digit and
each punctuation mark, runs collapsed) and how often a word repeats the word one or
two places before it.  Words and shapes are weighted by inverse document frequency
and normalised apart, so that neither drowns the other; a truncated singular value
decomposition of labelled texts gives the latent space.

Labelled vectors are a bounded sample: at most ``per_class`` texts of either label,
the smallest by hash of their id.  They and the projection are broadcast (a few MB,
bounded by ``per_class`` and ``RANK``).  Every text is projected, its cosine to
every labelled vector is computed exactly, in blocks of rows, and the ``NEIGHBOURS``
nearest vote with their similarity; votes are weighted back to the labels' true
shares, as the sample may hold one label more often than the corpus does.

Defined cases: null and empty texts have no terms and get the base rate of label 1;
null labels are ignored, several labels of one id are averaged; with no labelled
text every score is 0.5; one label only: every score is that label; empty tables
give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_encoders, small_batches, text_rows

WORD_BUCKETS = 2048
SHAPE_BUCKETS = 512
TERMS = WORD_BUCKETS + SHAPE_BUCKETS + 2
RANK = 48
PER_CLASS = 2048
NEIGHBOURS = 24
BLOCK = 256

_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _classes() -> np.ndarray:
    """Byte -> class: 0 white space, 1 lower case and bytes over 127, 2 upper case, 3 digit, else the byte."""
    table = np.arange(256, dtype=np.uint8)
    table[:33] = 0
    table[ord("a"):ord("z") + 1] = 1
    table[127:] = 1
    table[ord("A"):ord("Z") + 1] = 2
    table[ord("0"):ord("9") + 1] = 3
    return table


CLASSES = _classes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of all terms of ``texts``, one entry per distinct pair."""
    raws = [t.encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    classes = CLASSES[data]
    inside = classes > 0
    if not inside.any():
        return (np.empty(0, np.int64),) * 3
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    last = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    word = np.repeat(np.arange(len(first)), last - first)
    at = np.flatnonzero(inside)
    offset = at - first[word]
    lengths = last - first
    bounds = np.cumsum(lengths) - lengths
    symbols = data[at].astype(np.uint64) + np.uint64(1)
    hashes = _mix(np.add.reduceat(symbols * _POWERS[offset & 1023], bounds))
    kind = classes[at]
    new = np.ones(len(at), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (offset[1:] == 0)
    runs = np.cumsum(new)
    run_at = runs - runs[bounds][word]
    shapes = _mix(np.add.reduceat(np.where(new, (kind.astype(np.uint64) + np.uint64(1)) * _POWERS[run_at & 1023],
                                           np.uint64(0)), bounds))
    row = np.searchsorted(ends, first - 1, "right")
    terms = [(hashes % np.uint64(WORD_BUCKETS)).astype(np.int64),
             WORD_BUCKETS + (shapes % np.uint64(SHAPE_BUCKETS)).astype(np.int64)]
    rows = [row, row]
    for back in (1, 2):
        same = np.flatnonzero((hashes[back:] == hashes[:-back]) & (row[back:] == row[:-back])) + back
        rows.append(row[same])
        terms.append(np.full(len(same), TERMS - 3 + back))
    keys, counts = np.unique(np.concatenate(rows) * TERMS + np.concatenate(terms), return_counts=True)
    return keys // TERMS, keys % TERMS, counts


def weighted(rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """Dense (n, TERMS) float32 rows: damped counts by idf, words and the rest normalised apart."""
    dense = np.zeros((n, TERMS), np.float32)
    words = terms < WORD_BUCKETS
    value = np.where(words, 1 + np.log(counts), counts) * idf[terms]
    dense[rows, terms] = value
    for part, weight in ((slice(0, WORD_BUCKETS), 0.5), (slice(WORD_BUCKETS, TERMS), 1.0)):
        own = dense[:, part]
        norm = np.sqrt(np.einsum("ij,ij->i", own, own))[:, None]
        own *= (weight / np.maximum(norm, 1e-12)).astype(np.float32)
    return dense


@dataclass
class QualityModel:
    idf: np.ndarray
    projection: np.ndarray  # (TERMS, RANK)
    vectors: np.ndarray  # (labelled, RANK), unit length
    labels: np.ndarray
    votes: np.ndarray  # weight of each labelled vector's vote
    base: float

    def embed(self, texts: list[str]) -> np.ndarray:
        dense = weighted(*term_counts(texts), len(texts), self.idf)
        low = dense @ self.projection
        return low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.base)
        if not len(self.labels):
            return out
        for i in range(0, len(texts), BLOCK):
            block = texts[i:i + BLOCK]
            low = self.embed(block)
            cosine = low @ self.vectors.T
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 2 * self.votes[near]
            total = vote.sum(axis=1)
            known = (np.abs(low).sum(axis=1) > 1e-6) & (total > 1e-12)
            out[i:i + BLOCK][known] = np.clip((vote * self.labels[near]).sum(axis=1)[known] / total[known], 0, 1)
        return out


def truncated_svd(blocks: Callable[[], Iterator[np.ndarray]], shape: tuple[int, int], rank: int,
                  rounds: int = 4) -> np.ndarray:
    """Right singular vectors by randomised subspace iteration (fixed seed), from row blocks made anew each round."""
    rank = min(rank, *shape)
    q = np.random.default_rng(7).standard_normal((shape[1], min(rank + 12, shape[1]))).astype(np.float32)
    for _ in range(rounds):
        total = np.zeros_like(q)
        for block in blocks():
            total += block.T @ (block @ q)
        q, _ = np.linalg.qr(total)
    _, _, v = np.linalg.svd(np.concatenate([block @ q for block in blocks()]), full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (a null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit_quality(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", per_class: int = PER_CLASS) -> QualityModel:
    """Fit on at most ``per_class`` labelled texts of either label; held-out ids are never read."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
             .dropna().filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows, terms, counts = term_counts(batch.column("text").to_pylist())
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "y": batch.column("y"),
                "terms": [terms[a:b].astype("<u2").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)],
                "counts": [counts[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]})

    # at most 2 * per_class rows of at most TERMS terms: a bounded sample, by parameter
    chosen = text_rows(df, id_col, text_col).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")
    sample = chosen.mapInArrow(count, "doc_id long, y int, terms binary, counts binary").toArrow()
    n, n_known = sample.num_rows, sum(totals.values())
    base = totals.get(1, 0) / n_known if n_known else 0.5
    if not n:
        none = np.empty(0)
        return QualityModel(np.ones(TERMS), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), none, none, base)
    ids, raws = np.asarray(sample.column("doc_id")), sample.column("terms").to_pylist()
    order = sorted(range(n), key=lambda i: (ids[i], len(raws[i]), raws[i]))
    y = np.asarray(sample.column("y"))[order].astype(np.float64)
    raws = [raws[i] for i in order]
    bounds = np.cumsum([0] + [len(r) // 2 for r in raws])
    flat = np.frombuffer(b"".join(raws), "<u2")
    raws = sample.column("counts").to_pylist()
    counts = np.frombuffer(b"".join(raws[i] for i in order), "<i4")
    del sample, raws
    in_docs = np.bincount(flat, minlength=TERMS)
    idf = np.log((1 + n) / (1 + in_docs)) + 1.0

    def blocks() -> Iterator[np.ndarray]:
        for i in range(0, n, BLOCK):
            own = bounds[i:i + BLOCK + 1]
            at = slice(own[0], own[-1])
            yield weighted(np.repeat(np.arange(len(own) - 1), np.diff(own)), flat[at], counts[at], len(own) - 1, idf)

    projection = truncated_svd(blocks, (n, TERMS), RANK)
    low = np.concatenate([block @ projection for block in blocks()])
    vectors = (low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    here = np.array([(y == 0).sum(), (y == 1).sum()])
    share = np.array([totals.get(0, 0), totals.get(1, 0)]) / np.maximum(here, 1)
    return QualityModel(idf, projection, vectors, y, share[y.astype(int)], base)


def score_quality(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(found)})

    return text_rows(df, id_col, text_col).mapInArrow(score, "doc_id long, score double")


def keep_by_quality(df: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text scores ``threshold`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for batch in small_batches(batches, text_col):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(shared.value.score(texts) >= threshold))

    return df.mapInArrow(keep, df.schema)
