"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, modulo the prime 2^31 - 1, the running sums of
``code point * base^position`` for two bases.  A difference of two entries, shifted
by an inverse power, is the hash of a span, so the equality of any two spans is one
comparison, and the longest common extension of two positions a binary search.

A fingerprint is a string of hexadecimal digits: length, both whole-text hashes, and
a sketch with, in each of ``SLOTS`` slots, 8 bits of the least hash among the text's
spans of ``SPAN`` code points (equal spans numbered apart) that fall there.  The
likeness of two fingerprints is the share of equal slots, corrected for chance, an
estimate of the share of spans that the texts have in common; equal texts have equal
fingerprints and likeness 1.

Neighbours in descending id order come from one range partitioning: a task holds one
row back until it has seen the next.  Only the last row of each partition waits for
the first row of the following one (the first of all after the last); those rows,
two per partition, go through a written table.

Defined cases: null text is empty; an empty text is like an empty one (1) and unlike
any other (0); null ids come last; equal ids follow a hash of their texts; a single
row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import small_batches, text_rows

PRIME = np.uint64(2**31 - 1)
BASES = (1_000_003, 911_382_323)
SPAN = 12
#: Texts of fewer code points have shorter spans, so that a small edit leaves some whole.
SHORT_BELOW, SHORT_SPANS = np.array([8, 16, 32, 64]), np.array([1, 2, 3, 6, SPAN])
SLOTS = 64
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, common_prefix long")
NAMES = [c.split(" ")[0] for c in RESULT.split(", ")]


def _mod(x: np.ndarray) -> np.ndarray:
    """Modulo 2^31 - 1 of numbers below 2^62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) at least, modulo the prime."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, _mod(have * np.uint64(pow(base, len(have), int(PRIME))))])
    _powers[base] = have
    return have


class PrefixHashes:
    """Prefix arrays of many texts laid end to end."""

    def __init__(self, texts: list[str], bases=BASES):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.place = np.arange(len(points)) - np.repeat(self.starts, self.sizes)
        most = int(self.sizes.max(initial=0)) + 1
        self.inverse = [powers(pow(b, -1, int(PRIME)), most) for b in bases]
        self.sums = []
        for base in bases:
            terms = _mod(points * powers(base, most)[self.place])
            self.sums.append(_mod(np.concatenate([[np.uint64(0)], np.cumsum(terms)])))

    def spans(self, k: int, text: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash, under base ``k``, of ``length`` code points from place ``at`` of each text."""
        lo = self.starts[text] + at
        diff = _mod(self.sums[k][lo + length] + PRIME - self.sums[k][lo])
        return _mod(diff * self.inverse[k][at])

    def equal(self, text_a, at_a, text_b, at_b, length) -> np.ndarray:
        """Whether spans are equal (arrays), under every base."""
        same = np.ones(len(length), bool)
        for k in range(len(self.sums)):
            same &= self.spans(k, text_a, at_a, length) == self.spans(k, text_b, at_b, length)
        return same

    def common_extension(self, text_a, at_a, text_b, at_b) -> np.ndarray:
        """Length of the longest common extension of each pair of positions, by binary search."""
        low = np.zeros(len(text_a), np.int64)
        high = np.minimum(self.sizes[text_a] - at_a, self.sizes[text_b] - at_b)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(text_a, at_a, text_b, at_b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def sketches(self) -> np.ndarray:
        """(texts, SLOTS) bytes; rows of empty texts are 0."""
        n = len(self.sizes)
        best = np.full(n * SLOTS, np.iinfo(np.uint32).max, np.uint32)
        owner = np.repeat(np.arange(n), self.sizes)
        width = SHORT_SPANS[np.searchsorted(SHORT_BELOW, self.sizes, "right")]
        where = np.flatnonzero(self.place + width[owner] <= self.sizes[owner])
        text, at = owner[where], self.place[where]
        h = self.spans(0, text, at, width[text])
        key = np.sort((text.astype(np.uint64) << np.uint64(31)) | h)
        # the k-th equal span of a text counts as (span, k): repeated text weighs what it takes up
        every = np.arange(len(key))
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.ones(0, bool)
        seen = (every - np.maximum.accumulate(np.where(new, every, 0))).astype(np.uint64)
        text = (key >> np.uint64(31)).astype(np.int64)
        h = ((key & PRIME) + (seen << np.uint64(31)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum.at(best, text * SLOTS + (h >> np.uint64(58)).astype(np.int64),
                      ((h >> np.uint64(16)) & np.uint64(0xFFFFFFFE)).astype(np.uint32))
        best = best.reshape(n, SLOTS)
        gap = best == np.iinfo(np.uint32).max
        gap[self.sizes == 0] = False
        filled = (best * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
        for _ in range(SLOTS - 1):  # an empty slot takes the next filled one's value, changed by the distance
            if not gap.any():
                break
            filled = np.where(gap, np.roll(filled, -1, 1) * np.uint8(5) + np.uint8(1), filled)
            gap &= np.roll(gap, -1, 1)
        filled[self.sizes == 0] = 0
        return filled

    def fingerprints(self) -> list[str]:
        every = np.arange(len(self.sizes))
        zero = np.zeros(len(self.sizes), np.int64)
        wholes = [self.spans(k, every, zero, self.sizes) for k in range(len(self.sums))]
        sketch = self.sketches()
        return [f"{n:08x}" + "".join(f"{int(w[i]):08x}" for w in wholes) + sketch[i].tobytes().hex()
                for i, n in enumerate(self.sizes)]


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    if a == b:
        return 1.0
    if not int(a[:8], 16) or not int(b[:8], 16):
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s[8 * (1 + len(BASES)):]), np.uint8) for s in (a, b))
    same = float((x == y).mean())
    return min(0.99, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def _rows(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    """Results of each text with the document after it."""
    changed = [edited(t, x) for t, x in zip(texts, nexts, strict=True)]
    n = len(texts)
    hashes = PrefixHashes(texts + changed)
    prints = hashes.fingerprints()
    zero = np.zeros(n, np.int64)
    common = hashes.common_extension(np.arange(n), zero, np.arange(n, 2 * n), zero)
    # the next document is mostly the next row of the slice
    after = [prints[i + 1] if i + 1 < n and texts[i + 1] is nexts[i] else None for i in range(n)]
    other = [i for i, p in enumerate(after) if p is None]
    for i, p in zip(other, PrefixHashes([nexts[i] for i in other]).fingerprints() if other else [], strict=True):
        after[i] = p
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array(prints[:n]), pa.array(prints[n:]),
        pa.array([likeness(a, b) for a, b in zip(prints[:n], prints[n:], strict=True)]),
        pa.array([likeness(a, b) for a, b in zip(prints[:n], after, strict=True)]),
        pa.array(common)], names=NAMES)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows but the partition's last; its first and last rows for the next step."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    blank = {f: None for f in NAMES}

    def edge(role: str, doc_id, text: str) -> pa.RecordBatch:
        row = blank | {"doc_id": doc_id, "role": role, "part": part, "text": text}
        return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    held: tuple | None = None
    for batch in small_batches(batches, "text", most_bytes=2 << 20):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        if held is None:
            yield edge("first", ids[0], texts[0])
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = (ids[-1], texts[-1])
        if len(ids) > 1:
            done = _rows(ids[:-1], texts[:-1], texts[1:])
            yield pa.RecordBatch.from_arrays(
                [*done.columns, *(pa.nulls(len(ids) - 1, f.type) for f in list(SCHEMA)[len(NAMES):])], schema=SCHEMA)
    if held is not None:
        yield edge("last", *held)


SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split(" ")[1]])
                    for n, c in zip(NAMES, RESULT.split(", "), strict=True)]
                   + [("role", pa.string()), ("part", pa.int64()), ("text", pa.string())])


def _waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", most_bytes=2 << 20):
        yield _rows(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and their edited texts, with likenesses; see ``RESULT``."""
    order = F.col("doc_id").desc_nulls_last()
    rows = text_rows(df, id_col, text_col)
    ordered = rows.repartitionByRange(order).sortWithinPartitions(order, F.xxhash64("text"), "text")
    table = materialize(ordered.mapInArrow(_neighbours, f"{RESULT}, role string, part long, text string"), "fingerprints")
    # two rows per partition: its first row is the next document of the last row of the one before
    firsts = table.filter("role = 'first'").select("part", "text")
    by_part = Window.orderBy("part")
    following = firsts.select("part", F.coalesce(
        F.lead("text").over(by_part),
        F.first("text").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ).alias("following"))
    last = (table.filter("role = 'last'").select("part", "doc_id", "text").join(following, "part")
            .select("doc_id", "text", "following").mapInArrow(_waiting, RESULT))
    return table.filter("role is null").select(*NAMES).unionByName(last)
