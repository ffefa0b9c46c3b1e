"""N-gram Jaccard join by vertical partitioning of a global n-gram order.

A document's set holds its distinct word 5-grams as numbers: a frequency code from a
bucket count over the whole corpus (rarer first), then hash bits.  Their order is the
global order; it is the same for all documents, so any frequency estimate gives right
results, and a good one short candidate lists.

1. Documents with equal sets form a class, which its smallest id stands for.
2. By the prefix filter, two sets that reach the threshold share one of their first
   ``n - ceil(t * n) + 1`` n-grams.  Equal prefix n-grams make candidate lists; sizes
   and positions of the shared n-gram drop the pairs that cannot reach it.
3. The global order is cut into ``FRAGMENTS`` fragments of about equal mass.  For a
   candidate pair the overlaps of its fragments are counted separately and summed,
   as long as the pair can still reach the threshold.
4. First every list's member is paired with the list's centre (its earliest holder).
   Links found so far make components; then the lists' pairs whose members lie in
   different components are checked as well, all of them, so that no link is lost,
   while a group of near copies never yields all its pairs.

Hot lists and classes: minima are combined before the shuffle and joins split skewed
keys.  Classes over ``1 / HOT_SHARE`` of all rows (fewer than ``HOT_SHARE``, so their
digests may be broadcast) enter the lists only through their representative, and list
keys in hot buckets are salted while lists of one are dropped.

Defined cases: a set of fewer than five words is the one whole sequence; no words or
null: an empty set, linked with nothing; rows that repeat an id count as one document,
with the text whose set has the smallest digest; a null id counts as one id, smaller
than all others, given back as null; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release_encoders, small_batches, text_rows, written
from .components import connected_components

WORDS = 5
PERCENT = 80
BUCKETS = 1 << 21
SLICES = 64
FRAGMENTS = 4
HOT_SHARE = 4096
CODE_BITS = 6
HASH_BITS = 63 - CODE_BITS
NO_ID = -(1 << 62)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                   0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A"):ord("Z") + 1] += 32
    white = np.zeros(256, bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    return lower, white


LOWER, WHITE = _byte_tables()
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(1024, 1 << int(n).bit_length())
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE, np.uint64)]), dtype=np.uint64)
    return _powers


def shingle_hashes(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of every text's shingles."""
    raws = [t.encode() for t in texts]
    data = LOWER[np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raws])
    inside = ~WHITE[data]
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    last = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    if not len(first):
        return [np.empty(0, np.uint64) for _ in texts]
    lengths = last - first
    at = np.flatnonzero(inside)
    offset = at - np.repeat(first, lengths)
    powers = _power_table(int(lengths.max()) + 1)
    words = _mix(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * powers[offset],
                                 np.cumsum(lengths) - lengths))
    n = len(words)
    grams = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        grams += words[k:n - WORDS + 1 + k] * _PLACE[k] if n >= WORDS else grams
    grams = _mix(grams)
    bounds = np.searchsorted(first, np.concatenate([[0], ends]), "left")
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= WORDS:
            own = np.sort(grams[lo:hi - WORDS + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif hi > lo:
            whole = (words[lo:hi] * _PLACE[:hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(_mix(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def ordered_keys(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions in the global order: frequency code, then hash bits; sorted."""
    code = codes[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((code << np.uint64(HASH_BITS)) | (hashes >> np.uint64(64 - HASH_BITS))).astype(np.int64)


def needed_share(n: int) -> int:
    """ceil(t * n): the least overlap of a set of n in any link."""
    return -(-PERCENT * n // 100)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and digest of every set; the task's bucket counts at its end."""
    release_encoders()
    counts = np.zeros(BUCKETS, np.uint32)
    for batch in small_batches(batches, "text"):
        sets = shingle_hashes(batch.column("text").to_pylist())
        for h in sets:
            np.add.at(counts, (h & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([len(h) for h in sets], pa.int32()),
            pa.array([digest(h) for h in sets], pa.binary()),
            pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=PROFILE)
    if counts.any():
        parts = counts.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int32()), pa.nulls(SLICES, pa.binary()),
            pa.array(range(SLICES), pa.int32()),
            pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], schema=PROFILE)


PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()),
                     ("slice", pa.int32()), ("counts", pa.binary())])


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streaming sums: holds one array per slice, whatever the number of tasks counted."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(raw), np.uint32)
            sums[k] = sums[k] + part if k in sums else part.astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()),
                                          "counts": [v.astype(np.float32).tobytes() for v in sums.values()]})


def frequency_codes(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Code of every bucket (a table of fixed size) and the fragments' cuts in the global order."""
    rows = (profile.filter("slice is not null").select("slice", "counts").repartition(SLICES, "slice")
            .mapInArrow(_sum_slices, "slice int, counts binary").collect())
    # slice by slice: the driver holds the counts as 32-bit numbers and one slice's work
    counts = np.zeros((SLICES, BUCKETS // SLICES), np.float32)
    while rows:
        row = rows.pop()
        counts[row["slice"]] += np.frombuffer(row["counts"], np.float32)
    mean = max(1.0, float(counts.sum(dtype=np.float64)) / BUCKETS)
    codes = np.zeros(counts.shape, np.uint8)
    mass = np.zeros(1 << CODE_BITS)
    for own, part in zip(codes, counts, strict=True):
        own[:] = np.minimum((1 << CODE_BITS) - 1, 4 * np.log2(1 + part / mean))
        mass += np.bincount(own, part, 1 << CODE_BITS)
    codes = codes.ravel()
    total, below = np.cumsum(mass), np.cumsum(mass) - mass
    cuts = []
    for k in range(1, FRAGMENTS):
        goal = total[-1] * k / FRAGMENTS
        code = int(np.searchsorted(total, goal))
        share = (goal - below[code]) / mass[code] if code < len(mass) and mass[code] else 0.0
        cuts.append((code << HASH_BITS) + int(share * (1 << HASH_BITS)))
    return codes, np.array(cuts, np.int64)


def _may_reach(n_a, pos_a, n_b, pos_b):
    """SQL: sizes and positions of a shared n-gram leave room for the threshold."""
    most = F.lit(1) + F.least(n_a - pos_a - 1, n_b - pos_b - 1)
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT) & \
        (most * (100 + PERCENT) >= (n_a + n_b) * PERCENT)


def verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Links (u, v) among ``pairs`` (a, b, n_a, n_b): the overlap of one fragment at a time is
    counted and added per pair.

    A pair leaves as soon as its sum and all that remains of either set cannot reach the
    threshold; as the fragments go from rare to frequent, most pairs leave early, and
    only one fragment of the sets is moved at a time.
    """
    total = F.lit(100 + PERCENT)
    alive = pairs.select("a", "b", "n_a", "n_b", F.col("n_a").alias("rest_a"), F.col("n_b").alias("rest_b"),
                         F.lit(0).alias("overlap"))
    for fragment in range(FRAGMENTS):
        part = segments.filter(F.col("fragment") == fragment)
        left = part.select(F.col("doc").alias("a"), F.col("grams").alias("grams_a"))
        right = part.select(F.col("doc").alias("b"), F.col("grams").alias("grams_b"))
        size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
        alive = (alive.join(left, "a", "left").join(right, "b", "left")
                 .select("a", "b", "n_a", "n_b", (F.col("rest_a") - size("grams_a")).alias("rest_a"),
                         (F.col("rest_b") - size("grams_b")).alias("rest_b"),
                         (F.col("overlap") + size(F.array_intersect("grams_a", "grams_b"))).alias("overlap"))
                 .filter((F.col("overlap") + F.least("rest_a", "rest_b")) * total >= (F.col("n_a") + F.col("n_b")) * PERCENT)
                 .distinct())
        alive = written(alive, "gram-overlaps")
    return alive.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct candidate pairs of rows holding (doc, n, pos) and (other, n_other, pos_other)."""
    first = F.col("doc") < F.col("other")
    return (rows.filter((F.col("doc") != F.col("other")) & _may_reach(
                F.col("n"), F.col("pos"), F.col("n_other"), F.col("pos_other")))
            .select(F.when(first, F.col("doc")).otherwise(F.col("other")).alias("a"),
                    F.when(first, F.col("other")).otherwise(F.col("doc")).alias("b"),
                    F.when(first, F.col("n")).otherwise(F.col("n_other")).alias("n_a"),
                    F.when(first, F.col("n_other")).otherwise(F.col("n")).alias("n_b")).distinct())


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sc = df.sparkSession.sparkContext
    rows = text_rows(df, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    profile = written(rows.mapInArrow(_profile, "doc_id long, n int, digest binary, slice int, counts binary"),
                          "gram-profile")
    codes, cuts = frequency_codes(profile)
    chosen = (profile.filter("slice is null").groupBy("doc_id")
              .agg(F.min(F.struct("digest", "n")).alias("s"), F.count(F.lit(1)).alias("rows"))
              .select("doc_id", "rows", "s.digest", "s.n"))
    classes = chosen.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    known = written(chosen.join(classes, "digest"), "gram-classes")
    total = known.count()
    hot = {bytes(r["digest"]): r["rep"] for r in known.filter(
        (F.col("size") * HOT_SHARE > total) & (F.col("doc_id") == F.col("rep")) & (F.col("n") > 0))
        .select("digest", "rep").collect()}  # fewer than HOT_SHARE digests
    shared = sc.broadcast((codes, cuts, hot))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, _, hot = shared.value
        for batch in small_batches(batches, "text"):
            keys, docs, sizes, places = [], [], [], []
            for doc, h in zip(batch.column("doc_id").to_pylist(),
                              shingle_hashes(batch.column("text").to_pylist()), strict=True):
                if not len(h) or hot and hot.get(digest(h), doc) != doc:
                    continue
                prefix = ordered_keys(h, codes)[:len(h) - needed_share(len(h)) + 1]
                keys.append(prefix)
                docs.append(doc)
                sizes.append(len(h))
                places.append(len(prefix))
            if keys:
                yield pa.RecordBatch.from_pydict({
                    "gram": pa.array(np.concatenate(keys)), "doc_id": pa.array(np.repeat(docs, places), pa.int64()),
                    "n": pa.array(np.repeat(sizes, places), pa.int32()),
                    "pos": pa.array(np.concatenate([np.arange(p) for p in places]), pa.int32())})

    found = rows.mapInArrow(entries, "gram long, doc_id long, n int, pos int")
    # codes of buckets that hold far more than their share may belong to hot n-grams
    hot_code = F.shiftright("gram", HASH_BITS) >= 24
    salt = F.when(hot_code, F.pmod(F.xxhash64("doc_id"), F.lit(64))).otherwise(F.lit(0))
    alike = Window.partitionBy("gram", "salt")
    lists = (found.withColumn("salt", salt).withColumn("many", F.count(F.lit(1)).over(alike))
             .filter((F.col("many") > 1) | hot_code)
             .join(known.select("doc_id", "rep"), "doc_id")
             .select("gram", F.col("rep").alias("doc"), "n", "pos").distinct())
    lists = written(lists, "gram-lists")
    centres = (lists.groupBy("gram").agg(F.min(F.struct("pos", "doc", "n")).alias("c"), F.count(F.lit(1)).alias("many"))
               .filter("many > 1")
               .select("gram", F.col("c.doc").alias("other"), F.col("c.n").alias("n_other"),
                       F.col("c.pos").alias("pos_other")))
    starred = written(lists.join(centres, "gram"), "gram-stars")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, cuts, _ = shared.value
        for batch in small_batches(batches, "text", most_bytes=1 << 20):
            docs, parts, grams = [], [], []
            for doc, want, h in zip(batch.column("doc").to_pylist(), batch.column("digest").to_pylist(),
                                    shingle_hashes(batch.column("text").to_pylist()), strict=True):
                if digest(h) != want:
                    continue
                keys = ordered_keys(h, codes)
                for k, part in enumerate(np.split(keys, np.searchsorted(keys, cuts))):
                    if len(part):
                        docs.append(doc)
                        parts.append(k)
                        grams.append(part)
            if docs:
                yield pa.RecordBatch.from_pydict({
                    "doc": pa.array(docs, pa.int64()), "fragment": pa.array(parts, pa.int32()),
                    "grams": pa.array(grams, pa.list_(pa.int64()))})

    def fragments_of(wanted: DataFrame) -> DataFrame:
        """Fragments of the sets of ``wanted`` (doc), from their whole texts."""
        named = wanted.join(known.select(F.col("doc_id").alias("doc"), "digest"), "doc")
        texts = rows.select(F.col("doc_id").alias("doc"), "text").join(named, "doc")
        return written(texts.mapInArrow(cut, "doc long, fragment int, grams array<long>"), "gram-segments")

    pairs = written(_pairs(starred), "gram-pairs")
    held = _members(pairs)
    segments = fragments_of(held)
    near = connected_components(verified(pairs, segments))
    near = written(near, "near-labels")
    # pairs of a list across components; a list in one component needs no more
    labelled = (starred.join(near.withColumnRenamed("node", "doc"), "doc", "left")
                .withColumn("label", F.coalesce("label", "doc")))
    mixed = labelled.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    open_lists = written(labelled.select("gram", "doc", "n", "pos", "label", "other").join(
        mixed.select("gram"), "gram", "left_semi"), "gram-open")
    centre_label = (open_lists.filter("doc = other").select("gram", F.col("label").alias("centre_label")))
    outside = open_lists.join(centre_label, "gram").filter("label <> centre_label").drop("other", "centre_label")
    members = open_lists.select("gram", F.col("doc").alias("other"), F.col("n").alias("n_other"),
                                F.col("pos").alias("pos_other"), F.col("label").alias("label_other"))
    crossing = outside.join(members, (outside["gram"] == members["gram"]) & (F.col("label") != F.col("label_other"))
                            & _may_reach(F.col("n"), F.col("pos"), F.col("n_other"), F.col("pos_other")))
    pairs = written(_pairs(crossing), "gram-pairs")
    more = fragments_of(_members(pairs).join(held, "doc", "left_anti"))
    links = verified(pairs, segments.unionByName(more))

    def to_label(edges: DataFrame, end: str) -> DataFrame:
        return (edges.join(near.select(F.col("node").alias(end), "label"), end, "left")
                .withColumn(end, F.coalesce("label", end)).drop("label"))

    merged = connected_components(to_label(to_label(links, "u"), "v"))
    final = (known.select("doc_id", "rep", "n", "rows")
             .join(near.select(F.col("node").alias("rep"), "label"), "rep", "left")
             .withColumn("label", F.coalesce("label", "rep"))
             .join(merged.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
             .withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id"))
                         .otherwise(F.coalesce("top", "label"))))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (final.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
            .select(real("doc_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                    real("component_id").alias("component_id")))
