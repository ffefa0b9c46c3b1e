"""Removal of repeated passages by a suffix structure built column by column.

A byte goes if a ``WINDOW``-byte string covering it also starts earlier.  Only
windows of that length matter, so the collection is cut where equal windows must
meet: every window has an anchor, its least-hashed ``ANCHOR``-byte string (leftmost on
ties), and consecutive windows with the same anchor form a segment of at most
``2 * WINDOW - ANCHOR`` bytes.  Equal windows have equal anchors, so only segments
whose anchor occurs again can hold repeats; they are bucketed by anchor.

In a bucket the segments are the documents of a column-wise construction.  A symbol
is ``LETTER`` bytes, so a segment is ``LETTER`` strings, one per phase.  Each round
inserts one symbol per string, from the last to the first: the new suffix's place
follows from its symbol and the place of its tail (the last-to-first mapping of the
collection's Burrows-Wheeler transform), and the common prefix with either neighbour
is one more than a range minimum of the common prefixes between their tails.  After
all rounds, suffixes whose common prefixes reach a whole window are equal windows;
each learns the earliest start of its class.  A bucket's columns are arrays of
bounded size in memory, passed through in order once per round.

Equal segments are collapsed first: all but the earliest go whole.  A segment that is
then the only one with its anchor can hold no further repeat (equal windows have equal
anchors at equal places, hence lie in different segments) and stays out of the bucket's
construction.

Hot anchors.  Equal segments within a slice of texts are settled there (the later
ones go whole), so copies reach a bucket once per slice.  An anchor with more than
``HOT_ANCHOR`` segments is split further: its windows are classed by the anchor's
place in them, and a class is bucketed by the 93 bytes that its windows share.

Defined cases: null text is empty; texts shorter than a window lose nothing; rows
that repeat an id count as one document, with the least text; a null id counts as
one id, before all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, small_batches, text_rows, written

WINDOW = 100
ANCHOR = 40
LETTER = 5
DEPTH = WINDOW // LETTER
CLASS = 8
HOT_ANCHOR = 2048
BUCKET_BYTES = 1 << 20
NO_ID = -(1 << 62)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]), dtype=np.uint64)
        _tables[base] = have
    return have


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def segments_of(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, size, anchor, anchor hash, content hash) of all segments of texts laid end to end."""
    n = len(data)
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    ends = np.cumsum(sizes)
    # starts of whole windows
    room = np.repeat(ends, sizes) - np.arange(n)
    starts = np.flatnonzero(room >= WINDOW)
    if not len(starts):
        return none
    powers, inverse = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n],
                                                     dtype=np.uint64)])
    grams = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[:n - ANCHOR + 1])
    # least hash, then leftmost: hash bits over the position; grams across texts are never looked at
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, reach = WINDOW - ANCHOR + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    anchors = np.minimum(least[starts], least[starts + span - reach]) & np.uint64(0xFFFFFFFF)
    anchors = anchors.astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)])
    begin = starts[first]
    size = np.diff(np.r_[first, len(starts)]) + WINDOW - 1
    anchor = anchors[first]
    content = _mix((sums[begin + size] - sums[begin]) * inverse[begin]) ^ size.astype(np.uint64)
    return begin, size, anchor, grams[anchor], content


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether bytes from a and from b are the same, compared whole."""
    if not len(size):
        return np.zeros(0, bool)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differ = data[np.repeat(a, size) + at] != data[np.repeat(b, size) + at]
    return np.add.reduceat(differ, np.cumsum(size) - size) == 0


def merged(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of spans, sorted by (doc, start): overlapping or touching ones become one."""
    if not len(doc):
        return doc, start, size
    end = start + size
    # running maximum of ends inside a document
    shift = (np.cumsum(np.r_[0, doc[1:] != doc[:-1]])).astype(np.int64) * (int(end.max()) + 1)
    top = np.maximum.accumulate(end + shift)
    new = np.r_[True, start[1:] + shift[1:] > top[:-1]]
    at = np.flatnonzero(new)
    last = np.r_[at[1:] - 1, len(doc) - 1]
    return doc[at], start[at], top[last] - shift[last] - start[at]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (kind 0) and spans already known to repeat (kind 1) of every slice."""
    for batch in small_batches(batches, "text"):
        ids = np.asarray(batch.column("doc_id"))
        order = np.argsort(ids, kind="stable")
        texts = batch.column("text").to_pylist()
        raws = [texts[i].encode() for i in order]
        ids, sizes = ids[order], np.array([len(r) for r in raws], np.int64)
        data = np.frombuffer(b"".join(raws), np.uint8)
        begin, size, anchor, gram, content = segments_of(data, sizes)
        if not len(begin):
            continue
        doc = np.searchsorted(np.cumsum(sizes), begin, "right")
        base = (np.cumsum(sizes) - sizes)[doc]
        _, first, inverse = np.unique(content, return_index=True, return_inverse=True)
        again = np.flatnonzero(first[inverse] != np.arange(len(begin)))
        known = first[inverse[again]]
        again = again[(size[known] == size[again]) & equal_spans(data, begin[known], begin[again], np.minimum(
            size[known], size[again]))]
        fresh = np.ones(len(begin), bool)
        fresh[again] = False
        gone_doc, gone_start, gone_size = merged(doc[again], (begin - base)[again], size[again])
        spread = _mix((gone_start.astype(np.uint64) << np.uint64(20)) ^ ids[gone_doc].astype(np.uint64))
        yield pa.RecordBatch.from_pydict({
            "anchor": pa.array(np.r_[gram[fresh], spread].view(np.int64)),
            "doc_id": pa.array(np.r_[ids[doc[fresh]], ids[gone_doc]]),
            "start": pa.array(np.r_[(begin - base)[fresh], gone_start]),
            "meta": pa.array(np.r_[size[fresh] << 8 | (anchor - begin)[fresh] << 1, gone_size << 8 | 1])})


class Construction:
    """Burrows-Wheeler transform and common prefixes of a collection, grown by one column per round."""

    def __init__(self, strings: int):
        # one empty suffix per string, all before any symbol
        self.first = np.zeros(strings, np.uint64)  # leading symbol of each suffix, in suffix order
        self.tail = np.arange(strings, dtype=np.int32)  # place of the suffix without it
        self.lcp = np.zeros(strings, np.uint8)  # common symbols with the suffix before, up to DEPTH
        self.newest = np.arange(strings, dtype=np.int32)  # place of each string's longest suffix

    @property
    def bwt(self) -> np.ndarray:
        """The symbol before each suffix, 0 where none is inserted yet.

        Tails are the last-to-first mapping turned round: a suffix's first symbol stands
        before its tail, so growing the tails updates the transform.
        """
        out = np.zeros(len(self.first), np.uint64)
        own = self.first > 0
        out[self.tail[own]] = self.first[own]
        return out

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """(string, symbols before it in the string) of each suffix; -1 for empty ones."""
        string, nth = (np.full(len(self.first), -1, np.int32) for _ in range(2))
        place, of, k = self.newest, np.arange(len(self.newest)), 0
        while len(place):
            live = self.first[place] > 0
            place, of = place[live], of[live]
            string[place], nth[place] = of, k
            place, k = self.tail[place], k + 1
        return string, nth

    def insert(self, strings: np.ndarray, symbols: np.ndarray) -> None:
        """Put one symbol before the newest suffix of each of ``strings``."""
        tails = self.newest[strings]  # places fit 32 bits: a bucket is far smaller
        order = np.lexsort((tails, symbols))
        strings, symbols, tails = strings[order], symbols[order], tails[order]
        n, m = len(self.first), len(strings)
        # suffixes with one leading symbol follow the order of their tails
        new = np.r_[True, self.first[1:] != self.first[:-1]]
        heads = self.first[new]
        run = (np.cumsum(new) - 1) * (n + 1)
        at = np.searchsorted(heads, symbols)
        present = heads[np.minimum(at, len(heads) - 1)] == symbols
        place = np.searchsorted(run + self.tail, at * (n + 1) + np.where(present, tails, -1))
        fresh = place + np.arange(m)
        old = np.ones(n + m, bool)
        old[fresh] = False
        moved = np.flatnonzero(old).astype(np.int32)

        def grown(values: np.ndarray, added) -> np.ndarray:
            out = np.empty(n + m, values.dtype)
            out[moved] = values
            out[fresh] = added
            return out

        first, tail, lcp = grown(self.first, symbols), grown(self.tail, tails), grown(self.lcp, 0)
        beside = np.zeros(n + m + 1, bool)
        beside[fresh] = beside[fresh + 1] = True
        check = np.flatnonzero(beside[1:n + m]) + 1
        lcp[check] = 0
        same = check[(first[check] == first[check - 1]) & (first[check] > 0)]
        lcp[same] = np.minimum(DEPTH, 1 + self._least(tail[same - 1] + 1, tail[same]).astype(np.int64))
        self.first, self.lcp, self.tail = first, lcp, moved[tail]
        self.newest = moved[self.newest]
        self.newest[strings] = fresh

    def _least(self, low: np.ndarray, high: np.ndarray, block: int = 64) -> np.ndarray:
        """Least common prefix over places low to high."""
        if not len(low):
            return np.empty(0, np.uint8)
        blocks = -(-len(self.lcp) // block)
        padded = np.full(blocks * block, 255, np.uint8)
        padded[:len(self.lcp)] = self.lcp
        grid = padded.reshape(blocks, block)
        upto = np.minimum.accumulate(grid, axis=1).ravel()
        fromon = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        levels = [grid.min(axis=1)]
        while 2 << (len(levels) - 1) <= blocks:
            step, last = 1 << (len(levels) - 1), levels[-1]
            levels.append(np.minimum(last[:len(last) - step], last[step:]))
        a, b = low // block, high // block
        out = np.minimum(fromon[low], upto[high])
        between = np.flatnonzero(b - a > 1)
        if len(between):
            lo, width = a[between] + 1, (b - a)[between] - 1
            level = np.frexp(width)[1] - 1
            for k in np.unique(level):
                here = level == k
                values = levels[int(k)]
                out[between[here]] = np.minimum(out[between[here]], np.minimum(
                    values[lo[here]], values[lo[here] + width[here] - (1 << int(k))]))
        inside = np.flatnonzero(a == b)
        for i in range(0, len(inside), 1 << 16):
            rows = inside[i:i + (1 << 16)]
            at = np.arange(block)
            values = grid[a[rows]]
            values = np.where((at >= (low[rows] % block)[:, None]) & (at <= (high[rows] % block)[:, None]), values, 255)
            out[rows] = values.min(axis=1)
        return out


def repeated_windows(contents: list[bytes], earliest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(content, offset) of all windows that also start earlier in another place.

    ``earliest[i]`` is the sortable place of content i's first occurrence; places of
    its windows follow by adding their offsets.
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    offsets = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contents) + bytes(LETTER), np.uint8).astype(np.uint64)
    symbols = np.ones(len(data) - LETTER + 1, np.uint64)
    for k in range(LETTER):
        symbols += data[k:k + len(symbols)] << np.uint64(8 * (LETTER - 1 - k))
    owner = np.repeat(np.arange(len(contents)), LETTER)
    phase = np.tile(np.arange(LETTER), len(contents))
    count = (sizes[owner] - phase) // LETTER
    if not len(contents):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = count >= DEPTH  # shorter strings hold no window
    owner, phase, count = owner[whole], phase[whole], count[whole]
    grown = Construction(len(owner))
    for column in range(1, int(count.max(initial=0)) + 1):
        active = np.flatnonzero(count >= column)
        at = offsets[owner[active]] + phase[active] + LETTER * (count[active] - column)
        grown.insert(active, symbols[at])
    string, nth = grown.owners()
    group = np.cumsum(grown.lcp < DEPTH)
    window = np.flatnonzero((string >= 0) & (nth + DEPTH <= count[string]))
    string, group = string[window], group[window]
    content, offset = owner[string], phase[string] + LETTER * nth[window].astype(np.int64)
    if not len(window):
        return content, offset
    place = earliest[content] + offset
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.r_[heads, len(group)]))
    later = least < place
    return content[later], offset[later]


def _settle(table: pa.Table) -> pa.Table:
    """Spans to remove, from one bucket of segments."""
    doc, start = np.asarray(table.column("doc_id")), np.asarray(table.column("start"))
    raws = table.column("bytes").to_pylist()
    order = np.lexsort((start, doc))
    index: dict[bytes, int] = {}
    heads: list[int] = []
    again: list[int] = []
    for i in order.tolist():
        if raws[i] in index:
            again.append(i)
        else:
            index[raws[i]] = len(heads)
            heads.append(i)
    head = np.array(heads, np.int64)
    names, rank = np.unique(doc, return_inverse=True)
    # contents that share their anchor with another content
    _, shared, many = np.unique(np.asarray(table.column("anchor"))[head], return_inverse=True, return_counts=True)
    head = head[many[shared] > 1]
    place = (rank[head].astype(np.int64) << 34) + start[head]
    content, offset = repeated_windows([raws[i] for i in head.tolist()], place)
    rows = [np.array(again, np.int64), head[content]]
    d = np.concatenate([rank[r] for r in rows])
    s = np.concatenate([start[rows[0]], start[rows[1]] + offset])
    n = np.concatenate([np.array([len(raws[i]) for i in again], np.int64), np.full(len(offset), WINDOW)])
    order = np.lexsort((s, d))
    d, s, n = merged(d[order], s[order], n[order])
    return pa.table({"doc_id": pa.array(names[d]), "start": pa.array(s, pa.int64()), "size": pa.array(n, pa.int64())})


def removed_spans(rows: DataFrame) -> DataFrame:
    """doc_id, start, size (bytes) of spans to remove; they may overlap."""
    spark = rows.sparkSession
    meta = F.col("meta")
    found = rows.mapInArrow(_anchors, "anchor long, doc_id long, start long, meta long")
    seen = written(found.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("anchor")))
                   .filter((F.col("many") > 1) | (meta.bitwiseAND(1) == 1))
                   .select("anchor", "doc_id", "start", "meta", (F.col("many") > HOT_ANCHOR).alias("hot")), "anchors")
    spans = seen.filter(meta.bitwiseAND(1) == 1).select("doc_id", "start", F.shiftright(meta, 8).alias("size"))
    again = seen.filter(meta.bitwiseAND(1) == 0)
    volume = again.agg(F.sum(F.shiftright(meta, 8))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-volume // BUCKET_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out: list[tuple[int, int, int, int, bytes]] = []
            for doc, text, parts in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                                        batch.column("parts").to_pylist(), strict=True):
                raw = text.encode()
                for part in parts:
                    start, size, at = part["start"], part["meta"] >> 8, part["meta"] >> 1 & 127
                    if not part["hot"]:
                        out.append((part["anchor"] % buckets, part["anchor"], doc, start, raw[start:start + size]))
                        continue
                    # windows by the place of the anchor in them, at down to at - windows + 1
                    windows, place = size - WINDOW + 1, start + at
                    for k in range((at - windows + 1) // CLASS, at // CLASS + 1):
                        high, low = min(at, k * CLASS + CLASS - 1), max(at - windows + 1, k * CLASS)
                        core = raw[place - k * CLASS:place - k * CLASS - CLASS + 1 + WINDOW]
                        key = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=bytes([k])).digest(), "little",
                                             signed=True)
                        out.append((key % buckets, key, doc, place - high, raw[place - high:place - low + WINDOW]))
                if len(out) > 20_000:
                    yield _cut_rows(out)
                    out = []
            if out:
                yield _cut_rows(out)

    per_doc = again.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "meta", "hot")).alias("parts"))
    pieces = rows.join(per_doc, "doc_id").mapInArrow(
        cut, "bucket long, anchor long, doc_id long, start long, bytes binary")
    settled = (pieces.repartition(min(buckets, 8 * shuffle_partitions(spark)), "bucket").groupBy("bucket")
               .applyInArrow(_settle, "doc_id long, start long, size long"))
    return spans.unionByName(settled)


def _cut_rows(out: list[tuple]) -> pa.RecordBatch:
    *numbers, raw = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(n, pa.int64()) for n in numbers), pa.array(raw, pa.binary())],
                                      names=["bucket", "anchor", "doc_id", "start", "bytes"])


def _without(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, in how many runs."""
    if not spans:
        return raw, 0, 0
    cover = np.zeros(len(raw) + 1, np.int64)
    for span in spans:
        cover[span["start"]] += 1
        cover[span["start"] + span["size"]] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        raws = [t.encode() for t in batch.column("text").to_pylist()]
        done = [_without(raw, spans) for raw, spans in zip(raws, batch.column("spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("copies"), pa.array([len(r) for r in raws], pa.int64()),
            pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()),
            pa.array([d[0] for d in done], pa.binary())],
            names=["doc_id", "copies", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every row."""
    rows = text_rows(df, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    copies = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    if copies.isEmpty():
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    else:
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    spans = written(removed_spans(rows.select("doc_id", "text")), "repeats")
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    done = rows.join(per_doc, "doc_id", "left").mapInArrow(
        _finish, "doc_id long, copies long, n_bytes long, n_removed long, n_spans long, kept binary")
    return (done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
                    "n_bytes", "n_removed", "n_spans", "kept"))
