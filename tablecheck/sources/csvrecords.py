"""CSV records from files that are split anywhere, quoted line breaks included.

Spark splits a text file between tasks at line breaks, but a line break inside quotes ends no
record, and whether a task's first line lies inside quotes depends on everything before it.
A line is a function on that one bit (:func:`ends_inside`), functions compose, and so do those
of the blocks that tasks read:

1. every task composes its lines to what its block does to either state, and reads the first
   record of each file that it has the beginning of;
2. a scan over the blocks of each file, in order, gives the state each block begins in (the
   driver holds a few numbers a block, that is for every ``spark.sql.files.maxPartitionBytes``
   of input, and every file's header);
3. every task cuts its lines into whole records; of a record that goes on beyond its block the
   parts, at most two a block, are put together by file and place.

Only quotes at the beginning of a field open a quoted value; others are ordinary characters.
Records end with a line feed, with or without a carriage return before it.  Blank records are
dropped.  A file whose last quote is never closed ends with one long record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, OPEN, MIDDLE, CLOSE = range(4)
QUOTE, DELIMITED_QUOTE = b'"', b',"'


def _closed(line: bytes, at: int) -> int:
    """The place after the quote that closes the value open at ``at``, -1 if none does."""
    while True:
        k = line.find(QUOTE, at)
        if k < 0 or line[k + 1:k + 2] != QUOTE:
            return k + 1 if k >= 0 else -1
        at = k + 2


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted value is open after ``line``, given whether one was before it."""
    at = 0
    if not inside:
        if line[:1] == QUOTE:
            at, inside = 1, True
    while True:
        if inside:
            at = _closed(line, at)
            if at < 0:
                return True
        at = line.find(DELIMITED_QUOTE, at)
        if at < 0:
            return False
        at, inside = at + 2, True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file, start: all lines, the hash of their file's path and the place of their block in it."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("start")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array, bool]]:
    """(block, lines, whether the block has just begun) of all stretches of one block in a batch."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            block = int(file[a]), int(start[a])
            yield block, batch.column(0).slice(a, b - a), block != last
            last = block


def _quoted(lines: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Places and texts of the lines with a quote."""
    at = np.flatnonzero(pc.match_substring(lines, QUOTE).to_numpy(zero_copy_only=False))
    return at, lines.take(pa.array(at)).to_pylist()


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's effect on either state; the first record of a file from the block it begins with."""
    block, ends, header, whole = None, [False, True], None, False

    def row() -> pa.RecordBatch:
        first = b"\n".join(header) if header is not None else None
        if header is not None and not whole:
            raise ValueError("a CSV header is longer than a block")
        return pa.RecordBatch.from_pydict({
            "file": [block[0]], "start": [block[1]], "from_outside": [ends[0]], "from_inside": [ends[1]],
            "header": pa.array([first], pa.binary())})

    for here, lines, begins in _runs(batches):
        if begins:
            if block is not None:
                yield row()
            block, ends, whole = here, [False, True], False
            header = [] if here[1] == 0 else None
        if header is not None and not whole:
            inside = bool(header) and ends[0]
            for line in lines.to_pylist():
                if not header and not line.strip():
                    continue
                header.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    whole = True
                    break
        for line in _quoted(lines)[1]:
            ends = [ends_inside(line, e) for e in ends]
    if block is not None:
        if header == []:  # nothing but blank lines
            header = None
        yield row()


class Blocks:
    """What pass one found: the state each block begins in, and each file's header."""

    def __init__(self, table: pa.Table):
        file, start = table.column("file").to_numpy(), table.column("start").to_numpy()
        order = np.lexsort((start, file))
        self.file, self.start = file[order], start[order]
        effects = [table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("from_outside", "from_inside")]
        self.inside = np.zeros(len(order), bool)
        state = False
        for k in range(len(order)):
            if not k or self.file[k] != self.file[k - 1]:
                state = False
            self.inside[k] = state
            state = effects[int(state)][k]
        headed = table.filter(pc.is_valid(table.column("header")))
        self.headers = dict(zip(headed.column("file").to_pylist(), headed.column("header").to_pylist(), strict=True))

    def state(self, block: tuple[int, int]) -> bool:
        a, b = np.searchsorted(self.file, block[0], "left"), np.searchsorted(self.file, block[0], "right")
        k = a + np.searchsorted(self.start[a:b], block[1])
        if k >= b or self.start[k] != block[1]:
            raise ValueError("the files of a CSV source, or how they are split, changed while it was read")
        return bool(self.inside[k])


def scan_blocks(spark: SparkSession, path: str) -> Blocks:
    """Pass one: a row a block, a few numbers each, and the headers."""
    found = _lines(spark, path).mapInArrow(
        _block_ends, "file long, start long, from_outside boolean, from_inside boolean, header binary")
    return Blocks(found.toArrow())


def _cut(blocks: Blocks, layouts: dict[int, int]):
    """Pass two: the records of each block, and the parts of those that lie in several."""
    names = ["record", "file", "start", "kind", "first", "layout"]

    def rows(records: pa.Array, block: tuple[int, int], kind: int, first: bool) -> pa.RecordBatch:
        n = len(records)
        firsts = np.zeros(n, bool)
        firsts[:1] = first
        return pa.RecordBatch.from_arrays(
            [records.cast(pa.binary()), pa.array(np.full(n, block[0])), pa.array(np.full(n, block[1])),
             pa.array(np.full(n, kind, np.int32)), pa.array(firsts),
             pa.array(np.full(n, layouts.get(block[0], 0), np.int32))], names=names)

    def joined(lines: list[pa.Array]) -> pa.Array:
        whole = pa.concat_arrays(lines)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), b"\n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, held, kind, first = None, False, [], WHOLE, False

        def close_block() -> Iterator[pa.RecordBatch]:
            if held:
                yield rows(joined(held), block, OPEN if kind == WHOLE else MIDDLE, first)

        for here, lines, begins in _runs(batches):
            if begins:
                yield from close_block()
                block, inside, held = here, blocks.state(here), []
                kind, first = (CLOSE if inside else WHOLE), here[1] == 0
            before = np.empty(len(lines), bool)
            done = 0
            for at, line in zip(*_quoted(lines), strict=True):
                before[done:at + 1] = inside
                inside, done = ends_inside(line, inside), at + 1
            before[done:] = inside
            starts = np.flatnonzero(~before)
            if not len(starts):
                held.append(lines)
                if not inside:
                    yield rows(joined(held), block, kind, first)
                    held, kind, first = [], WHOLE, False
                continue
            if held or starts[0]:
                yield rows(joined([*held, lines.slice(0, starts[0])]), block, kind, first)
                held, kind, first = [], WHOLE, False
            if inside:
                held, last = [lines.slice(starts[-1])], starts[-1]
                starts = starts[:-1]
            else:
                last = len(lines)
            kind = WHOLE
            if len(starts):
                offsets = pa.array(np.append(starts, last).astype(np.int32))
                texts = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), b"\n")
                # Blank lines before the header are no records.
                blank = 0
                while first and blank < len(texts) and not texts[blank].as_py().strip():
                    blank += 1
                texts = texts.slice(blank)
                if len(texts):
                    yield rows(texts, block, WHOLE, first)
                    first = False
        yield from close_block()

    return cut


def csv_records(spark: SparkSession, path: str, blocks: Blocks, layouts: dict[int, int]) -> DataFrame:
    """record, layout: all records but the files' headers; ``layouts`` numbers the files' headers."""
    cut = _cut(blocks, layouts)
    found = _lines(spark, path).mapInArrow(cut, "record binary, file long, start long, kind int, first boolean, layout int")
    whole = found.filter((F.col("kind") == WHOLE) & ~F.col("first")).select("record", "layout")
    # At most two parts a block; a part that opens a record comes after one that closes the last.
    opens = (F.col("kind") == OPEN).cast("int")
    parts = found.filter(F.col("kind") != WHOLE).withColumn("opens", opens)
    number = F.sum("opens").over(Window.partitionBy("file").orderBy("start", "opens"))
    built = (parts.withColumn("number", number).groupBy("file", "number")
             .agg(F.sort_array(F.collect_list(F.struct("start", "opens", F.col("record").cast("string").alias("record")))).alias("all"),
                  F.max("first").alias("first"), F.max("layout").alias("layout"))
             .filter(~F.col("first"))
             .select(F.array_join(F.transform("all", lambda p: p["record"]), "\n").alias("record"), "layout"))
    records = whole.withColumn("record", F.col("record").cast("string")).unionByName(built)
    bare = F.when(F.col("record").endswith("\r"), F.expr("left(record, char_length(record) - 1)")).otherwise(F.col("record"))
    return records.select(bare.alias("record"), "layout").filter(F.trim("record") != "")
