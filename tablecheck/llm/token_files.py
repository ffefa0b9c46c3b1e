"""Token ids in bit-packed files: fixed width per id, blocks, random access.

One file holds the ids of a contiguous range of documents in ascending doc_id order:

* header, 32 bytes: ``TIDS`` mark, version, bits per id, ids per block (little endian);
* blocks of ``block_ids`` ids, each id in the fewest bits that hold the vocabulary,
  most significant bit first, every block padded to a whole byte;
* index: byte offset of every block, then per document its id, whether the id is
  null, and its first position in the file (one more position ends the last);
* trailer, 48 bytes: where the index starts, how many blocks, documents and ids.

A block is unpacked by numpy in one step and a span of ids reads only its blocks.
Files are written by tasks through ``pyarrow.fs`` (local, HDFS or object-store
URIs) under a temporary name and moved into place, so a repeated or lost task
leaves either its whole file or none.

Defined cases: null text is empty and still gets its end id; a null doc_id sorts
first; repeated doc_ids stand side by side; an empty table writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import byte_bpe, text_rows

MARK = b"TIDS"
HEADER = struct.Struct("<4sIIIQQ")
TRAILER = struct.Struct("<QQQQQ8s")
BLOCK_IDS = 1 << 15


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, most significant first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits:].ravel()).tobytes()


def unpack_ids(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits:] = flat
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class TokenFileWriter:
    """Streams documents into one file; holds a block and the document index in memory."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = 0
        self.doc_ids: list[int] = []
        self.nulls: list[bool] = []
        self.starts: list[int] = []
        self.offsets: list[int] = []
        self.at = HEADER.size
        out.write(HEADER.pack(MARK, 1, bits, block_ids, 0, 0))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.block_ids:
            self._write(self.n_pending - self.n_pending % self.block_ids)

    def _write(self, n: int) -> None:
        flat = np.concatenate(self.pending)
        for i in range(0, n, self.block_ids):
            packed = pack_ids(flat[i:min(n, i + self.block_ids)], self.bits)
            self.offsets.append(self.at)
            self.out.write(packed)
            self.at += len(packed)
        self.pending, self.n_pending = [flat[n:].copy()], len(flat) - n

    def close(self) -> None:
        if self.n_pending:
            self._write(self.n_pending)
        for values, dtype in ((self.offsets, "<u8"), (self.doc_ids, "<i8"), (self.nulls, "u1"),
                              ([*self.starts, self.n_ids], "<u8")):
            self.out.write(np.asarray(values, dtype).tobytes())
        self.out.write(TRAILER.pack(self.at, len(self.offsets), len(self.doc_ids), self.n_ids, 0, MARK * 2))


class TokenFile:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        mark, _, self.bits, self.block_ids, _, _ = HEADER.unpack(self._read(0, HEADER.size))
        index, blocks, docs, self.n_ids, _, end = TRAILER.unpack(
            self._read(source.size() - TRAILER.size, TRAILER.size))
        if mark != MARK or end != MARK * 2:
            raise ValueError("not a token id file")
        raw = self._read(index, 8 * blocks + 8 * docs + docs + 8 * (docs + 1))
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(index)).astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 8 * blocks)
        self.nulls = np.frombuffer(raw, "u1", docs, 8 * (blocks + docs)).astype(bool)
        self.starts = np.frombuffer(raw, "<u8", docs + 1, 8 * (blocks + docs) + docs).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(n))

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start``; reads only the blocks that hold them."""
        if n <= 0:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        raw = self._read(self.offsets[first], self.offsets[last + 1] - self.offsets[first])
        parts = []
        for b in range(first, last + 1):
            held = min(self.block_ids, self.n_ids - b * self.block_ids)
            at = int(self.offsets[b] - self.offsets[first])
            parts.append(unpack_ids(raw[at:at + (held * self.bits + 7) // 8], held, self.bits))
        flat = np.concatenate(parts)
        return flat[start - first * self.block_ids:][:n]

    def documents(self, most_ids: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in order, read in spans of about ``most_ids`` ids."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + most_ids, "right")) - 1)
            j = min(j, n)
            base = int(self.starts[i])
            flat = self.ids(base, int(self.starts[j]) - base)
            for k in range(i, j):
                lo, hi = int(self.starts[k]) - base, int(self.starts[k + 1]) - base
                yield (None if self.nulls[k] else int(self.doc_ids[k])), int(self.starts[k]), flat[lo:hi]
            i = j


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(df: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Encode and write every row; returns the written list of files.

    file_no orders the files; n_docs and n_tokens are their totals.  Rows are
    range-partitioned by doc_id, so a file is one range and files follow each other.
    """
    system, _ = file_system(folder)
    system.create_dir(file_system(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = byte_bpe(tokenizer)
        part = TaskContext.get().partitionId()
        writer = out = None
        files, base = file_system(folder)
        final, temporary = f"{base}/ids-{part:08d}.bin", f"{base}/.ids-{part:08d}-{uuid.uuid4().hex}"
        end = np.asarray([end_id], encoder.dtype)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                                    strict=True):
                if writer is None:
                    out = files.open_output_stream(temporary)
                    writer = TokenFileWriter(out, bits_for(encoder.vocab_size))
                writer.add(doc_id, np.concatenate([np.frombuffer(encoder.encode(text), encoder.dtype), end]))
        if writer is not None:
            writer.close()
            out.close()
            files.move(temporary, final)
            yield pa.RecordBatch.from_pydict({
                "file_no": pa.array([part], pa.int32()),
                "path": [f"{folder.rstrip('/')}/ids-{part:08d}.bin"],
                "n_docs": pa.array([len(writer.doc_ids)], pa.int64()),
                "n_tokens": pa.array([writer.n_ids], pa.int64())})

    rows = text_rows(df, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(write, "file_no int, path string, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of the written files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it: the file's own position
    plus the totals of the files before it (a running sum over one row per file).
    """
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n_files = files.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, name = file_system(path)
                with system.open_input_file(name) as source:
                    held: list[tuple] = []
                    for doc_id, start, ids in TokenFile(source).documents():
                        held.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(held) >= 10_000:
                            yield _rows(held)
                            held = []
                    if held:
                        yield _rows(held)

    def _rows(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_pydict(
            {k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "start", "n_tokens", "ids_crc32"), columns, strict=True)})

    spread = based.select("path", "base").repartition(max(1, n_files))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Write bit-packed files under the shared scratch folder and read them back."""
    folder = scratch_path(df.sparkSession, "token-ids")
    return read_token_files(write_token_files(df, tokenizer, folder, end_id, id_col, text_col))
