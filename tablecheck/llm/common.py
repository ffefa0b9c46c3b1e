"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The whole text, null counting as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns with fixed names, so that clashing extra columns do no harm."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def written(df: DataFrame, label: str) -> DataFrame:
    """:func:`materialize`, and the shuffle files of the job go as soon as the table is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialize(df, label)
    finally:
        conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20,
                  most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches bounded by rows and by the bytes of ``column``.

    A row longer than the bound forms a slice of its own: rows are never cut.
    """
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (size + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < len(lengths):
            yield batch.slice(start)


def byte_characters() -> list[str]:
    """The printable character that byte-level BPE files write for each byte.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the
    characters from code point 256 on.
    """
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(dict):
    """word -> little-endian ids of prefix + word, encoded on first sight, bounded in entries.

    A word of letters is a single unit of the pre-tokeniser, so the model is asked
    directly; punctuation after letters is a unit of its own.  Any other word goes
    through the whole tokenizer.
    """

    def __init__(self, tokenizer, prefix: str, dtype: str, most: int, id_bytes: list[bytes]):
        super().__init__()
        self.tokenizer, self.prefix, self.dtype, self.most = tokenizer, prefix, dtype, most
        self.model, self.characters, self.id_bytes = tokenizer.model, byte_characters(), id_bytes

    def unit(self, text: str) -> bytes:
        if text.isascii() and text.isprintable():  # of these only the blank is written otherwise
            written = text.replace(" ", self.characters[32])
        else:
            written = "".join([self.characters[b] for b in text.encode()])
        id_bytes = self.id_bytes
        return b"".join([id_bytes[t.id] for t in self.model.tokenize(written)])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if word.isalpha():
            found = self.unit(self.prefix + word)
        elif (letters := word.rstrip(PUNCTUATION)).isalpha():
            found = self[letters] + self.unit(word[len(letters):])
        else:
            ids = self.tokenizer.encode(self.prefix + word, add_special_tokens=False).ids
            found = np.asarray(ids, self.dtype).tobytes()
        self[word] = found
        return found


class ByteBpeEncoder:
    """Exact ids of a byte-level BPE file, each distinct word encoded once per worker.

    The pre-tokeniser never joins text across a single blank or line feed that
    stands between two non-blank characters, so the ids of such a text are those of
    its words (a word after a blank carries the blank), in order.  Texts with any
    other white space, or holding a special token's string, go to the tokenizer
    whole.  ``max_words`` bounds the memory of the word table, not the result.
    """

    def __init__(self, path: str, max_words: int = 600_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if self.vocab_size <= 1 << 16 else "<u4"
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        width = np.dtype(self.dtype).itemsize
        id_bytes = [i.to_bytes(width, "little") for i in range(self.vocab_size)]
        self.first = _Words(self.tokenizer, "", self.dtype, max_words // 4, id_bytes)
        self.later = _Words(self.tokenizer, " ", self.dtype, max_words, id_bytes)
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian bytes of ``self.dtype``."""
        if not text:
            return b""
        lines = [line.split(" ") for line in text.split("\n")]
        n_words = sum(map(len, lines))
        if any("" in words for words in lines) or len(text.split()) != n_words \
                or any(s in text for s in self.specials):
            return self._whole(text)
        later, first = self.later.__getitem__, self.first.__getitem__
        out = [first(lines[0][0]), *map(later, lines[0][1:])]
        for words in lines[1:]:
            out.append(self.newline)
            out.append(first(words[0]))
            out.extend(map(later, words[1:]))
        return b"".join(out)


_encoders: dict[str, ByteBpeEncoder] = {}


def byte_bpe(path: str) -> ByteBpeEncoder:
    """The worker's encoder for ``path`` (kept between tasks)."""
    if path not in _encoders:
        _encoders[path] = ByteBpeEncoder(path)
    return _encoders[path]


def release_encoders() -> None:
    """Give up the worker's encoders and their word tables, for operators that need the memory for other things."""
    _encoders.clear()
