"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Encoding takes the distinct words of a slice of texts as flat symbol arrays.  In
every round each word looks up the best (smallest) rank among its neighbouring
pairs by a segmented minimum; all leftmost non-overlapping occurrences of that pair
merge at once, the arrays are compacted, and only pairs beside a merge are looked up
again, until no word has a pair left.  Where a merge could create a better-ranked
pair (or where two pieces share a score) a word merges only its leftmost occurrence
in that round, which is the library's order.  Characters without a piece become byte
pieces.  Words are cut where no piece of the model can reach across: before a run of
blanks and at line feeds; a model with such pieces is handled text by text.

Decoding is a gather of piece bytes over all ids of a slice: control ids are dropped,
blank marks become blanks, the blank put before the text is taken away again.

Defined cases: null and empty texts have no ids but the begin and end ids and decode
to the empty text; a blank mark in a text counts as a blank, as in the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_rows

MARK = "▁"
BLANKS_AND_WORD = re.compile(" +[^ ]*")
NONE = np.int32(2**31 - 1)


class PieceTable:
    """The pieces of a model file as arrays: pair ranks, single characters, bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        special = {i for i in range(self.size)
                   if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
        pieces = {model.id_to_piece(i): i for i in range(self.size) if i not in special}
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(self.size):
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        # characters that only occur inside longer pieces get symbols past the last id
        inner = sorted({c for p in pieces for c in p} - set(pieces))
        symbols = pieces | {c: self.size + k for k, c in enumerate(inner)}
        self.inner = np.array([ord(c) for c in inner], np.int64)
        scores = np.array([model.get_score(i) for i in range(self.size)])
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in pieces.values()}, reverse=True))}
        rank = np.full(self.size + len(inner), NONE, np.int64)
        for i in pieces.values():
            rank[i] = order[scores[i]]
        keys, made = [], []
        width = self.size + len(inner)
        for p, i in pieces.items():
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is not None and right is not None:
                    keys.append(left * width + right)
                    made.append(i)
        at = np.argsort(np.array(keys, np.int64))
        self.width, self.keys, self.made = width, np.array(keys, np.int64)[at], np.array(made, np.int64)[at]
        self.rank = rank
        self.unsafe = np.zeros(width, bool)
        for side in (self.keys // width, self.keys % width):
            self.unsafe[side[rank[self.made] < rank[side]]] = True
        shared = np.bincount(rank[list(pieces.values())], minlength=len(order)) > 1
        ids = np.array(list(pieces.values()))
        self.unsafe[ids[shared[rank[ids]]]] = True
        self.characters = np.full(0x110000, -1, np.int32)
        for c, s in symbols.items():
            if len(c) == 1:
                self.characters[ord(c)] = s
        self.crosses = any(MARK in p.lstrip(MARK) for p in pieces)
        self.newline_alone = not any("\n" in p for p in pieces)
        surface = []
        for i in range(self.size):
            if model.is_control(i):
                surface.append(b"")
            elif model.is_unknown(i):
                surface.append(" ⁇ ".encode())
            elif model.is_byte(i):
                surface.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
            else:
                surface.append(model.id_to_piece(i).replace(MARK, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.leading_blank = np.array([model.id_to_piece(i).startswith(MARK) for i in range(self.size)])
        self.control = np.array([model.is_control(i) for i in range(self.size)])

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair makes, -1 for none."""
        out = np.full(len(left), -1, np.int64)
        ok = np.flatnonzero((left >= 0) & (right >= 0))
        if len(ok) and len(self.keys):
            key = left[ok] * self.width + right[ok]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[ok[hit]] = self.made[at[hit]]
        return out


def merge_words(table: PieceTable, words: Sequence[str]) -> list[np.ndarray]:
    """Ids of every word (blank marks already in place)."""
    if not words:
        return []
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    symbols = table.characters[points].astype(np.int64)
    symbols = np.where(symbols >= 0, symbols, -1 - points)  # no piece holds it: byte pieces later
    owner = np.repeat(np.arange(len(words)), sizes)
    done_owner: list[np.ndarray] = []
    done_symbols: list[np.ndarray] = []

    def made_at(where: np.ndarray) -> np.ndarray:
        """The piece made by symbol ``where`` and the next one of its word."""
        inside = (where + 1 < len(symbols))
        inside[inside] = owner[where[inside]] == owner[where[inside] + 1]
        out = np.full(len(where), -1, np.int64)
        out[inside] = table.pairs(symbols[where[inside]], symbols[where[inside] + 1])
        return out

    made = made_at(np.arange(len(symbols)))
    while len(symbols):
        rank = np.where(made >= 0, table.rank[made], NONE)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.minimum.reduceat(rank, first)
        counts = np.diff(np.r_[first, len(symbols)])
        mine = np.repeat(best, counts)
        over = mine == NONE
        if over.any():
            done_owner.append(owner[over])
            done_symbols.append(symbols[over])
            keep = ~over
            symbols, owner, made, rank, mine = symbols[keep], owner[keep], made[keep], rank[keep], mine[keep]
            if not len(symbols):
                break
        hits = np.flatnonzero(rank == mine)
        # of overlapping hits (neighbouring positions) every second one counts, from the left
        new_run = np.r_[True, hits[1:] != hits[:-1] + 1]
        run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
        hits_kept = (np.arange(len(hits)) - run_at) % 2 == 0
        first_hit = np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]
        hits = hits[first_hit | (hits_kept & ~table.unsafe[made[hits]] & ~np.repeat(
            table.unsafe[made[hits[first_hit]]], np.diff(np.r_[np.flatnonzero(first_hit), len(hits)])))]
        symbols[hits] = made[hits]
        alive = np.ones(len(symbols), bool)
        alive[hits + 1] = False
        moved = np.cumsum(alive) - 1
        symbols, owner, made = symbols[alive], owner[alive], made[alive]
        at = moved[hits]
        again = np.unique(np.r_[at, np.maximum(at - 1, 0)])
        made[again] = made_at(again)
    out_owner, out = np.concatenate(done_owner), np.concatenate(done_symbols)
    order = np.argsort(out_owner, kind="stable")
    out_owner, out = out_owner[order], out[order]
    bounds = np.searchsorted(out_owner, np.arange(len(words) + 1))
    plain = (out >= 0) & (out < table.size)
    odd = np.add.reduceat(~plain, bounds[:-1]) if len(out) else np.zeros(len(words))
    found = []
    for i in range(len(words)):
        ids = out[bounds[i]:bounds[i + 1]]
        if odd[i] and len(ids):
            ids = np.concatenate([[s] if 0 <= s < table.size else table.byte_ids[list(chr(
                table.inner[s - table.size] if s >= 0 else -1 - s).encode())] for s in ids])
        found.append(ids)
    return found


class PieceEncoder:
    """Exact ids of whole texts; the ids of words seen are kept in a table of bounded size."""

    def __init__(self, path: str, max_words: int = 600_000):
        self.table, self.max_words = PieceTable(path), max_words
        self.dtype = "<u2" if self.table.size <= 1 << 16 else "<u4"
        self.words: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Keys whose ids follow each other.

        A word after one blank goes without it, a word after a line feed with it; a key
        that starts with blanks has all of them.
        """
        text = text.replace(MARK, " ")
        if not self.table.crosses:
            keys = (text.replace("\n", " \n") if self.table.newline_alone else text).split(" ")
            if "" not in keys:
                return keys
            # runs of blanks: a word takes all the blanks before it
            return [m.group() for m in BLANKS_AND_WORD.finditer(" " + text)]
        return [" " + text]

    def _marked(self, key: str) -> str:
        if key.startswith(" "):
            return key.replace(" ", MARK)
        return key if key.startswith("\n") and self.table.newline_alone else MARK + key

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids with the begin and end ids."""
        split = [self.split(t) if t else [] for t in texts]
        missing = list({k for keys in split for k in keys if k not in self.words})
        if len(self.words) + len(missing) > self.max_words:
            self.words.clear()
            missing = list({k for keys in split for k in keys})
        for key, ids in zip(missing, merge_words(self.table, [self._marked(k) for k in missing]), strict=True):
            self.words[key] = ids.astype(self.dtype).tobytes()
        begin = np.array([self.table.bos], self.dtype).tobytes()
        end = np.array([self.table.eos], self.dtype).tobytes()
        get = self.words.__getitem__
        return [np.frombuffer(begin + b"".join(map(get, keys)) + end, self.dtype) for keys in split]

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """UTF-8 of the decoded texts."""
        t = self.table
        flat = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        lengths = t.surface_len[flat]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(t.surface_at[flat] - (ends - lengths), lengths)
        data = t.surface[at].tobytes()
        stops = np.cumsum([len(r) for r in rows])
        out = []
        for row, stop in zip(rows, stops, strict=True):
            lo = ends[stop - len(row) - 1] if stop - len(row) else 0
            text = data[lo:ends[stop - 1]] if len(row) else b""
            spoken = row[:2][~t.control[row[:2]]] if len(row) else row
            if len(spoken) and t.leading_blank[spoken[0]]:
                text = text[1:]
            out.append(text)
        return out


_encoders: dict[str, PieceEncoder] = {}


def encode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with begin and end ids), decoded text of every row."""
    return _run(df, model, id_col, text_col, "ids array<int>, decoded string", lambda ids, decoded: (
        pa.array([r.astype(np.int32) for r in ids], pa.list_(pa.int32())),
        pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())))


def piece_digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return _run(df, model, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                lambda ids, decoded: (
                    pa.array([len(r) for r in ids], pa.int64()),
                    pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in ids], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())))


def _run(df: DataFrame, model: str, id_col: str, text_col: str, columns: str, make) -> DataFrame:
    names = ["doc_id", *(c.split(" ")[0] for c in columns.split(", "))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(model) or _encoders.setdefault(model, PieceEncoder(model))
        for batch in small_batches(batches, "text"):
            ids = encoder.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *make(ids, encoder.decode(ids))], names=names)

    return text_rows(df, id_col, text_col).mapInArrow(work, f"doc_id long, {columns}")
