"""Language identification by cross-parsing entropy.

Every language has a suffix automaton of labelled text.  A text is parsed greedily
against it: each phrase is the longest match from where the last one ended (a byte the
language does not know is a phrase of its own).  A phrase costs the logarithm of the
length of that language's text, and the language with the cheapest parse wins: its text
predicts the new one best.  The score is the winner's share when every parse counts as a
code length, ``2 ** -cost`` over the sum of all languages.

Texts are parsed as lower-cased UTF-8 bytes in which every run of ASCII characters other
than letters is one blank.  The automata are one flat transition table, and a batch of
texts is parsed by one numpy step per byte place over all its texts and all languages:
texts are cut into lanes of ``LANE`` bytes, at which a parse starts anew.

The model is fitted on a bounded sample: of the ``LANGUAGES`` most frequent labels at most
``ROWS`` labelled rows each (by hash of the id), an equal share of each row from a place
that the hash chooses, ``SAMPLE_BYTES`` in all.  The driver collects and broadcasts these
samples (at most ``LANGUAGES * SAMPLE_BYTES`` bytes); the workers build the automata, of at
most two states a byte, once each.

Defined cases: a null text and one without any letter (Unicode category L) is ``und`` with
score 0; ties go to the smallest language; without any labelled text all are ``und``; null
labels are never learned; rows that repeat an id are predicted one by one; a null id is
hashed as the empty text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

LANGUAGES = 32
ROWS = 96
SAMPLE_BYTES = 24_000
LANE = 2048
UNKNOWN = "und"


def held_out(doc_id: Column, modulo: int = 4, remainder: int = 2) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulo == remainder


def _kept_bytes() -> np.ndarray:
    """Byte -> itself for small letters and bytes beyond ASCII, else a blank."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_KEPT = _kept_bytes()


def plain(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that are parsed of all ``texts``, one after the other, and where each text begins (and the end).

    Every text is followed by one blank.
    """
    raws = [(t or "").lower().encode() + b" " for t in texts]
    data = _KEPT[np.frombuffer(b"".join(raws), np.uint8)]
    starts = np.cumsum([0, *map(len, raws)])
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[starts[:-1]] = True
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``data``; state 0 is the empty string."""
    follow, link, longest, last = [{}], [-1], [0], 0
    for c in data:
        new = len(follow)
        follow.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return follow


@dataclass
class LanguageModel:
    """Labelled text by language, in order of their names; the tables are built where they are used."""

    samples: dict[str, bytes]
    _table: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"samples": self.samples, "_table": None}

    @property
    def languages(self) -> list[str]:
        return list(self.samples)

    @property
    def phrase_cost(self) -> np.ndarray:
        """Bits of one phrase: where in the language's text it lies."""
        return np.log2([max(len(s), 2) for s in self.samples.values()])

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(byte -> symbol, flat transitions, row of each language's start).

        A transition is the row offset of the next state.  Offset 0 is a state without
        transitions, in which every parse begins: the first symbol always opens a phrase.
        """
        if self._table is None:
            used = np.unique(np.frombuffer(b"".join(self.samples.values()), np.uint8))
            symbol = np.zeros(256, np.int32)
            symbol[used] = np.arange(1, len(used) + 1)
            width, rows, starts = len(used) + 1, [np.zeros((1, len(used) + 1), np.int32)], []
            total = 1
            for sample in self.samples.values():
                follow = suffix_automaton(sample)
                own = np.zeros((len(follow), width), np.int32)
                at = np.repeat(np.arange(len(follow)), [len(f) for f in follow])
                by = symbol[[c for f in follow for c in f]] if len(at) else at
                own[at, by] = (np.array([t for f in follow for t in f.values()], np.int64) + total) * width
                starts.append(total * width)
                total += len(follow)
                rows.append(own)
            self._table = symbol, np.concatenate(rows).ravel(), np.array(starts, np.int64)
        return self._table

    def phrases(self, texts: list[str | None], lane: int = LANE) -> np.ndarray:
        """Phrases of every text (rows) parsed against every language (columns)."""
        symbol, follow, starts = self.table()
        data, begins = plain(texts)
        sizes = np.diff(begins)
        per_text = -(-sizes // lane)
        owner = np.repeat(np.arange(len(texts)), per_text)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        first = begins[owner] + number * lane
        length = np.minimum(begins[owner + 1] - first, lane)
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        symbols = symbol[data]
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        state = np.zeros((len(starts), len(order)), np.int32)
        count = np.zeros((len(starts), len(order)), np.int32)
        for step, n in enumerate(active):
            now = symbols[first[:n] + step]
            after = follow.take(state[:, :n] + now)
            fresh = after == 0
            again = follow.take(starts[:, None] + now)
            state[:, :n] = np.where(fresh, again, after)
            count[:, :n] += fresh
        out = np.zeros((len(texts), len(starts)), np.int64)
        np.add.at(out, owner[order], count.T)
        return out

    def predict(self, texts: list[str | None], lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
        """(place of the winning language, score) of every text."""
        cost = self.phrases(texts, lane) * self.phrase_cost
        best = cost.argmin(axis=1)
        shares = np.exp2(-np.minimum(cost - cost.min(axis=1, keepdims=True), 1000))
        return best, 1 / shares.sum(axis=1)


def fit_languages(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
                  languages: int = LANGUAGES, rows: int = ROWS, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """A model of a bounded sample of the labelled rows; held-out ids are never read."""
    known = (df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
             .filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    totals = (known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), "lang").limit(languages).collect())
    if not totals:
        return LanguageModel({})
    # A row in rows * 3 / n of a language goes on to the exact choice: a few hundred rows each, whatever the input.
    share = F.create_map(*[x for r in totals for x in (F.lit(r["lang"]), F.lit(min(1.0, 3.0 * rows / r["n"])))])
    part_of = {r["lang"]: sample_bytes // min(rows, r["n"]) for r in totals}
    hashed = F.xxhash64(F.lit("sample"), "doc_id", F.length("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            data, begins = plain(batch.column("text").to_pylist())
            pieces = []
            named = zip(begins, begins[1:], batch.column("h").to_pylist(), batch.column("lang").to_pylist(), strict=False)
            for a, b, h, lang in named:
                part = part_of[lang]
                at = a + h % max(b - a - part, 1)
                pieces.append(data[at:min(at + part, b)].tobytes())
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "h": batch.column("h"), "piece": pieces})

    few = (known.withColumn("h", hashed)
           .filter(F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53) < F.element_at(share, F.col("lang"))))
    chosen = (few.mapInArrow(cut, "lang string, h long, piece binary")
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece")))
              .filter(F.col("rank") <= rows).collect())  # at most sample_bytes for each language
    samples: dict[str, bytes] = {}
    for row in sorted(chosen, key=lambda r: (r["lang"], r["rank"])):
        samples[row["lang"]] = samples.get(row["lang"], b"") + bytes(row["piece"])
    return LanguageModel({lang: sample[:sample_bytes] for lang, sample in samples.items()})


def predict_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        names = pa.array([*fitted.languages, UNKNOWN])
        for batch in small_batches(batches, "text"):
            worded = np.asarray(batch.column("worded")).astype(bool) & (len(fitted.samples) > 0)
            best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            if worded.any():
                best[worded], score[worded] = fitted.predict(
                    batch.column("text").filter(pa.array(worded)).to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"),
                                              "lang_pred": names.take(pa.array(best)), "score": pa.array(score)})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                      text.rlike(r"\p{L}").alias("worded"))
            .mapInArrow(predict, "doc_id long, lang_pred string, score double"))
