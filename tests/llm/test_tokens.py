"""Token files, packing, pieces: exact against the libraries, and round trips."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablecheck.llm.common import ByteBpeEncoder, byte_characters
from tablecheck.llm.packing import best_fit, cut, pack_documents, plan_packing, undominated, waste_bound
from tablecheck.llm.pieces import PieceEncoder, encode_pieces, piece_digests
from tablecheck.llm.token_files import TokenFile, TokenFileWriter, bits_for, pack_ids, token_files, unpack_ids

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", " ", "a  b", " a", "a ", "a\n\nb", "a\tb c", "x <|endoftext|> y", "it's 's\n's", "a \n b", "naïve, ½",
       "日本語 テ.", "ab12 c3.", "x)) (y", "a\x1cb \x1c", "don''t", "é é", "\n", "\na", "a b", "▁x ▁"]


def library_ids(text):
    return Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def test_byte_characters_are_distinct():
    assert len(set(byte_characters())) == 256


@pytest.mark.parametrize("most", [2, 600_000])
def test_word_table_equals_library(texts, most):
    encoder, library = ByteBpeEncoder(BPE, max_words=most), Tokenizer.from_file(BPE)
    for text in [*ODD, *list(texts.values())[:40]]:
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == \
            library.encode(text, add_special_tokens=False).ids, text[:40]


def test_units_of_any_byte_equal_library():
    """Printable ASCII is written without a look at its bytes, all else byte by byte; ids come from one table."""
    encoder, library = ByteBpeEncoder(BPE), Tokenizer.from_file(BPE)
    assert encoder.first.id_bytes is encoder.later.id_bytes and len(encoder.later.id_bytes) == encoder.vocab_size
    words = [*map(chr, [*range(33, 300), 0x20AC, 0x1F600]), "plain", "it's", "Größe", "naïve,", "a\x7fb", "x\x00", "~~~", "tail...", "...head"]
    for word in words:
        for text in (word, f"of {word}", f"{word} {word}\n{word}", f"a{word}"):
            assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == \
                library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 15, 16, 17, 32])
def test_packed_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = pack_ids(ids, bits)
    assert len(packed) == (1001 * bits + 7) // 8
    assert (unpack_ids(packed, 1001, bits) == ids).all()
    assert bits_for(1 << bits) == bits


def test_file_has_random_access():
    rng, out = np.random.default_rng(0), io.BytesIO()
    writer = TokenFileWriter(out, 15, block_ids=64)
    parts = [rng.integers(0, 1 << 15, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 500, 0)]
    for i, ids in enumerate(parts):
        writer.add(None if i == 0 else i, ids)
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    file, flat = TokenFile(Source(out.getvalue())), np.concatenate(parts)
    for start, n in ((0, 0), (0, 5), (60, 10), (63, 130), (600, 93), (0, len(flat))):
        assert (file.ids(start, n) == flat[start:start + n]).all()
    back = list(file.documents(most_ids=100))
    assert [b[0] for b in back] == [None, 1, 2, 3, 4, 5, 6]
    assert all((b[2] == p).all() for b, p in zip(back, parts, strict=True))


def test_token_files_against_library(docs, texts):
    got = {r["doc_id"]: r for r in token_files(docs, BPE).collect()}
    start, library = 0, Tokenizer.from_file(BPE)
    for doc_id in sorted(texts):
        ids = library.encode(texts[doc_id], add_special_tokens=False).ids + [0]
        row = got[doc_id]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_odd_rows(odd, nothing):
    rows = token_files(odd, BPE).collect()
    assert len(rows) == 14 and {r["doc_id"] for r in rows} == {None, *range(1, 13)}
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert min(rows, key=lambda r: r["start"])["doc_id"] is None
    assert token_files(nothing, BPE).count() == 0


def test_cut_keeps_full_pieces_behind():
    assert cut(5, 10) == [(0, 5)] and cut(10, 10) == [(0, 10)]
    assert cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and cut(20, 10) == [(0, 10), (10, 10)]


def exhaustive(items, capacity):
    """Fewest sequences, by trying every place of every item."""
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in sorted(set(rooms)):
            if k >= items[i]:
                rest = list(rooms)
                rest.remove(k)
                go(i + 1, [*rest, k - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_plans_are_whole_and_near_optimal():
    rng = random.Random(5)
    worse = 0
    for _ in range(60):
        capacity = rng.randint(6, 20)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(items, minlength=capacity + 1)
        plan = plan_packing(counts, capacity)
        held = np.zeros(capacity + 1, int)
        for filling, many in plan:
            assert sum(x * c for x, c in filling) <= capacity
            for x, c in filling:
                held[x] += c * many
        assert (held == counts).all()
        used, best = sum(m for _, m in plan), exhaustive(items, capacity)
        assert waste_bound(counts, capacity) <= best <= used <= sum(m for _, m in best_fit(counts, capacity))
        worse += used > best
    assert worse <= 2


def test_fillings_are_undominated():
    counts = np.zeros(11, int)
    counts[[2, 3, 4, 6]] = 1
    assert undominated(counts, 6, 9)[0][0] == 0
    assert all(sum(x * c for x, c in f) == 6 - w for w, f in undominated(counts, 6, 9))
    assert undominated(np.zeros(11, int), 4, 9) == [(4, ())]


def filled(plan, size):
    held = np.zeros(size, int)
    for filling, many in plan:
        for x, c in filling:
            held[x] += c * many
    return held


def test_search_beats_best_fit():
    rng, better = random.Random(3), 0
    for _ in range(40):
        counts = np.bincount([rng.randint(15, 60) for _ in range(60)], minlength=101)
        plan, plain = plan_packing(counts, 100), best_fit(counts, 100)
        assert (filled(plan, 101) == counts).all() and (filled(plain, 101) == counts).all()
        used, fit = sum(m for _, m in plan), sum(m for _, m in plain)
        assert waste_bound(counts, 100) <= used <= fit
        better += used < fit
    assert better >= 5


def test_unlimited_search_is_optimal():
    rng = random.Random(8)
    for _ in range(40):
        capacity = rng.randint(6, 20)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(items, minlength=capacity + 1)
        plan = plan_packing(counts, capacity, None, None, None)
        assert sum(m for _, m in plan) == exhaustive(items, capacity)
        assert (filled(plan, capacity + 1) == counts).all()


def test_plan_of_many_lengths_meets_the_bound():
    rng = np.random.default_rng(4)
    counts = np.bincount(np.minimum(1024, rng.lognormal(5.5, 0.9, 4000).astype(int) + 1), minlength=1025)
    assert sum(m for _, m in plan_packing(counts, 1024)) == waste_bound(counts, 1024)


def test_packing_is_gapless_and_carries_all_ids(docs, texts):
    rows = pack_documents(docs, BPE, 1024, 2).collect()
    library, by_sequence, by_doc = Tokenizer.from_file(BPE), {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in pieces] == cut(len(ids), 1024)
        assert all(zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.05 * -(-total // 1024)


def test_packing_odd_rows(odd, nothing):
    rows = pack_documents(odd, BPE, 64, 2).collect()
    assert {r["doc_id"] for r in rows} == {None, *range(1, 13)}
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    assert sum(r["doc_id"] == 12 for r in rows) == 2
    assert pack_documents(nothing, BPE, 64, 2).count() == 0


def test_pieces_equal_library(texts):
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceEncoder(PIECES)
    rng = random.Random(3)
    alphabet = list("aaabbtthein  ▁\n\t.") + list("éß日本①😀ᄀ\x00")
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    sample = [*ODD, *made, "a" * 3000 + "the" * 500, *list(texts.values())[:80]]
    ids = encoder.encode(sample)
    for text, own, decoded in zip(sample, ids, encoder.decode(ids), strict=True):
        assert own.tolist() == library.encode(text, add_bos=True, add_eos=True), text[:40]
        assert decoded.decode() == library.decode(own.tolist()), text[:40]


def test_small_word_table_changes_nothing(texts):
    sample = list(texts.values())[:20]
    small, large = PieceEncoder(PIECES, max_words=5), PieceEncoder(PIECES)
    assert [a.tolist() for t in sample for a in small.encode([t])] == [a.tolist() for a in large.encode(sample)]


def test_piece_digests(odd, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    source = {(r["doc_id"], r["text"] or "") for r in odd.collect()}
    rows = piece_digests(odd, PIECES).collect()
    assert len(rows) == 14
    want = set()
    for doc_id, text in source:
        ids = library.encode(text, add_bos=True, add_eos=True)
        want.add((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in rows} == want
    assert piece_digests(nothing, PIECES).count() == 0
    assert {len(r["ids"]) for r in encode_pieces(odd, PIECES).collect() if r["doc_id"] in (1, 2)} == {2}
