"""Prefix trie, importance resampling and language identification against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecheck.llm import language, resampling
from tablecheck.llm.prefix_trie import (
    SlotTable, accumulate, borrow_openings, conversation_turns, distinct, prefix_trie)
from tablecheck.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn int, role string, text string, x1 string, pos int, shard int"


# --- prefix trie ---------------------------------------------------------------------------

def rebuild(rows):
    """conv_id -> rebuilt turns, straight from the rule."""
    own = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            key = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[conv_id].append((turn is not None, turn, key, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for node, who in members.items():
        below = [p for p in members if p[:len(node)] == node]
        out.append((who[0], len(node), members[node[:-1]][0] if node else None, len(who), children[node],
                    sum(1 for p in below if not children[p]),
                    sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                    hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(df, **sizes):
    return sorted(map(tuple, prefix_trie(*borrow_openings(conversation_turns(df)), **sizes).collect()), key=repr)


@pytest.fixture(scope="module")
def odd_turns(spark):
    rows = [(100, 0, "user", "a"), (100, 1, None, "b"), (100, 2, "user", None), (100, None, "user", "first"),
            (100, 3, "user", "c"), (100, 4, "bot", "d"), (100, 5, "bot", "e" * 5000)]
    rows += [(100 + k, t, "user" if t % 2 else None, f"t{t % 3}") for k in range(1, 40) for t in range(k % 7)]
    rows += [(7, 0, "user", "alone"), (None, 0, "user", "nobody's"), (-3, 0, "user", "x"), (-3, 0, "user", "x"),
             (-3, 0, "bot", "tie"), (205, 1, "user", "short"), (206, 1, "", "日本 😀")]
    rows += [(500, t, "user", f"long {t // 2}") for t in range(60)] + [(501, t, "user", f"long {t // 2}") for t in range(60)]
    return spark.createDataFrame([(*r, "clash", 3, 4) for r in rows], TURNS)


@pytest.mark.parametrize("sizes", [{}, {"segment": 4, "shard_rows": 20}, {"segment": 1, "shard_rows": 7}])
def test_trie_equals_brute_force(odd_turns, sizes):
    rows = [tuple(r)[:4] for r in odd_turns.collect()]
    assert trie_rows(odd_turns.repartition(5), **sizes) == brute_trie(rebuild(rows))


def test_trie_of_a_table_with_hot_conversations(spark):
    """Half of all conversations are the same, and all open alike."""
    df = spark.range(400).select(
        F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("turn"), F.lit("user").alias("role"),
        F.when((F.col("id") % 2 == 0) | (F.col("turn") < 2), F.concat(F.lit("same "), "turn"))
        .otherwise(F.concat("id", F.lit("/"), "turn")).alias("text"))
    rows = [tuple(r) for r in df.collect()]
    assert trie_rows(df, shard_rows=100) == brute_trie(rebuild(rows))


def test_trie_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_prefix_trie"](spark, SF)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rebuild(rows))
    assert "op11_prefix_trie" in ORACLES


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie_rows(empty) == []
    assert trie_rows(spark.createDataFrame([(None, 0, "user", "x", "", 0, 0)], TURNS)) == []


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 30_000):
        digests = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        table = SlotTable(digests)
        assert sorted(table.slots(digests).tolist()) == list(range(n))
        assert (table.kept[table.slots(digests)] == digests).all()
        foreign = rng.integers(0, 1 << 63, (500, 2)).astype(np.uint64)
        assert (table.slots(foreign) == -1).all()
        swapped = digests[:50][:, ::-1]
        assert (table.slots(swapped) == -1).all()
    same = rng.integers(0, 5, (200, 2)).astype(np.uint64)
    assert sorted(map(tuple, distinct(same).tolist())) == sorted(set(map(tuple, same.tolist())))


def test_accumulate_goes_up_level_by_level():
    parents, levels = np.array([-1, 0, 1, 1, -1]), np.array([1, 2, 3, 3, 1])
    values = np.array([1, 10, 100, 1000, 7])
    accumulate(parents, levels, values)
    assert values.tolist() == [1111, 1110, 100, 1000, 7]
    accumulate(np.array([], int), np.array([], int), np.array([], int))


# --- importance resampling -----------------------------------------------------------------

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, max_n=2, buckets=10_000):
    words = WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]


def brute_resample(docs, target, percent=25, min_words=20):
    raw, wanted = collections.Counter(), collections.Counter()
    known = [(i, *brute_features(t)) for i, t in docs]
    for _, _, f in known:
        raw.update(f)
    for t in target:
        wanted.update(brute_features(t)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = {k: math.floor(1000 * math.log((wanted[k] + 1) * (s + 10_000) / ((raw[k] + 1) * (t + 10_000)))) for k in raw}
    out = []
    for i, n_words, f in known:
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


def resampled(docs, target, **options):
    return sorted(map(tuple, resampling.resample(docs, target, **options).collect()), key=repr)


def test_checksums_of_joined_bytes():
    rng = np.random.default_rng(5)
    parts = [rng.bytes(int(n)) for n in [0, 1, 2, 3, 255, 256, 257, 70_000, *rng.integers(0, 40, 60)]]
    crc = np.array([zlib.crc32(p) for p in parts], np.uint32)
    length = np.array([len(p) for p in parts])
    left = np.roll(crc, 1)
    assert resampling.appended(left, crc, length).tolist() == \
        [zlib.crc32(parts[k - 1] + parts[k]) for k in range(len(parts))]


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_batch_features_never_cross_texts(max_n):
    texts = ["One two", "", "three", "a\x00b\x00", "É日本 x", "\x00", "A1 b_c D" * 50]
    text, bucket, words = resampling.batch_features(texts, 10_000, max_n)
    for k, t in enumerate(texts):
        n, f = brute_features(t, max_n)
        assert sorted(bucket[text == k].tolist()) == sorted(f) and words[k] == n
    assert len(resampling.batch_features([])[0]) == 0 and len(resampling.batch_features(["", "."])[0]) == 0


def test_resampling_query_equals_brute_force(spark, docs):
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op12_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == \
        brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], target)


def test_resampling_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    target = odd.select(F.col("text").alias("words"), F.lit(1).alias("text"))
    want = brute_resample(rows, [t for _, t in rows], percent=60, min_words=1)
    got = resampled(odd, target, percent=60, min_words=1, target_text_col="words")
    assert got == want and len(got) == 14
    assert resampled(odd, nothing) == brute_resample(rows, [])
    assert resampled(nothing, odd) == []


# --- language identification ---------------------------------------------------------------

def brute_phrases(text, sample):
    data = re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").lower().encode() + b" ")
    n = i = 0
    while i < len(data):
        k = 1
        while i + k < len(data) and data[i:i + k + 1] in sample:
            k += 1
        i, n = i + k, n + 1
    return n


def test_phrases_are_longest_matches():
    rng = np.random.default_rng(2)
    samples = {k: " ".join("".join(rng.choice(list(letters), rng.integers(1, 6))) for _ in range(80)).encode()
               for k, letters in (("x", "abc"), ("y", "abde"), ("z", "éßab"))}
    model = language.LanguageModel(samples)
    texts = ["", "A", "abc abd éé", "zzz", None, "1 2 3", "日本", "ABBA cab " * 30, "aé b\x00c--d"]
    texts += ["".join(rng.choice(list("abcdeé "), 60)) for _ in range(20)]
    want = [[brute_phrases(t, s) for s in samples.values()] for t in texts]
    assert model.phrases(texts).tolist() == want
    short = model.phrases(texts, lane=16)  # each lane may add one phrase
    data, begins = language.plain(texts)
    assert ((short >= want) & (short <= np.array(want) + (-(-np.diff(begins) // 16))[:, None])).all()


def test_automaton_holds_all_substrings_and_no_more():
    data = b"abcbc abba"
    follow = language.suffix_automaton(data)
    held = set()

    def walk(state, word):
        held.add(word)
        for c, after in follow[state].items():
            walk(after, word + bytes([c]))

    walk(0, b"")
    assert held == {data[i:j] for i in range(len(data) + 1) for j in range(i, len(data) + 1)}
    assert len(follow) <= 2 * len(data)


def test_language_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op13_language"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.99


def test_language_of_odd_rows(odd, nothing, docs):
    model = language.fit_languages(docs)
    assert model.languages == sorted(model.languages)
    rows = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language.predict_languages(odd, model).collect()}
    for blank in (1, 2, 11):
        assert rows[blank, "und"] == 0.0
    assert {k[0] for k in rows if k[1] != "und"} == {3, 4, 5, 6, 7, 8, 9, 10, 12, None}
    assert language.predict_languages(odd, model).count() == 14
    assert language.predict_languages(nothing, model).count() == 0
    none = language.fit_languages(nothing.withColumn("lang", F.lit("en")))
    assert {tuple(r)[1:] for r in language.predict_languages(odd, none).collect()} == {("und", 0.0)}
    few = language.fit_languages(docs, languages=2, rows=3, sample_bytes=300)
    assert len(few.samples) == 2 and max(map(len, few.samples.values())) <= 300


def test_language_fit_never_reads_held_out_rows(docs):
    spoiled = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("wrong")).otherwise(F.col("lang")))
    assert language.fit_languages(spoiled).samples == language.fit_languages(docs).samples
