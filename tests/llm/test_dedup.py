"""Exact, near and passage deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tablecheck.llm import exact_dedup, jaccard, suffix_dedup
from tablecheck.llm.components import connected_components


def exact_brute(rows):
    """(doc_id, text) -> sorted verdicts, by grouping normalised texts."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        for k, (doc_id, _) in enumerate(members):
            out.append((doc_id, members[0][0], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [4096, 2, 10**9])
def test_exact_copies_hot_or_not(odd, spark, monkeypatch, share):
    """The verdicts do not depend on which texts count as hot."""
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    copies = spark.createDataFrame([(100 + i, "A hot text" + " " * (i % 7)) for i in range(40)], "doc_id long, text string")
    df = odd.select("doc_id", "text").unionByName(copies)
    got = exact_dedup.exact_copies(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == exact_brute([tuple(r) for r in df.collect()])


def test_exact_copies_leave_whole_rows(odd, nothing):
    left = exact_dedup.drop_exact_copies(odd)
    assert left.columns == odd.columns
    assert {r["doc_id"] for r in left.collect()} == {3, 4, 5, 6, 7, 8, 10, 11, 12, None}
    assert left.filter("doc_id = 12").count() == 1
    assert exact_dedup.exact_copies(nothing).count() == 0 and exact_dedup.drop_exact_copies(nothing).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def near_brute(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    holders, common = defaultdict(list), defaultdict(int)
    for k in sorted(sets):
        for g in sets[k]:
            for other in holders[g]:
                common[other, k] += 1
            holders[g].append(k)
    top = {k: k for k in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), both in common.items():
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_copies(n, words=120, seed=2):
    """A base text and copies with one to five changed words, so that some links only hold by chains."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = {}
    for k in range(n):
        own = list(base)
        for at in rng.choice(words, k % 6, replace=False):
            own[at] = f"v{k}x{at}"
        out[1000 + k] = " ".join(own)
    return out


@pytest.mark.parametrize("share", [4096, 1])
def test_near_components(docs, texts, odd, spark, monkeypatch, share):
    monkeypatch.setattr(jaccard, "HOT_SHARE", share)
    more = near_copies(60) | {2000: "one two three four", 2001: "One TWO three four", 2002: "one two three"}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == near_brute(texts | more)


def test_near_components_odd_rows(odd, nothing):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[11] == (0, 11)
    assert got[4] == (1, 3) and got[6][1] == 5 and got[9][1] == 7
    assert got[None][1] is None
    assert jaccard.jaccard_components(nothing).count() == 0


def test_prefixes_share_the_first_common_gram():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 60, jaccard.BUCKETS).astype(np.uint8)
    for _ in range(50):
        both = rng.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (jaccard.ordered_keys(np.concatenate([both, rng.integers(0, 2**63, 9).astype(np.uint64)]), codes)
                for _ in range(2))
        first = min(set(a.tolist()) & set(b.tolist()))
        for keys in (a, b):
            assert first in keys[:len(keys) - jaccard.needed_share(len(keys)) + 1]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 140)) and 200 not in got


def passages_brute(texts):
    """doc_id -> (bytes, removed, runs, what stays) by a set of all windows."""
    seen, out = set(), {}
    for k in sorted(texts):
        raw = texts[k].encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - suffix_dedup.WINDOW + 1):
            window = raw[i:i + suffix_dedup.WINDOW]
            if window in seen:
                gone[i:i + suffix_dedup.WINDOW] = True
            seen.add(window)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[k] = (len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize(("hot", "bucket"), [(2048, 1 << 20), (1, 3000)])
def test_repeats(spark, texts, monkeypatch, hot, bucket):
    monkeypatch.setattr(suffix_dedup, "HOT_ANCHOR", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    few = dict(sorted(texts.items())[:120]) | {10_000: "ab" * 400, 10_001: "x" * 99, 10_002: "x" * 100, 10_003: "x" * 101,
                                               10_004: "é" * 120, 10_005: "y" + "é" * 120}
    df = spark.createDataFrame(list(few.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
           for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == passages_brute(few)


def test_repeats_odd_rows(odd, nothing):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in rows}
    assert got[1] == got[2] == (0, 0) and got[5][1] == 0 and got[6][1] > 0.9 * got[5][0]
    assert got[9][0] == got[9][1] and got[12][1] == 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_construction_orders_suffixes():
    """Suffix order and common prefixes of a grown collection equal those of sorted suffixes."""
    rng = np.random.default_rng(4)
    strings = [rng.integers(1, 4, n).tolist() for n in (1, 5, 30, 30, 17)]
    grown = suffix_dedup.Construction(len(strings))
    for column in range(1, 31):
        active = np.array([i for i, s in enumerate(strings) if len(s) >= column])
        grown.insert(active, np.array([strings[i][-column] for i in active], np.uint64))
    owners = [(int(i), int(k)) for i, k in zip(*grown.owners(), strict=True) if i >= 0]
    suffixes = [tuple(strings[i][k:]) for i, k in owners]
    assert suffixes == sorted(suffixes) and len(suffixes) == sum(map(len, strings))
    for i, (a, b) in enumerate(zip(suffixes, suffixes[1:], strict=False)):
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert grown.lcp[len(strings) + i + 1] == min(same, suffix_dedup.DEPTH)
    before = [int(x) for x in grown.bwt[len(strings):]]
    assert before == [0 if k == 0 else strings[i][k - 1] for i, k in owners]
