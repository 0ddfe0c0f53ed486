"""Dedup of words and bytes where fingerprints collide, and on crafted and heavily repeated texts, against plain versions."""

import random

import numpy as np
import pytest

from kinfold.llm import corpus, license_scan, minhash_dedup, substring_dedup, suffix_dedup
from kinfold.llm import text as t


def twins(n=1024):
    """Different words of n letters that agree in every polynomial of an odd base modulo 2**64 (Thue and Morse)."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def brute_words(rows, length=13):
    first, words = {}, {}
    for i, x in sorted(rows, key=lambda r: r[0]):
        words[i] = (x or "").encode().split()
        for s in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][s : s + length]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        out[i] = len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return out


def copies(seed=1, n=90):
    """Texts of few words, with passages that run on from one text into another, and copies of copies."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["longer-word-than-eight-bytes"]
    rows = []
    for i in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 120))]
        for _ in range(rnd.randrange(4) if rows else 0):
            other = rnd.choice(rows)[1].split()
            a = rnd.randrange(len(other))
            at = rnd.randrange(len(w) + 1)
            w[at:at] = other[a : a + rnd.randrange(8, 40)]
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("bits", [4, 48])
def test_substring_dedup_where_fingerprints_collide(spark, bits):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.substring_dedup(docs, rule=substring_dedup.Rule(bits=bits, chunk=900)).collect()
    assert {r.doc_id: (r.n_symbols, r.n_removed, bytes(r.kept)) for r in got} == brute_words(rows)


def test_substring_dedup_of_repeated_ids(spark):
    w = " ".join(f"v{i}" for i in range(30))
    rows = [(5, w), (5, w), (5, "a b " + w), (9, w + " c"), (None, w), (None, "d " + w)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 99, r.n_symbols, r.n_removed) for r in got) == [(5, 30, 0), (5, 30, 0), (5, 32, 0), (9, 31, 30), (99, 30, 30), (99, 31, 30)]


def test_crafted_words_are_told_apart(spark):
    a, b = twins()
    rest = " ".join(f"x{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.substring_dedup(docs).collect()] == [0, 0]
    pair = spark.createDataFrame([(1, f"{a} u v w"), (2, f"{b} u v w")], "doc_id long, text string")
    assert all(r.kept for r in minhash_dedup.near_duplicates(pair, words=4).collect())
    assert license_scan.word_hash(a) != license_scan.word_hash(b)


def test_word_values():
    rnd = random.Random(3)
    words = list({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 20))) for _ in range(4000)} | {"\0" * i for i in range(1, 10)})
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    found = t.words(data, np.array([0, len(data)]))
    assert len(found.starts) == len(words) == len(np.unique(t.word_values(data, found)))
    alone = np.frombuffer(words[5].encode(), np.uint8)
    assert t.word_values(alone, t.words(alone, np.array([0, len(alone)])))[0] == t.word_values(data, found)[5]


def test_removed_runs():
    data = np.frombuffer(b"abcdefgh", np.uint8)
    docs = corpus.Docs(np.array([1, 2, 3]), np.zeros(3, bool), np.zeros(3, np.uint64), np.array([0, 3, 3, 8]), data)
    gone = np.array([0, 1, 1, 1, 0, 0, 1, 1], bool)
    got = corpus.removed(docs, gone, docs.offs, False).to_pylist()
    assert [(r["n_removed"], [(s["start"], s["end"]) for s in r["spans"]], r["kept"]) for r in got] == [(2, [(1, 3)], b"a"), (0, [], b""), (3, [(0, 1), (3, 5)], b"ef")]


def brute_bytes(rows, length=100):
    seen, out = set(), {}
    for i, x in sorted(rows, key=lambda r: r[0]):
        b = (x or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        out[i] = len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), bytes(c for c, g in zip(b, gone, strict=True) if not g)
    return out


def lines(seed=2, n=120):
    """Texts with lines of 80 to 130 bytes that many of them have, within all kinds of surroundings, and with repeats of themselves."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(20, 90)))
    common = ["".join(rnd.choice("pqrstu ") for _ in range(k)) for k in (66, 80, 99, 100, 101, 110, 130, 300)]
    rows = []
    for i in range(n):
        parts = [word() for _ in range(rnd.randrange(1, 5))]
        for _ in range(rnd.randrange(4)):
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(common))
        if rows and rnd.random() < 0.3:
            other = rnd.choice(rows)[1]
            a = rnd.randrange(len(other))
            parts.append(other[a : a + rnd.randrange(60, 400)])
        rows.append((i * 2 + 1, "".join(parts)))
    return rows + [(10_001, "ab" * 400), (10_002, "é" * 150), (10_003, "ab" * 60 + "x" * 130), (10_004, None), (10_005, "x" * 99)]


@pytest.mark.parametrize("rule", [suffix_dedup.Rule(), suffix_dedup.Rule(period=3, chunk=50, rows=20), suffix_dedup.Rule(period=1 << 40), suffix_dedup.Rule(40, 8, 16)])
def test_suffix_dedup_of_common_lines(spark, rule):
    rows = lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_bytes(rows, rule.length)
    assert sum(w[1] > 0 for w in want.values()) > 40
    got = suffix_dedup.suffix_dedup(docs, rule=rule).collect()
    assert {r.doc_id: (r.n_symbols, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == want


def test_suffix_order():
    rnd = np.random.default_rng(1)
    rows = rnd.integers(0, 3, (200, 13)).astype(np.uint8)
    order, shared = suffix_dedup._ranked(rows)
    own = [rows[i].tobytes() for i in order]
    assert own == sorted(own)
    assert all(s == next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), 13) for a, b, s in zip(own[:-1], own[1:], shared[1:].tolist(), strict=True))


def test_near_duplicates_of_many_members_of_a_key(spark):
    """Texts around the threshold whose keys have more members than a block."""
    from test_operators import brute_near

    rnd = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(100):
        w = list(base)
        for _ in range(rnd.randrange(2, 7)):
            w[rnd.randrange(80)] = f"x{rnd.randrange(10**6)}"
        rows.append((i + 1, " ".join(w)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, block=8).collect()
    want = brute_near(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want and len({c for _, c, _ in want.values()}) > 5
