"""Periodic runs against a plain search of all stretches, and the planted query against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptide.llm import periodic


def plain_runs(words, least=6, times=4):
    """All maximal stretches of smallest period q, by growing every stretch of every period word by word."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            stretch = words[i : i + length]
            smallest = not any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(least, times * q) and smallest:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def random_texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        letters = rng.choice((1, 2, 3, 30))
        t = [rng.randrange(letters) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            cycle = [rng.randrange(letters + 2) for _ in range(rng.randrange(1, 14))]
            at = rng.randrange(len(t) + 1)
            t[at:at] = (cycle * 9)[: rng.randrange(1, 9 * len(cycle))]
        yield np.array(t, np.int64)


@pytest.mark.parametrize("seed", range(6))
def test_runs_match_plain_search(seed):
    texts = list(random_texts(seed, 120))
    got = periodic.runs(texts, 40)
    for t, r in zip(texts, got):
        assert [tuple(x) for x in r.tolist()] == plain_runs(t.tolist())


def test_equal_words_of_neighbouring_texts_are_no_run():
    # Long common stretches at one distance in different texts, with the last text at the end of the array.
    rng = np.random.default_rng(5)
    for size in (40, 41, 55):
        shared = rng.integers(0, 1000, size)
        texts = [np.concatenate((shared, rng.integers(0, 1000, k))) for k in (9, 5, 0)] + [shared[-12:], np.zeros(12, np.int64)]
        for t, r in zip(texts, periodic.runs(texts, 1000)):
            assert [tuple(x) for x in r.tolist()] == plain_runs(t.tolist())


def test_two_periods_and_shorter_runs():
    texts = list(random_texts(99, 80))
    for least, times in ((2, 2), (5, 3)):
        for t, r in zip(texts, periodic.runs(texts, 40, least, times)):
            assert [tuple(x) for x in r.tolist()] == plain_runs(t.tolist(), least, times)


def test_extensions_match_counting():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 50):
        w = np.concatenate((rng.integers(0, letters, 400), [letters]))
        i = rng.integers(0, 399, 300)
        j = i + 1 + rng.integers(0, 400 - i)
        want = [next(k for k in range(500) if w[a + k] != w[b + k]) for a, b in zip(i, j)]
        assert periodic.Extensions(w)(i, j).tolist() == want


def test_every_pair_of_residues_meets_the_cover():
    d = periodic.MODULUS
    assert {(a - b) % d for a in periodic.COVER for b in periodic.COVER} == set(range(d))


def test_query_matches_plain_python(spark, sf_docs):
    # Ids whose texts become periodic, and as many others; texts short enough for the plain search.
    rows = [tuple(r) for r in sf_docs.select("doc_id", F.substring("text", 1, 900)).collect()]
    rows += [(k, t) for k, (_, t) in zip(range(10_000, 10_400), rows * 3)]
    rows += [(20_001, "a " * 40), (20_002, "a b c " * 5 + "\x1c  a b"), (20_003, "x y " * 9), (None, "w " * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r) for r in periodic.digest(periodic.collapse(periodic.with_repeats(docs))).collect()}
    assert got == {r[0]: plain_digest(*r) for r in rows}
    assert sum(r[1] > 0 for r in got.values()) > 40


def test_odd_rows(odd, empty):
    out = periodic.digest(periodic.collapse(periodic.with_repeats(odd)))
    got = out.collect()
    assert len(got) == odd.count()
    nothing = hashlib.sha256(b"").hexdigest()
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (0, None, None, None, None, nothing, nothing)
    assert periodic.digest(periodic.collapse(periodic.with_repeats(empty))).collect() == []


def test_long_text_in_pieces(spark, monkeypatch):
    text = " ".join(["lead"] + ["x y z"] * 50_000 + [f"w{k}" for k in range(50_000)])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = periodic.collapse(docs).first()
    assert [tuple(r) for r in row.runs] == [(1, 150_000, 3)]
    assert row.kept.split()[:5] == ["lead", "x", "y", "z", "w0"]
    monkeypatch.setattr(periodic, "PIECE", 7)
    cut = list(periodic._pieces(b"ab cd efghijklmnop q\tr"))
    assert len(cut) > 1 and [w for x in cut for w in x.split()] == [b"ab", b"cd", b"efghijklmnop", b"q", b"r"]
