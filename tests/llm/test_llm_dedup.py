import random
from collections import Counter

import numpy as np
import pytest

from cliptide.llm import lpf, packed, windows


def brute_cut(rows):
    """(n_bytes, n_removed, spans, kept) of each row, comparing every string of 50 bytes with all earlier documents."""
    first = {}
    for d, raw in rows:
        if d is not None:
            for j in range(len(raw) - 49):
                s = raw[j : j + 50]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, raw in rows:
        mark = bytearray(len(raw))
        if d is not None:
            for j in range(len(raw) - 49):
                if first[raw[j : j + 50]] < d:
                    mark[j : j + 50] = b"\1" * 50
        spans = [k for k in range(len(raw)) if mark[k] and (not k or not mark[k - 1])]
        out.append((d, len(raw), sum(mark), len(spans), bytes(b for b, m in zip(raw, mark) if not m)))
    return out


def made_up():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (9, 10, 11, 12, 13, 20, 60, 300)]
    rows = []
    for d in range(120):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts += [s[a : a + rng.randint(30, len(s))], text(rng.randint(0, 8))]
        rows.append((d * 7 % 120, rng.choice(["", " "]).join(parts)))
    rows += rows[:9]
    rows += [(200 + d, "ab" * rng.randint(20, 60)) for d in range(8)] + [(300, "a" * 49), (301, "a" * 50), (302, "a" * 51), (303, "a" * 400)]
    return rows


@pytest.mark.parametrize("table", ["odd", "sf_docs", "made_up"])
def test_against_every_string(request, spark, table):
    docs = spark.createDataFrame(made_up(), "doc_id long, text string").repartition(5) if table == "made_up" else request.getfixturevalue(table)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    got = lpf.dedup(docs).collect()
    assert Counter(str((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))) for r in got) == Counter(map(str, brute_cut(rows)))


def test_empty(empty):
    assert lpf.dedup(empty).count() == 0
    assert windows.passages(empty).count() == 0 and windows.without_passages(empty).count() == 0


def test_earlier():
    rng = np.random.default_rng(2)
    key, doc = rng.integers(0, 40, 500).astype(np.uint64), rng.integers(0, 30, 500)
    want = [any(key[j] == key[i] and doc[j] < doc[i] for j in range(500)) for i in range(500)]
    assert packed.earlier(key, doc).tolist() == want


def test_compact_windows_cover_each_sequence_once():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 9, 60).astype(np.uint64)
    row = np.repeat([0, 1, 2], [25, 5, 30])
    starts = np.array([0, 25, 30, 60])
    of, lo, c, hi = windows.compact_windows(s, row, starts, 0, least=6)
    h = windows.mix(s, 1) | np.uint64(1)
    for r in range(3):
        n = starts[r + 1] - starts[r]
        for i in range(n):
            for j in range(i + 5, n):
                hit = [k for k in range(len(of)) if of[k] == r and lo[k] <= i <= c[k] <= j <= hi[k]]
                assert len(hit) == 1
                own = h[starts[r] + i : starts[r] + j + 1]
                assert own.min() == h[starts[r] + c[hit[0]]]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(7)
    text = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 4000)}" for _ in range(n)]
    passage = text(120)
    edited = list(passage)
    for k in (30, 60, 90):
        edited[k] = "changed"
    half = [w if i % 4 else "other" for i, w in enumerate(passage)]
    rows = [
        (1, text(80) + passage + text(60)), (2, text(70)), (3, text(40) + passage + text(90)), (4, text(30) + edited + text(50)),
        (5, text(40) + half + text(10)), (6, passage[:40] + text(100)), (7, passage), (8, text(300)), (7, passage),
    ]
    return rows, spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3)


def test_passages(planted):
    rows, docs = planted
    got = {(r.doc_id, r.source_id): r for r in windows.passages(docs).collect()}
    assert {d for d, _ in got} == {3, 4, 7} and all(s == 1 for _, s in got)
    for r in got.values():
        begin = {3: 40, 4: 30, 7: 0}[r.doc_id]
        assert abs(r.word_start - begin) <= 2 and abs(r.word_end - begin - 120) <= 2
        assert r.similarity == 1.0 if r.doc_id != 4 else 0.8 <= r.similarity < 1


def test_passages_are_cut_and_the_first_stays(planted):
    rows, docs = planted
    left = {r.doc_id: r.text.split() for r in windows.without_passages(docs).collect()}
    assert set(left) == {1, 2, 3, 4, 5, 6, 8}
    for d, w in rows:
        if d in (1, 2, 5, 6, 8):
            assert left[d] == w
    assert len(left[3]) == 130 and abs(len(left[4]) - 80) <= 4


def test_odd_rows(odd):
    got = windows.passages(odd).collect()
    assert {r.doc_id for r in got} == {7} and got[0].source_id == 6
    kept = windows.without_passages(odd, length_col="none")
    assert kept.columns == odd.columns and kept.count() == 11


def test_best_runs():
    a = lambda *x: np.array(x)
    assert windows.best_runs(a(0, 45), a(40, 80)) == [(0, 80)]
    assert windows.best_runs(a(0, 100), a(40, 140)) == [(0, 40), (100, 140)]
    assert windows.best_runs(a(), a()) == []
    assert windows.best_runs(a(0, 12, 100), a(2, 60, 101)) == [(0, 2), (12, 60), (100, 101)]
