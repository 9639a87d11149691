from collections import Counter

import pytest

from cliptide.llm import decontaminate as dc

ITEMS = "item_id long, text string"
QUESTION = "Which of the seven rivers named in the second chapter of the report flows through the old market town before it meets the sea"


def brute(docs, items):
    """Best window of each item by trying every window of every document."""
    found = {}
    for d, text in docs:
        w = dc.words(text)
        for i, item in items:
            q = dc.words(item)
            if not q or not w:
                continue
            if len(q) < dc.WORDS or len(w) < dc.WORDS:
                if w == q:
                    found[d, i] = 1.0
                continue
            grams = lambda x: Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
            n, want = min(len(q), len(w)), grams(q)
            like = max(sum((g & want).values()) / sum((g | want).values()) for g in (grams(w[k : k + n]) for k in range(len(w) - n + 1)))
            if like >= dc.SIMILAR:
                found[d, i] = like
    return found


@pytest.fixture(scope="module")
def case(spark):
    w = QUESTION.split()
    edited = [*w[:12], "great", *w[13:]]
    long = " ".join(f"token{i}" for i in range(200))
    docs = [
        (1, f"Before it. {QUESTION}? After it."), (2, "Before it " + " ".join(edited) + " after"), (3, QUESTION.upper().replace(" ", " , ")),
        (4, " ".join(w[:12])), (5, "yes"), (6, "yes and no"), (7, None), (8, ""), (9, long.replace("token100", "other")),
        (10, long.replace("token40", "a").replace("token80", "b").replace("token120", "c").replace("token160", "d").replace("token20 ", "e ")),
        (11, "x " * 5000 + QUESTION), (11, "x " * 5000 + QUESTION), (None, QUESTION),
    ]
    items = [(1, QUESTION), (2, "Yes"), (3, None), (4, ""), (5, long), (6, "x x x x x x x x x x"), (1, QUESTION), (None, "nobody asks this here")]
    return docs, items


def test_against_every_window(spark, case):
    docs, items = case
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()
    want = brute(docs, [i for i in items if i[0] is not None and i[1] is not None])
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert sum(r.doc_id == 11 and r.item_id == 1 for r in got) == 2
    text = dict(docs)
    for r in got:
        assert r.similarity < 1 or dc.words(text[r.doc_id])[r.word_start : r.word_end] == dc.words(dict(items)[r.item_id])


def test_shards_change_nothing(spark, case):
    docs, items = (spark.createDataFrame(x, s) for x, s in zip(case, ("doc_id long, text string", ITEMS)))
    one = sorted(map(str, dc.leaks(docs, items).collect()))
    assert sorted(map(str, dc.leaks(docs, items, shard_bytes=300).collect())) == one


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the river bank.")], ITEMS)
    got = dc.leaks(odd, items).collect()
    assert Counter(r.doc_id for r in got) == {6: 2, 7: 1}
    kept = dc.without_leaks(odd, items)
    assert kept.columns == odd.columns and kept.count() == 9
    assert dc.leaks(empty, items).count() == 0 and dc.leaks(odd, items.limit(0)).count() == 0
    assert dc.without_leaks(odd, items.limit(0)).count() == 12


def test_planted_items(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(dc.words(t))
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in items.collect() if f" {plain(b.text)} " in f" {plain(d.text)} "}
    assert want <= {(r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect()}


def test_windows_far_apart_cost_what_they_cover():
    """Votes of windows at both ends of a long text, against sums of each window; what lies between is not summed."""
    import numpy as np

    s = np.random.default_rng(1).integers(0, 1 << 63, 3_000_000, dtype=np.uint64)
    begin = np.array([0, 3, 40, 1000, 1021, len(s) - 25, len(s) - 20])
    plain = [dc._bits(s[b : b + 20]).sum(axis=0, dtype=np.int64) for b in begin]
    import tracemalloc

    tracemalloc.start()
    votes = dc.Shard._votes(s, begin, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (votes == np.array(plain)).all() and peak < 1_000_000
