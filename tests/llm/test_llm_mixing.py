"""The mix against plain Python: targets by water filling, one queue of all document passes, and its defined odd cases."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cliptide.llm import mixing


def plain_mix(rows, weights=(5, 2, 1), share=1.5, passes=2):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = defaultdict(list)
    for doc_id, text, source in rows:
        key = hashlib.md5(str(doc_id).encode() if doc_id is not None else (text or "").encode()).hexdigest()
        sources[source].append((key, -1 if doc_id is None else doc_id, size(text)))
    names = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(r[2] for r in sources[s]) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, full = sum(total.values()) * share, set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        level = (budget - sum(passes * total[s] for s in full)) / rest if rest else 0.0
        more = {s for s in names if passes * total[s] < weight[s] * level}
        if more <= full:
            break
        full |= more
    target = {s: min(weight[s] * level, float(passes * total[s])) for s in names}
    stream = []
    for k, s in enumerate(names):
        upto = 0
        for place, (_, doc_id, n) in enumerate(sorted(sources[s])):
            upto += n
            if n and target[s]:
                stream += [((upto + i * total[s]) / target[s], k, upto + i * total[s], n, s, place) for i in range(passes)]
    taken, run = defaultdict(int), 0
    for _, _, _, n, s, place in sorted(stream):
        run += n
        if run > budget:
            break
        taken[s, place] += n
    return sorted((d if d >= 0 else -1, n, total[s], target[s], taken[s, p]) for s in names for p, (_, d, n) in enumerate(sorted(sources[s])))


def digests(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.digest(df).collect())


def test_mix_matches_plain_python(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_CHUNK", 32)
    rows = []
    for k in range(700):
        source = None if k % 11 == 0 else "hot" if k % 3 == 0 else f"s{k % 7}é"
        rows.append((k, None if k % 50 == 0 else "w " * ((k * k) % 37) + ("long " * 900 if k == 99 else ""), source))
    rows += [(None, "no id here", "s1é"), (None, "no id here", "s1é"), (5, rows[5][1], rows[5][2]), (900, "", "empty"), (901, "one", "\U00010000"), (902, "one", "￿")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert digests(mixing.mix(docs)) == plain_mix(rows)
    assert digests(mixing.mix(docs.repartition(2), weights=(1, 3), share=0.4, passes=3)) == plain_mix(rows, (1, 3), 0.4, 3)


def test_taken_words_come_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).groupBy("source", "target", "source_size").agg(F.sum(F.col("size") * F.col("passes")).alias("taken"), F.max("size").alias("longest")).collect()
    assert sum(r.taken for r in rows) <= 1.5 * sum(r.source_size for r in rows)
    for r in rows:
        assert r.target <= 2 * r.source_size and abs(r.taken - r.target) <= r.longest + 0.01 * r.target


def test_stream_holds_each_document_as_often_as_taken(spark, sf_docs):
    taken = mixing.mix(sf_docs)
    stream = mixing.mixed(sf_docs, taken)
    assert stream.columns == [*sf_docs.columns, "finish"]
    want = {r.doc_id: r.passes for r in taken.collect() if r.passes}
    got = [r.doc_id for r in stream.select("doc_id").collect()]
    assert {d: got.count(d) for d in set(got)} == want
    times = [r.finish for r in stream.select("finish").collect()]
    assert times == sorted(times)


def test_odd_rows(spark, odd, empty):
    # The odd table's source is the string x throughout; its ids repeat and one is null.
    got = mixing.digest(mixing.mix(odd)).collect()
    assert len(got) == odd.count()
    total = got[0].source_size
    assert {r.source_size for r in got} == {total} and {r.target for r in got} == {1.5 * total}
    assert all(r["size"] == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    assert mixing.digest(mixing.mix(empty)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.source_size, r.target, r.taken) for r in mixing.digest(mixing.mix(blank)).collect()] == [(0, 0, 0.0, 0)] * 2


def test_plan_is_native(sf_docs):
    plan = mixing.mix(sf_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian"))


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), (" \t\n\x0b\x0c\r", 0), ("a\x1cb c d", 2), ("  x  ", 1)])
def test_word_count(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(mixing.word_count(F.col("t"))).first()[0] == n
