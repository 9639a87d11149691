"""The pipeline's stages against plain versions of them, each on its predecessor's rows."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from cliptide.llm import bpe, decontaminate, windows
from cliptide.sources import stage
from test_llm_simhash import brute_classes, brute_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, apply in corpus_pipeline.STAGES:
        out.append(stage(apply(spark, out[-1], SF), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns


def test_language_keeps_known_languages(steps):
    assert texts(steps[1]) == texts(steps[0])


def test_one_of_each_class_stays(steps):
    before = texts(steps[1])
    name = brute_classes([(i, brute_print(t)) for i, t in before.items()])
    assert texts(steps[2]) == {i: t for i, t in before.items() if name[i, brute_print(t)] == i}


def test_passages_go(spark, steps):
    before, after = texts(steps[2]), texts(steps[3])
    found = windows.passages(steps[2]).collect()
    cut = {r.doc_id for r in found}
    assert {i for i in before if before[i] != after.get(i)} == cut
    seen = set()
    for i in sorted(before):
        w = before[i].encode().lower().split()
        mine = [r for r in found if r.doc_id == i]
        for r in mine:
            grams = [tuple(w[k : k + 5]) for k in range(r.word_start, r.word_end - 4)]
            assert r.word_end - r.word_start >= 50 and sum(g in seen for g in grams) >= 0.8 * len(grams)
        seen.update(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())


def test_leaks_go(spark, steps):
    plain = lambda t: " ".join(decontaminate.words(t))
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(steps[3]), texts(steps[4])
    assert set(before) - set(after) == {i for i, t in before.items() if any(f" {q} " in f" {plain(t)} " for q in items)}


def test_tokens(spark, steps):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for i, t in texts(steps[4]).items():
        ids = own.encode_ordinary(t)
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(t)))
    assert {tuple(r) for r in steps[5].collect()} == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_odd_and_empty_documents(spark, odd, empty):
    schema = "doc_id", "text", "'en' lang", "source", "length(text) n_chars"
    for docs, left in ((odd.selectExpr(*schema), True), (empty.selectExpr(*schema), False)):
        for name, apply in corpus_pipeline.STAGES[1:]:
            docs = stage(apply(spark, docs, SF), name)
        assert (docs.count() > 0) == left
    assert corpus_pipeline.STAGES[0][1](spark, empty.selectExpr(*schema), SF).count() == 0
