"""Texts that share no shingle with an item are told away together; what is left out holds nothing."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from cliptide.llm import decontaminate as dc
from cliptide.llm import text

SF = "/root/testdata/sf0.001"
ITEM = "naïve Straße ΣΊΣΥΦΟΣ İstanbul snake_case x² 日本語 ٣٤ ét 𝒳𝒴 ﬁne Ⅷ last_word"


def plain(shard, texts):
    return {(i, *m) for i, t in enumerate(texts) for m in shard.matches(t, {})}


def looked_up(shard, texts):
    at = shard.suspects(texts).tolist()
    return {(i, *m) for i in at for m in shard.matches(texts[i], {})}


@pytest.fixture(scope="module")
def given():
    docs, items = (pq.read_table(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    return docs["text"].to_pylist(), dc.Shard(list(zip(items["item_id"].to_pylist(), items["text"].to_pylist())))


def test_only_texts_with_a_shingle_of_an_item_are_looked_into(given):
    texts, shard = given
    grams = lambda t: {tuple(w[k : k + 5]) for w in [dc.words(t)] for k in range(len(w) - 4)}
    of_items = set().union(*[grams(t) for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()])
    want = [i for i, t in enumerate(texts) if grams(t) & of_items]
    assert shard.suspects(texts).tolist() == want and len(want) < len(texts) // 2
    assert looked_up(shard, texts) == plain(shard, texts) != set()


@pytest.mark.parametrize("limit", [20, 150, 1_000_000])
def test_odd_letters_and_slices(monkeypatch, limit):
    monkeypatch.setattr(dc, "slices", lambda sizes: text.slices(sizes, limit))
    shard = dc.Shard([(1, ITEM), (2, "Yes"), (3, "no way"), (4, "..."), (5, "one two three four five six")])
    w = ITEM.split()
    texts = [
        "", None, "yes", "YES!", "yes yes", "no-way", "...", ITEM, ITEM.upper(), ITEM.lower(), f"Σ\n{ITEM}\nΣ", "—".join(w), " ".join(w[:6]),
        "one two three four", "five six", "One, two; three\x00four five six", "\n", "one two three four five six seven " * 3, "\U0010ffff",
    ]
    assert looked_up(shard, texts) == plain(shard, texts)
    assert {i for i, *_ in looked_up(shard, texts)} >= {2, 3, 5, 7, 9, 10, 11, 15, 17}


def test_texts_longer_than_a_slice_are_suspects(given, monkeypatch):
    texts, shard = given
    monkeypatch.setattr(dc, "SLICE_CHARS", 500)
    got = set(shard.suspects(texts).tolist())
    assert {i for i, t in enumerate(texts) if len(t) > 500} <= got and looked_up(shard, texts) == plain(shard, texts)


def test_an_empty_benchmark_suspects_nothing(given):
    assert dc.Shard([]).suspects([*given[0], None, "", "yes"]).tolist() == []


def test_near_items_are_those_near_in_a_block_and_within_the_radius(given):
    shard, rng = given[1], np.random.default_rng(2)
    some = [int(p) ^ int(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for p in shard.prints for n in (0, 5, 15, 21, 22, 23, 30)]
    for mark in some:
        blocks = lambda x: [x >> b * 16 & 0xFFFF for b in range(4)]
        near = [any((x ^ y).bit_count() <= 5 for x, y in zip(blocks(mark), blocks(int(p)))) for p in shard.prints]
        want = [k for k, p in enumerate(shard.prints) if near[k] and (mark ^ int(p)).bit_count() <= dc.RADIUS]
        assert shard.near_items(mark).tolist() == want
