import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from cliptide.llm import simhash
from cliptide.llm.components import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(pairs):
    """{(id, fingerprint): least id reachable} by comparing all pairs."""
    known = sorted({p for p in pairs if p[0] is not None})
    name = {p: p[0] for p in known}
    changed = True
    while changed:
        changed = False
        for a in known:
            for b in known:
                if (a[1] ^ b[1]).bit_count() <= 4 and name[b] < name[a]:
                    name[a], changed = name[b], True
    return name


@pytest.mark.parametrize("table", ["odd", "sf_docs"])
def test_against_all_pairs(request, table):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    name = brute_classes(rows)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{p:016x}") for i, p in rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == name[r.doc_id, int(r.fingerprint, 16)]


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0


def test_keep_first(odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 8, 9, 10] and ids.count(None) == 1


def test_hot_shard_in_pieces(spark, monkeypatch):
    """A chain of fingerprints that agree in most blocks, cut into many pieces, is one class."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 16)
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    near = {base}
    for _ in range(400):
        near.add(base ^ sum({1 << int(b) for b in rng.integers(0, 64, 2)}))
    far = set(rng.integers(1 << 62, size=400).tolist())
    fps = sorted(near) + sorted(far - near)
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    found = {r.node: r.component for r in components(simhash.links(rows)).collect()}
    name = brute_classes(list(enumerate(fps)))
    assert {i: found.get(i, i) for i in range(len(fps))} == {i: name[i, f] for i, f in enumerate(fps)}


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 20, 600).astype(np.uint64) * np.uint64(0x0001000100010001))
    group = np.sort(rng.integers(0, 3, len(fps)))
    forest = simhash.Forest(fps, group)
    got = {(int(q), int(n)) for qs, ns in forest.within(fps, forest.root, 4) for q, n in zip(qs, ns)}
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert got == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}
