"""Hard negatives against plain Python over all pairs, with trees that prune, ties, repeated rows and odd numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptide.llm import negatives

DDL = "vec_id long, embedding array<float>, label int"


def plain(rows, step, n_pos=5, n_neg=3, window=(50, 95)):
    end = (1 << 63) - 1
    live = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            live[i, label, tuple(math.floor(256 * x) for x in v)] = None
    dot = lambda a, b: max(-end, min(end, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, label, a in live:
        if i % step:
            continue
        scored = sorted({(-dot(a, v), j, lb == label) for j, lb, v in live})
        for p, pid in [(-s, j) for s, j, same in scored if same and j != i][:n_pos]:
            # Equal scores of one id count once.
            fit = [(-s, j) for s, j, same in scored if not same and window[0] * p <= -100 * s <= window[1] * p][:n_neg]
            out += [(i, pid, k + 1, j, p, s) for k, (s, j) in enumerate(fit)]
    return sorted(out)


def mined(df, step, **more):
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in cols) for r in negatives.mine(df, F.col("id") % step == 0, **more).collect())


def clustered(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    near = rng.integers(0, 6, n)
    v = (centres[near] + spread * rng.normal(size=(n, dims))).astype(np.float32)
    return [(int(k), [float(x) for x in v[k]], int(rng.integers(0, 4))) for k in range(n)]


@pytest.mark.parametrize("spread", [0.01, 0.3, 2.0])
def test_matches_all_pairs(spark, spread, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 70)
    rows = clustered(600, 8, 3, spread)
    assert mined(spark.createDataFrame(rows, DDL).repartition(3), 9) == plain(rows, 9)


def test_trees_leave_most_candidates_unscored_where_anchors_are_near():
    rows = clustered(3000, 16, 8, 0.003)
    v = np.floor(256 * np.array([r[1] for r in rows]))
    anchors = v[::30]
    order, parents, edges = negatives.spanning_tree(anchors)
    asked = lambda some, low, high: (high >= 6000) & (low <= 6100)
    got, exact = negatives.tree_scores(anchors[order], v, parents, edges, asked)
    want = anchors[order] @ v.T
    assert (got[exact] == want[exact]).all()
    assert exact[(want >= 6000) & (want <= 6100)].all()
    assert exact.mean() < 0.3


def test_spanning_tree_is_least():
    v = np.random.default_rng(2).normal(size=(40, 5)) * 9
    order, parents, edges = negatives.spanning_tree(v)
    assert sorted(order.tolist()) == list(range(40)) and all(p < k for k, p in enumerate(parents))
    nodes = np.vstack((np.zeros(5), v))
    apart = np.sqrt(((nodes[:, None] - nodes[None]) ** 2).sum(-1))
    joined, total = {0}, 0.0  # edge by edge, the shortest that leaves the tree
    while len(joined) < 41:
        length, at = min((apart[a, b], b) for a in joined for b in range(41) if b not in joined)
        joined.add(at)
        total += length
    assert math.isclose(edges.sum(), total, rel_tol=1e-9)


def test_ties_repeated_rows_and_rows_left_out(spark):
    rows = clustered(120, 4, 5, 0.4)
    rows = [(i, [round(x) / 2 for x in v], label) for i, v, label in rows]  # many equal scores
    rows += rows[:40] + [rows[20]] * 3 + [(50, [1.0, 1.0, 0.0, 0.0], 1), (50, [0.5, 1.5, 0.0, 0.0], 1), (60, [2.0], 2), (61, [], 2)]
    rows += [(None, [1.0] * 4, 1), (200, None, 1), (210, [1.0] * 4, None), (220, [1.0, None, 1.0, 1.0], 1), (230, [math.nan] * 4, 1), (240, [math.inf, 0.0, 0.0, 0.0], 0)]
    assert mined(spark.createDataFrame(rows, DDL).repartition(4), 10) == plain(rows, 10)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(11)
    for scale in (1e4, 1e8, 1e30):
        rows = [(k, [float(np.float32(x)) for x in scale * (1 + 0.3 * rng.normal(size=3))], k % 2) for k in range(60)]
        assert mined(spark.createDataFrame(rows, DDL), 6) == plain(rows, 6)


def test_other_columns_and_empty_table(spark):
    rows = clustered(80, 4, 1, 0.3)
    df = spark.createDataFrame(rows, DDL).select("*", *[F.lit("x").alias(c) for c in ("id", "v", "no", "n", "tree", "at", "r", "rank", "ids", "line")])
    assert mined(df, 8, n_positives=2, n_negatives=4, window=(10, 90)) == plain(rows, 8, 2, 4, (10, 90))
    assert mined(df.limit(0), 8) == []


def test_every_pair_of_tree_and_block_once(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    rows = negatives.quantised(spark.createDataFrame(clustered(200, 4, 9, 0.5), DDL).repartition(3))
    packed = negatives._numbered(negatives.blocks(rows, 16))
    grown = negatives.trees(rows.where("id % 5 = 0"), 8)
    met = [tuple(r) for r in negatives._pairs(packed, grown).select("no", "b_no").collect()]
    assert len(met) == len(set(met)) == packed.count() * grown.count()
    assert grown.agg(F.sum("n"), F.max("n")).first()[:] == (40, 8)
