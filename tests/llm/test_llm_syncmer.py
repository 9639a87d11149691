import hashlib

import numpy as np

from cliptide.llm import syncmer


def test_anchors_are_closed_syncmers_whatever_the_context():
    text = "A sentence with enough characters to hold several anchors, and a little more than that."
    row, pos, _ = syncmer.select([text * 2, "", "ab"])
    assert set(pos[row == 0]) and not (row == 1).any() and list(pos[row == 2]) == [0]
    alone = set(syncmer.select(["x" * 70 + text * 2])[1][0:] - 70)
    assert {int(p) for p in pos[row == 0]} <= {int(p) for p in alone}
    one, _, h = syncmer.select([text * 2])
    again = syncmer.select([text * 2, text * 2])
    assert np.array_equal(again[2][again[0] == 1], h)


def test_robustness(odd, sf_docs, empty):
    for docs in (odd, sf_docs):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = []
        for i, (d, t) in enumerate(rows):
            nxt, q = rows[(i + 1) % len(rows)][1], len(t) // 4
            edited = t[: len(t) - q] + nxt[:q]
            a, b, c = (syncmer.sketches([x]) for x in (t, edited, nxt))
            want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), syncmer._hex(a)[0], syncmer._hex(b)[0], float(syncmer.likeness(a, b)[0]), float(syncmer.likeness(a, c)[0])))
        for pieces in (1, 5, 300):
            got = syncmer.robustness(docs, pieces=pieces).collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert syncmer.robustness(empty).count() == 0
    assert syncmer.robustness(odd.limit(1)).count() == 1


def test_edits_stay_near(spark):
    got = syncmer.robustness(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert np.mean([r.near_edited > r.near_next or r.near_next == 1 for r in got]) > 0.99


def test_anchor_table(odd):
    got = syncmer.anchors(odd.where("doc_id in (6, 7)")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.position, r.anchor))
    assert sorted(set(by[6])) == sorted(by[7])
