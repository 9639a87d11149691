"""SimHash near-duplicates: BK-trees over shards of the fingerprints.

Two fingerprints at most R bits apart agree on at least BLOCKS - R of BLOCKS blocks of bits. A shard is the set of
fingerprints that agree on one choice of so many blocks, so every pair within the radius meets in some shard. Each
shard has a BK-tree: the children of a node are keyed by their distance to it, and a search follows only the edges
whose key is within R of the distance at hand. The trees of a task's shards are built and searched level by level as
one forest of arrays. Shards are dealt to tasks by their key; broadcasting every tree to every executor would grow
with the corpus.

Only distinct fingerprints are compared. A shard over SHARD_ROWS rows is cut into pieces by a hash, and each pair of
pieces is a tree and a set of queries of its own, so no task holds a whole hot shard. A task returns the links of a
spanning forest, never all pairs of a shard; components.py joins the forests.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stage
from .components import components
from .text import let_go, mix, narrow, rows_out

#: Shingle width, seed and radius of the fingerprint contract.
WORDS, SEED, RADIUS = 4, 42, 4
#: Blocks of bits; every shard key holds BLOCKS - RADIUS of them.
BLOCKS = 6
#: Rows of a shard piece, and bins in which shard sizes are counted.
SHARD_ROWS, BINS = 2048, 4096
#: Pairs (query, node) that a search holds at once.
FRONTIER = 1_000_000
_BITS_AT_ONCE = 200_000


def fingerprint(text: str | None) -> int:
    """SimHash of the word shingles of a whole text, repeats included; no words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - WORDS + 1)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, _BITS_AT_ONCE):
        hi = min(n, lo + _BITS_AT_ONCE)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo:hi], ends[lo + WORDS - 1 : hi + WORDS - 1] or ends[-1:])], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp BIGINT) of every row; fp holds the 64 bits as a signed number."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                fps = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64)
                yield rows_out(schema, doc_id=part.column(0), fp=fps.view(np.int64))

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def block_keys(fps: np.ndarray, blocks: int = BLOCKS, radius: int = RADIUS) -> np.ndarray:
    """A row for each choice of blocks - radius blocks, with the key of every fingerprint for it."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in chosen)
        out.append(mix(fps & np.uint64(mask), number + 1))
    return np.stack(out)


class Forest:
    """BK-trees of many groups at once; a group's first row is its root. Rows come sorted by group."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        n = len(fps)
        self.fps = fps
        first = np.ones(n, bool)
        first[1:] = group[1:] != group[:-1]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        todo, node = np.flatnonzero(~first), self.root[~first]
        while len(todo):
            d = np.bitwise_count(fps[todo] ^ fps[node]).astype(np.int64)
            order = np.lexsort((todo, d, node))
            todo, node, d = todo[order], node[order], d[order]
            child = np.ones(len(todo), bool)
            child[1:] = (node[1:] != node[:-1]) | (d[1:] != d[:-1])
            heads = todo[child]
            parent[heads], edge[heads] = node[child], d[child]
            below = heads[np.cumsum(child) - 1]
            todo, node = todo[~child], below[~child]
        # Children of each node, by edge.
        kids = np.flatnonzero(parent >= 0)
        kids = kids[np.lexsort((edge[kids], parent[kids]))]
        self.kids, self.slot = kids, parent[kids] * 128 + edge[kids]

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """Index pairs (query, row) at most ``radius`` apart, a slice of the frontier at a time."""
        stack = [(np.arange(len(queries)), roots)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.slot, node * 128 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.slot, node * 128 + d + radius, side="right")
            n = hi - lo
            if n.any():
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                stack.append((np.repeat(q, n), self.kids[at]))


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of labels over links a-b, in place; a label is the least row of its class."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _shard_links(group, piece, fps, ids, radius):
    """Spanning links (id, id) of rows sorted by group; piece is 0 for the tree rows, 1 for the queries, 2 for both."""
    label = np.arange(len(fps))
    tree = np.flatnonzero(piece != 1)
    asks = np.flatnonzero(piece != 0)
    forest = Forest(fps[tree], group[tree])
    if len(tree) and len(asks):
        at = np.searchsorted(group[tree], group[asks])
        there = (at < len(tree)) & (group[tree][np.minimum(at, len(tree) - 1)] == group[asks])
        asks, at = asks[there], at[there]
        for q, node in forest.within(fps[asks], forest.root[at] if len(at) else at, radius):
            _join(label, asks[q], tree[node])
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return ids[linked], ids[label[linked]]


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between rows (fp, rep) with distinct fp whose fingerprints are within ``radius``.

    Enough of them to connect all that is connected; every pair within the radius is tested.
    """
    spark = distinct.sparkSession
    rows = stage(distinct.select("fp", "rep"), "fingerprints")

    def count_bins(batches):
        held: dict[int, int] = {}
        for batch in batches:
            keys = block_keys(batch.column(0).to_numpy().view(np.uint64), blocks, radius)
            for number, row in enumerate(keys):
                bins, n = np.unique(row % np.uint64(BINS), return_counts=True)
                for b, c in zip(bins.tolist(), n.tolist()):
                    held[number * BINS + b] = held.get(number * BINS + b, 0) + c
        yield pa.RecordBatch.from_pydict({"bin": pa.array(list(held), pa.int64()), "n": pa.array(list(held.values()), pa.int64())})

    # At most BINS rows for each choice of blocks come back, however large the corpus.
    counted = rows.select("fp").mapInArrow(count_bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    sizes = {r["bin"]: r["n"] for r in counted.collect()}
    usual = sum(sizes.values()) / max(1, len(sizes))
    cut = {b: -(-n // SHARD_ROWS) for b, n in sizes.items() if n > max(SHARD_ROWS, 4 * usual)}
    pieces = np.ones(BINS * len(list(combinations(range(blocks), radius))), np.int64)
    for b, n in cut.items():
        pieces[b] = n
    shared = spark.sparkContext.broadcast(pieces)

    def deal(batches):
        schema = pa.schema([("shard", pa.int64()), ("piece", pa.int8()), ("fp", pa.int64()), ("rep", pa.int64())])
        for batch in batches:
            fps, rep = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            own = mix(fps, 99)
            for number, row in enumerate(block_keys(fps, blocks, radius)):
                m = shared.value[number * BINS + (row % np.uint64(BINS)).astype(np.int64)]
                whole = np.flatnonzero(m == 1)
                yield rows_out(schema, shard=row[whole].view(np.int64), piece=np.full(len(whole), 2, np.int8), fp=fps[whole].view(np.int64), rep=rep[whole])
                for pieces_now in np.unique(m[m > 1]):
                    hot = np.flatnonzero(m == pieces_now)
                    mine = (own[hot] % np.uint64(pieces_now)).astype(np.int64)
                    for other in range(pieces_now):
                        low, high = np.minimum(mine, other), np.maximum(mine, other)
                        key = mix(row[hot] ^ mix((low * pieces_now + high + 1).astype(np.uint64), 7), 8)
                        role = np.where(mine == other, 2, np.where(mine < other, 0, 1)).astype(np.int8)
                        yield rows_out(schema, shard=key.view(np.int64), piece=role, fp=fps[hot].view(np.int64), rep=rep[hot])

    def search(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        open_rows = None

        def answer(cols):
            group, piece, fps, ids = cols
            many = np.zeros(len(group), bool)
            if len(group) > 1:
                same = group[1:] == group[:-1]
                many[1:] |= same
                many[:-1] |= same
            a, b = _shard_links(group[many], piece[many], fps[many].view(np.uint64), ids[many], radius)
            return rows_out(schema, a=a, b=b)

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if open_rows is not None:
                cols = [np.concatenate(x) for x in zip(open_rows, cols)]
            # The last shard may go on in the next batch.
            cut_at = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            open_rows = [c[cut_at:] for c in cols]
            if cut_at:
                yield answer([c[:cut_at] for c in cols])
        if open_rows is not None and len(open_rows[0]):
            yield answer(open_rows)

    dealt = rows.mapInArrow(deal, "shard long, piece byte, fp long, rep long")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: documents linked by fingerprints within ``radius`` bits.

    component_id is the least doc_id reachable, itself included. Null and empty texts have fingerprint zero and are
    linked like any other. Repeated rows stay. A row without doc_id joins its class but never names it; a class of such
    rows alone has a null component_id.
    """
    prints = stage(fingerprints(docs, id_col, text_col), "prints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    named = classes.where("rep is not null")
    found = stage(components(links(named, radius)), "components")
    # A component is named by its least representative, which is its least doc_id.
    of_class = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(stage(of_class, "classes"), "fp").select("doc_id", hexed, "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, the one with the least id, all columns kept.

    Rows without an id cannot be told apart and stay.
    """
    first = near_duplicates(docs, id_col, text_col, radius).where("doc_id = component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    return (
        docs.where(F.col(id_col).isNotNull()).join(first, F.col(id_col) == F.col("__kept_id"), "left_semi").dropDuplicates([id_col])
        .unionByName(docs.where(F.col(id_col).isNull()))
    )
