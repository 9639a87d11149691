"""Hard negatives by anchor spanning-tree bounds.

Each anchor looks for its best rows of the same label, its positives, and then for the best rows of other labels whose
score lies in a window that each positive sets. A score is the integer inner product of two vectors.

- Anchors that lie together form a tree: a least spanning tree over their distances and the origin. A child's score with
  any candidate differs from its parent's by no more than the edge's length times the candidate's norm; at the origin
  every score is 0. Where the interval of a parent is not exact, the child's is wider by as much.
- Going down the tree, only candidates whose interval meets what an anchor still asks for are scored exactly: the best
  few of its label at first, the windows of its positives then. Anchors far from all others hang from the origin; nearly
  all their candidates are scored, in one matrix product.
- Trees and blocks of candidates are packed once, of bounded size each. Every tree meets every block through an equi-join
  on the block's number, one pair a row, so a task holds one tree and one block. A label that a third of all rows have is
  spread over all blocks. What a pair returns is the best few rows an anchor, merged by ranking over the anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import div, ordered_scan
from ..sources import stage
from .text import let_go

POSITIVES, NEGATIVES = 5, 3
#: A negative's score as a share of the positive's, in hundredths.
WINDOW = (50, 95)
#: Anchors in a tree, candidates in a block, and tasks that pairs are dealt to at most.
TREE_SIZE, BLOCK_ROWS, MOST_TASKS = 256, 1 << 14, 1 << 14
#: Share of a block from which a whole matrix row costs less than the scores picked out.
DENSE = 0.125
#: Bounds are widened by this share, far above the rounding of norms and edges.
SLACK = 1e-9

_PACKED = pa.schema([("no", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("wide", pa.bool_())])
_PACKED_DDL = "no long, n long, ids binary, labels binary, vectors binary, wide boolean"
_TREE = pa.schema([*_PACKED, ("parents", pa.binary()), ("edges", pa.binary())])
_TREE_DDL = _PACKED_DDL + ", parents binary, edges binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part: id, label and vector known, all components known and finite."""
    known = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    # The largest double stands for every infinite one; a NaN is above all.
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) <= 1.7976931348623157e308, F.lit(False)))
    v = F.transform(vector_col, lambda x: _floor(x.cast("double") * scale))
    return vectors.where(known & finite).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))


def _floor(x: Column) -> Column:
    """Greatest whole number not above x, as a double also where a long ends."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of components; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    cut = np.asarray(column.offsets)
    flat = np.asarray(column.values.slice(0, cut[-1]).cast(pa.float64()))
    sizes = np.diff(cut)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat[cut[0] :]
    return out


def _packed(no: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> dict:
    wide = bool(np.abs(v).max(initial=0) >= 1 << 24)
    return {"no": no, "n": len(ids), "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": v.astype(np.float64 if wide else np.float32).tobytes(), "wide": wide}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.frombuffer(row["vectors"], np.float64 if row["wide"] else np.float32)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), v.reshape(row["n"], -1)


def _in_order(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of (id, label, v); rows by id, repeated rows once."""
    ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
    order = np.argsort(ids, kind="stable")
    ids, labels, v = ids[order], labels[order], v[order]
    if (ids[1:] == ids[:-1]).any():
        row = np.ascontiguousarray(np.column_stack((ids.view(np.float64), labels.view(np.float64), v + 0.0)))
        _, first = np.unique(row.view(np.dtype((np.void, row.shape[1] * 8))).ravel(), return_index=True)
        first.sort()
        ids, labels, v = ids[first], labels[first], v[first]
    return ids, labels, v


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Candidates (id, label, v) in packed blocks of up to ``size`` rows, numbered by task."""

    def pack(batches):
        let_go()
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield pa.RecordBatch.from_pylist([_packed(made, *_in_order(batch.slice(at, size)))], schema=_PACKED)
                made += 1

    return rows.select("id", "label", "v").mapInArrow(pack, _PACKED_DDL)


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least spanning tree over the rows and the origin: an order in which parents come first, parents by place in that
    order (-1 for the origin), and edge lengths."""
    n = len(v)
    norm2 = np.einsum("ij,ij->i", v, v)
    near, parent = norm2.copy(), np.full(n, -1)
    left = np.ones(n, bool)
    order, place = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(n):
        at = int(np.argmin(np.where(left, near, np.inf)))
        left[at] = False
        order[k], place[at] = at, k
        apart = np.maximum(norm2 + norm2[at] - 2 * (v @ v[at]), 0)
        closer = left & (apart < near)
        near[closer], parent[closer] = apart[closer], at
    parents = np.array([-1 if parent[a] < 0 else place[parent[a]] for a in order], np.int64)
    # Edges are measured anew: differences of large squares would be off.
    ends = np.where((parents >= 0)[:, None], v[order][np.maximum(parents, 0)], 0.0)
    return order, parents, np.sqrt(np.square(v[order] - ends).sum(1))


def trees(anchors: DataFrame, size: int = TREE_SIZE) -> DataFrame:
    """Distinct anchors (id, label, v) in packed trees of one label and up to ``size`` anchors, neighbours along a line together."""
    line = F.aggregate(F.transform("v", lambda x, i: x * F.cos(i * i + 1.0)), F.lit(0.0), lambda a, x: a + x)
    laid = anchors.distinct().withColumn("line", line).repartitionByRange("label", "line", "id").sortWithinPartitions("label", "line", "id")

    def grow(batches):
        let_go()
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            labels = batch.column(1).to_numpy()
            begin = 0
            while begin < len(labels):
                end = begin + int(np.argmax(np.append(labels[begin : begin + size] != labels[begin], True)))
                part = batch.slice(begin, end - begin)
                v = _matrix(part.column(2))
                order, parents, edges = spanning_tree(v)
                row = _packed(made, part.column(0).to_numpy()[order], labels[begin:end][order], v[order])
                yield pa.RecordBatch.from_pylist([{**row, "parents": parents.tobytes(), "edges": edges.tobytes()}], schema=_TREE)
                begin, made = end, made + 1

    return laid.select("id", "label", "v").mapInArrow(grow, _TREE_DDL)


def _same_width(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as numbers in which their products are exact, and as wide as the wider."""
    width = max(a.shape[1], c.shape[1])
    a, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, c))
    most = [float(np.sqrt(np.square(x.astype(np.float64)).sum(1)).max(initial=0)) for x in (a, c)]
    top = most[0] * most[1] * 1.01
    if top < 1 << 24:
        return a.astype(np.float32), c.astype(np.float32)
    if top < 1 << 53:
        return a.astype(np.float64), c.astype(np.float64)
    exact = np.vectorize(int, otypes=[object])
    return (a.astype(np.int64), c.astype(np.int64)) if top < 2.0**62 else (exact(a.astype(np.float64)), exact(c.astype(np.float64)))


def _product(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows; beyond the range of a long they are set to its end."""
    got = a @ c.T
    if got.dtype == object:
        end = (1 << 63) - 1
        got = np.array([[min(max(x, -end), end) for x in row] for row in got], object).astype(np.int64).reshape(got.shape)
    return got


def tree_scores(a: np.ndarray, c: np.ndarray, parents: np.ndarray, edges: np.ndarray, asked) -> tuple[np.ndarray, np.ndarray]:
    """Scores of anchors with candidates, and where they are exact: wherever ``asked(anchors, low, high)`` says that an
    interval meets what these anchors ask for."""
    norms = np.sqrt(np.square(c.astype(np.float64)).sum(1)) * (1 + SLACK)
    sides = _same_width(a, c)
    kind = np.int64 if sides[0].dtype == object else sides[0].dtype
    scores, spread = np.zeros((len(a), len(c)), kind), np.zeros((len(a), len(c)), np.float32 if kind == np.float32 else np.float64)
    level = np.zeros(len(a), np.int64)
    for k, p in enumerate(parents):  # parents come first
        level[k] = 0 if p < 0 else level[p] + 1
    for depth in range(int(level.max(initial=-1)) + 1):
        some = np.flatnonzero(level == depth)
        up = parents[some]
        width = edges[some, None] * (1 + SLACK) * norms
        centre = np.zeros((len(some), len(c)), kind)
        if depth:
            centre, width = scores[up], width + spread[up]
        width = np.nextafter(width.astype(spread.dtype), np.inf)
        want = asked(some, centre - width, centre + width)
        scores[some], spread[some] = centre, width
        whole = want.mean(1) >= DENSE if len(c) else np.zeros(len(some), bool)
        if whole.any():
            scores[some[whole]], spread[some[whole]] = _product(sides[0][some[whole]], sides[1]), 0
        i, j = np.nonzero(want & ~whole[:, None])
        for at in range(0, len(i), 1 << 16):
            x, y = some[i[at : at + (1 << 16)]], j[at : at + (1 << 16)]
            if sides[0].dtype == object:
                got = np.array([min(max(int(np.dot(sides[0][p], sides[1][q])), -(1 << 63) + 1), (1 << 63) - 1) for p, q in zip(x, y)], np.int64)
            else:
                got = np.einsum("ij,ij->i", sides[0][x], sides[1][y])
            scores[x, y], spread[x, y] = got, 0
    return scores, spread == 0


def _first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` rows of each group by falling score, then id; equal pairs of score and id once."""
    order = np.lexsort((ids, -score, group))
    g, s, d = group[order], score[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    order, g = order[new], g[new]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    return order[rank < most]


def _best_of_label(tree: dict, block: dict, most: int) -> tuple[np.ndarray, ...]:
    """(anchor, id, score) of the best candidates of an anchor's label, of other ids than its own."""
    a_ids, a_labels, a = _unpacked(tree)
    ids, labels, c = _unpacked(block)
    if not len(a_labels):
        return (np.zeros(0, np.int64),) * 3
    same = labels == a_labels[0]
    ids, c = ids[same], c[same]
    own = a_ids[:, None] == ids
    # Differing rows of one id may score alike and then count once, so as many more are looked at.
    last = len(ids) - most - (len(ids) - len(np.unique(ids)))

    def asked(some, low, high):
        if last <= 0:
            return ~own[some]
        low = np.where(own[some], -np.inf, low)
        enough = np.partition(low, last, axis=1)[:, last]
        return (high >= enough[:, None]) & ~own[some]

    scores, exact = tree_scores(a, c, np.frombuffer(tree["parents"], np.int64), np.frombuffer(tree["edges"]), asked)
    exact &= ~own
    if last > 0:
        low = np.where(exact, scores, np.array(-np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min, scores.dtype))
        exact &= low >= np.partition(low, last, axis=1)[:, last][:, None]
    i, j = np.nonzero(exact)
    score = scores[i, j].astype(np.int64)
    kept = _first_of_each(i, score, ids[j], most)
    return i[kept], ids[j][kept], score[kept]


def _best_in_windows(tree: dict, block: dict, most: int, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, window, id, score) of the best candidates of other labels in each window of an anchor."""
    _, a_labels, a = _unpacked(tree)
    ids, labels, c = _unpacked(block)
    other = labels != a_labels[0]
    ids, c = ids[other], c[other]
    some_window = lows <= highs
    least = np.where(some_window, lows, np.iinfo(np.int64).max).min(1)
    greatest = np.where(some_window, highs, np.iinfo(np.int64).min).max(1)
    asked = lambda some, low, high: (high >= least[some, None]) & (low <= greatest[some, None])
    scores, exact = tree_scores(a, c, np.frombuffer(tree["parents"], np.int64), np.frombuffer(tree["edges"]), asked)
    found = []
    for w in range(lows.shape[1]):
        todo = np.flatnonzero(some_window[:, w])
        # From the top of the window down: a thin part of it mostly holds enough.
        for part in (64, 8, 1):
            low, high = lows[todo, w], highs[todo, w]
            floor = high - (high - low) // part
            inside = exact[todo] & (scores[todo] >= floor[:, None]) & (scores[todo] <= high[:, None])
            full = (inside.sum(1) >= most) | (part == 1)
            i, j = np.nonzero(inside[full])
            i, score = todo[full][i], scores[todo[full][i], j].astype(np.int64)
            kept = _first_of_each(i, score, ids[j], most)
            found.append((i[kept], np.full(len(kept), w), ids[j][kept], score[kept]))
            todo = todo[~full]
            if not len(todo):
                break
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def _pairs(packed: DataFrame, grown: DataFrame) -> DataFrame:
    """Every tree with every block: the tree goes to each block's number, a block meets them there."""
    count = packed.count()
    tasks = max(1, min(count, MOST_TASKS))
    sent = grown.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(max(count, 1)))))
    held = packed.select("r", *[F.col(c).alias(f"b_{c}") for c in _PACKED.names])
    return held.repartition(tasks, "r").hint("shuffle_hash").join(sent.repartition(tasks, "r"), "r").drop("r")


def _numbered(packed: DataFrame) -> DataFrame:
    """Blocks with ``r``, their place from 1."""
    one = packed.select("no", F.lit(1).alias("one"))
    ranks = ordered_scan(one, ["one"], ["no"], div("no", 1 << 44), rank="r").select("no", "r")
    return packed.join(ranks, "no")


def _rows_of(batch: pa.RecordBatch):
    """Pairs one by one, so that a batch is not unpacked as a whole."""
    for k in range(batch.num_rows):
        row = batch.slice(k, 1).to_pylist()[0]
        yield {n: row[n] for n in _TREE.names}, {n: row[f"b_{n}"] for n in _PACKED.names}, row.get("asks")


def positives(pairs: DataFrame, most: int = POSITIVES) -> DataFrame:
    """(tree, at, anchor_id, positive_id, positive_score): the first ``most`` other rows of an anchor's label."""
    out = pa.schema([("tree", pa.int64()), ("at", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def work(batches):
        let_go()
        for batch in batches:
            for tree, block, _ in _rows_of(batch):
                at, ids, score = _best_of_label(tree, block, most)
                owner = np.frombuffer(tree["ids"], np.int64)[at]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(at), tree["no"]), at, owner, ids, score)], schema=out)

    best = pairs.mapInArrow(work, "tree long, at long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("tree", "at").orderBy(F.desc("positive_score"), "positive_id")
    # Rows of one id and score share a rank and then become one.
    return best.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= most).dropDuplicates(["tree", "at", "rank"])


def mine(
    vectors: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    A component x counts as floor(scale * x). An anchor is a row for which ``is_anchor``, an expression on ``id``, holds.
    Its positives are the best rows of its label, its negatives the best rows of other labels whose score lies within
    ``window`` hundredths of the positive's; higher scores come first, then smaller ids. Nothing is capped before that.

    Rows without id, label or vector, or with a component that is null or not finite, take no part. An anchor's own id is
    never its positive. Rows of one id and score count once, so repeated rows change nothing; rows of one id that differ
    are each an anchor and a candidate. A vector shorter than another is taken to end in zeros. Scores beyond the range
    of a long are set to its end. An empty table, and anchors without positives or negatives, give no rows.
    """
    rows = quantised(vectors, id_col, vector_col, label_col, scale)
    wanted = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # Blocks are full at scale; before that there are as many as tasks run side by side.
    size = max(1, min(BLOCK_ROWS, rows.count() // int(wanted) + 1))
    packed = stage(_numbered(stage(blocks(rows, size), "blocks")), "numbered")
    grown = stage(trees(rows.where(is_anchor)), "trees")
    best = stage(positives(_pairs(packed, grown), n_positives), "positives")

    # The windows of a tree's anchors travel with it, and its label is the anchors'.
    asks = best.groupBy("tree").agg(F.collect_list(F.struct("at", "rank", "positive_score")).alias("asks"))
    told = grown.join(asks, grown["no"] == asks["tree"]).drop("tree")
    out = pa.schema([("tree", pa.int64()), ("at", pa.int64()), ("place", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def work(batches):
        let_go()
        for batch in batches:
            for tree, block, told_asks in _rows_of(batch):
                lows, highs = np.ones((tree["n"], n_positives), np.int64), np.zeros((tree["n"], n_positives), np.int64)
                for a in told_asks:
                    s = a["positive_score"]
                    lows[a["at"], a["rank"] - 1], highs[a["at"], a["rank"] - 1] = -(-window[0] * s // 100), window[1] * s // 100
                at, w, ids, score = _best_in_windows(tree, block, n_negatives, lows, highs)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(at), tree["no"]), at, w + 1, ids, score)], schema=out)

    found = _pairs(packed, told).mapInArrow(work, "tree long, at long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("tree", "at", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= n_negatives).dropDuplicates(["tree", "at", "place", "r"])
    named = best.withColumnRenamed("rank", "place").join(ranked, ["tree", "at", "place"])
    return named.select("anchor_id", "positive_id", F.col("r").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The same rows of the query as DuckDB SQL.
SQL = r"""
with rows as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as materialized (
  select a.id as anchor_id, a.label = c.label as same, c.id, cast(list_inner_product(a.v, c.v) as bigint) as score
  from rows a join rows c on a.id % 50 = 0 and a.id <> c.id
), positive as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as integer) as rank,
  id as negative_id, positive_score, score as negative_score
from positive p join scored s on s.anchor_id = p.anchor_id and not same
  and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""
