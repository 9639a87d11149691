"""Document fingerprints from closed syncmers.

A k-mer of characters is chosen if its least s-mer, by hash, is its first or its last one. The choice looks at the k-mer
alone, so an edit moves no anchor outside the k-mers it touches, whatever the context. Anchors with their positions are
``anchors``; a fixed-size fingerprint keeps, for each of SLOTS parts of the hash space, the least anchor hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BASE, mix, narrow, rows_out, slices

#: Characters of an anchor and of its inner substrings; about one k-mer in four is chosen.
K, S = 12, 4
#: Finer anchors that short texts have besides, and the length up to which a text is short.
FINE_K, FINE_S, FINE_BELOW = 3, 1, 64
#: Parts of the hash space in a fingerprint, 16 bits each.
SLOTS = 128
#: Ordered pieces in which documents are paired with the next one.
PIECES = 128


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _closed(code: np.ndarray, starts: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and hash of the k-mers whose least s-mer stands at an edge."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = code.astype(np.uint64) + np.uint64(1)
    inner = np.zeros(len(c) - s + 1, np.uint64)
    for j in range(s):
        inner = inner * BASE + c[j : j + len(inner)]
    inner = mix(inner, 3)
    w = k - s + 1
    least, span = inner, 1
    while span < w:
        step = min(span, w - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    at = np.flatnonzero((inner[:n] == least[:n]) | (inner[w - 1 : w - 1 + n] == least[:n]))
    of = np.searchsorted(starts, at, side="right") - 1
    inside = at + k <= starts[of + 1]
    at, of = at[inside], of[inside]
    full = np.full(len(at), k, np.uint64)
    for j in range(0, k, s):
        full = full * BASE + inner[at + j]
    return of, at - starts[of], mix(full, 5)


def select(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed syncmers of several texts: text, position and hash of each, by text and position.

    A text under FINE_BELOW characters also has the anchors of FINE_K characters, and one shorter than these is an
    anchor as a whole; an empty text has none.
    """
    code, starts = _code_points(texts)
    size = np.diff(starts)
    parts = [_closed(code, starts, K, S)]
    few = np.flatnonzero((size > 0) & (size < FINE_BELOW))
    if len(few):
        some = [texts[i] for i in few]
        row, pos, h = _closed(*_code_points(some), FINE_K, FINE_S)
        parts.append((few[row], pos, h))
        tiny = few[size[few] < FINE_K]
        own = [int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for i in tiny]
        parts.append((tiny, np.zeros(len(tiny), np.int64), np.array(own, np.uint64)))
        row, pos, h = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((pos, row))
        return row[order], pos[order], h[order]
    return parts[0]


def sketches(texts: list[str]) -> np.ndarray:
    """A row of SLOTS numbers for each text; 0 is a slot without an anchor."""
    out = np.zeros((len(texts), SLOTS), np.uint16)
    row, _, h = select(texts)
    if len(h):
        slot = row * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64)
        value = h // np.uint64(SLOTS)
        order = np.lexsort((value, slot))
        slot, value = slot[order], value[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        out.reshape(-1)[slot[first]] = (mix(value[first], 9) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the slots that agree, of those in use: an estimate of the Jaccard similarity of the anchor sets.

    Two texts without anchors are alike.
    """
    used = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(used > 0, same / np.maximum(used, 1), 1.0)


def _hex(sketch: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in sketch.astype(">u2")]


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, anchor): every anchor of every whole text, for joins that match positions."""
    schema = pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("anchor", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0)
            for lo, hi in slices([len(t) for t in texts]):
                row, pos, h = select(texts[lo:hi])
                yield rows_out(schema, doc_id=ids.take(pa.array(row + lo)), position=pos, anchor=h.view(np.int64))

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, position long, anchor long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): 4 hexadecimal digits a slot. Null is an empty text, whose fingerprint is all zeros."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices([len(t) for t in texts]):
                yield rows_out(schema, doc_id=batch.column(0).slice(lo, hi - lo), fingerprint=_hex(sketches(texts[lo:hi])))

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, per_piece, out: str, id_col: str = "doc_id", text_col: str = "text", pieces: int = PIECES) -> DataFrame:
    """Apply ``per_piece`` to (doc_id, text, next text) with documents in ascending id, after the last one the first.

    One shuffle of the texts: documents are dealt to ordered pieces by id, and the first document of each piece also
    goes to the piece before it as its last row. Only the piece limits, ``pieces`` numbers, reach the driver. Rows of
    equal id follow each other by text; rows without id come first.
    """
    rows = narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Nulls sort before every id.
    order = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    marks = rows.select(F.percentile_approx(order, [i / pieces for i in range(1, pieces)], 20 * pieces)).first()[0] or []
    limits = sorted(set(marks))
    piece = _rank(order, limits, 0, len(limits))
    heads = {r["piece"]: r["head"] for r in rows.groupBy(piece.alias("piece")).agg(F.min(order).alias("head")).collect()}
    if not heads:
        return rows.limit(0).mapInArrow(lambda it: iter(()), out)
    held = sorted(heads)
    before = {heads[p]: held[i - 1] for i, p in enumerate(held)}  # the first piece's head ends the last piece
    is_head = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[order]
    dealt = rows.withColumn("guest", F.explode(F.when(is_head.isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    dealt = dealt.select(F.when(F.col("guest"), is_head).otherwise(piece).alias("piece"), "guest", "doc_id", "text")
    return dealt.repartition(pieces, "piece").sortWithinPartitions("piece", "guest", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(per_piece, out)


def _rank(value, limits: list[int], lo: int, hi: int):
    """Number of limits below ``value``, as nested comparisons of logarithmic depth."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value > limits[mid], _rank(value, limits, mid + 1, hi)).otherwise(_rank(value, limits, lo, mid))


def robustness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: int = PIECES) -> DataFrame:
    """How fingerprints stand an edit: each text against itself with its last quarter replaced, and against the next.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The replacement is
    the first floor(n_chars / 4) code points of the next document, or all of it. A sole document is its own next.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def answer(ids, texts, sketch, following, follow_sketch):
        edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following)]
        new = sketches(edited)
        return rows_out(
            schema, doc_id=ids, n_chars=[len(t) for t in texts],
            edited_sha256=[hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            fingerprint=_hex(sketch), edited_fingerprint=_hex(new), near_edited=likeness(sketch, new), near_next=likeness(sketch, follow_sketch),
        )

    def run(batches):
        # The last row of each piece so far: (piece, doc_id, text, sketch), still without its next.
        open_row = None
        for batch in batches:
            piece, guest, ids = (batch.column(i).to_pylist() for i in range(3))
            sizes = pc.utf8_length(batch.column(3)).to_pylist()
            for lo, hi in slices(sizes):
                texts = batch.column(3).slice(lo, hi - lo).to_pylist()
                sketch = sketches(texts)
                p, g, d = piece[lo:hi], guest[lo:hi], ids[lo:hi]
                if open_row is not None:
                    p, g, d = [open_row[0], *p], [False, *g], [open_row[1], *d]
                    texts, sketch = [open_row[2], *texts], np.concatenate((open_row[3], sketch))
                # A row is answered by the row after it in its piece; guests only answer.
                at = [i for i in range(len(p) - 1) if not g[i] and p[i] == p[i + 1]]
                if at:
                    after = [i + 1 for i in at]
                    yield answer([d[i] for i in at], [texts[i] for i in at], sketch[at], [texts[i] for i in after], sketch[after])
                open_row = None if g[-1] else (p[-1], d[-1], texts[-1], sketch[-1:])

    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", id_col, text_col, pieces)
