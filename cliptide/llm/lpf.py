"""Exact substring dedup by minimizer K-mers and hashes of strings, in place of longest-previous-factor arrays.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller id: a suffix whose longest
previous factor reaches SPAN. Only whether it does is asked, so equal strings are found by their hashes; no suffixes are
sorted and no factor lengths computed:

1. Anchors. Every string of SPAN bytes has the same least K-mer wherever it stands, so equal strings meet at equal
   anchors. An anchor is sent to a bucket by its K-mer, with a hash of its context: all bytes that a string of SPAN bytes
   with this anchor can reach. Equal context with an earlier document covers the whole context.
2. Edges. Where the K-mer, and with it a good half of such a string, recurs in another context, its strings are tested
   one by one: strings are grouped by a 64-bit hash of their SPAN bytes and matched with a smaller document.
3. Each text is cut by the union of its covered strings.

Texts are shuffled only where something of them was found; a filter of fixed size lets the others pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stage
from .packed import apart, bucket_count, earlier, exchange, pack, thin, unpack
from .text import inverse, mix, narrow, portions, powers, rows_out, slices, utf8

SPAN, K = 50, 18
#: K-mers in a string, and the bytes beside the K-mer of which a string has all on one side or the other.
W = SPAN - K + 1
SIDE = (SPAN - K) // 2
SLICE_BYTES = 500_000

LEFT, RIGHT = 1, 2

_ANCHOR = (np.uint64, np.uint32, np.int64, np.int32)
_HIT = (np.int64, np.int32, np.int32)
_FOUND = pa.schema([("doc_id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("open", pa.bool_())])
_FOUND_DDL = "doc_id long, lo int, hi int, open boolean"


class _Hashes:
    """Hashes of any substrings of a buffer, by prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=self.prefix[1:])
        self.undo = powers(n + 1, inverse())

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[begin]) * self.undo[begin])


def _running(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every ``width`` neighbours."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = pick(x[: len(x) - step], x[step:])
        span += step
    return x


def anchors(data: np.ndarray, starts: np.ndarray):
    """Row, position in the row, key and tag of every anchor of the rows of a buffer.

    key: 40 bits of the K-mer, 24 of the context; tag: 16 more of the context, 8 each of the SIDE bytes left and right
    of the K-mer, where 0 says that the text ends before.
    """
    n = len(data) - K + 1
    if n < W:
        return (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    hashes = _Hashes(data)
    at = np.arange(n)
    h = hashes.of(at, at + K) | np.uint64(1)
    least = _running(h, W, np.minimum)
    row_end = np.repeat(starts[1:], np.diff(starts))
    crosses = np.arange(len(least)) + SPAN > row_end[: len(least)]
    least[crosses] = 0
    wide = np.concatenate((np.zeros(W - 1, np.uint64), least, np.zeros(W - 1, np.uint64)))
    c = np.flatnonzero(_running(wide, W, np.maximum)[:n] == h)
    row = np.searchsorted(starts, c, side="right") - 1
    lo, hi = np.maximum(c - (SPAN - K), starts[row]), np.minimum(c + SPAN, starts[row + 1])
    context = mix(hashes.of(lo, hi) + (c - lo).astype(np.uint64), 1)
    left = np.where(c - SIDE >= starts[row], hashes.of(np.maximum(c - SIDE, 0), c) % np.uint64(255) + np.uint64(1), np.uint64(0))
    stop = np.minimum(c + K + SIDE, len(data))
    right = np.where(c + K + SIDE <= starts[row + 1], hashes.of(c + K, stop) % np.uint64(255) + np.uint64(1), np.uint64(0))
    key = (h[c] >> np.uint64(24)) << np.uint64(24) | context >> np.uint64(40)
    tag = ((context >> np.uint64(24)) & np.uint64(0xFFFF)) << np.uint64(16) | left << np.uint64(8) | right
    return row, (c - starts[row]).astype(np.int32), key, tag.astype(np.uint32)


def _merged(doc, lo, hi):
    """Overlapping or touching ranges of a document as one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    # Running greatest end within a document: documents are set apart by offsets.
    number = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    far = np.int64(1) << 33
    reach = np.maximum.accumulate(hi.astype(np.int64) + number * far) - number * far
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], lo[first], reach[last].astype(np.int32)


def _first_rows(doc: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by ``same``, then document; and for each row in that order, is it of the least document of its group."""
    order = np.lexsort((doc, *reversed(same)))
    new = np.ones(len(order), bool)
    new[1:] = np.any([s[order][1:] != s[order][:-1] for s in same], axis=0)
    least = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else doc[order]
    return order, doc[order] == least


def _reach(doc, pos):
    return doc, np.maximum(pos - (SPAN - K), 0).astype(np.int32), (pos + SPAN).astype(np.int32)


def _find_anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """Covered ranges (open is false), and the anchors whose strings are still to be tested (open, at lo, sides in hi)."""

    def make(batches):
        for batch in portions(batches):
            data, starts = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            got = []
            for a, b in slices(np.diff(starts), SLICE_BYTES):
                row, pos, key, tag = anchors(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                got.append((key, tag, ids[a:b][row], pos))
            if not got:
                continue
            key, tag, doc, pos = (np.concatenate(x) for x in zip(*got))
            # Of this batch, only the least document of each context travels on; the others are matched here.
            order, first = _first_rows(doc, key, tag >> np.uint32(16))
            sent, met = order[first], order[~first]
            bucket = (key[sent] >> np.uint64(24)) % np.uint64(buckets)
            yield pack(bucket.astype(np.int64), (key[sent], tag[sent], doc[sent], pos[sent]))
            if len(met):
                ranges = _merged(*_reach(doc[met], pos[met]))
                yield pack(np.abs(ranges[0] % buckets), ranges, 1)

    def reduce(table):
        key, tag, doc, pos = unpack(table, 0, _ANCHOR)
        order, first = _first_rows(doc, key, tag >> np.uint32(16))
        met = order[~first]
        ranges = [_reach(doc[met], pos[met]), unpack(table, 1, _HIT)]
        # One row stands for each context: its strings are tested if another context has the K-mer and one of its sides.
        lead = order[first]
        kmer = key[lead] >> np.uint64(24)
        context = mix(key[lead] ^ (tag[lead] >> np.uint32(16)).astype(np.uint64))
        ask = np.zeros(len(lead), np.int32)
        for bit, side in ((LEFT, (tag[lead] >> np.uint32(8)) & np.uint32(255)), (RIGHT, tag[lead] & np.uint32(255))):
            some = np.flatnonzero(side)
            by = np.lexsort((context[some], side[some], kmer[some]))
            at = some[by]
            same = (kmer[at][1:] == kmer[at][:-1]) & (side[at][1:] == side[at][:-1])
            group = np.concatenate(([0], np.cumsum(~same)))[: len(at)]
            turns = np.bincount(group[1:][same & (context[at][1:] != context[at][:-1])], minlength=group[-1] + 1 if len(group) else 0)
            ask[at[turns[group] > 0]] |= bit
        sides, ask = ask[ask > 0], lead[ask > 0]
        d, lo, hi = (np.concatenate(x) for x in zip(*ranges))
        return pa.Table.from_batches([rows_out(
            _FOUND, doc_id=np.concatenate((d, doc[ask])), lo=np.concatenate((lo, pos[ask])), hi=np.concatenate((hi, sides)),
            open=np.concatenate((np.zeros(len(d), bool), np.ones(len(ask), bool))),
        )])

    return exchange(rows, make, reduce, _FOUND_DDL)


def _test_strings(asked: DataFrame, buckets: int) -> DataFrame:
    """Covered ranges among the strings around the anchors of rows (doc_id, text, at (lo, sides)).

    A string is tested at its own least K-mer only, and only if the SIDE bytes it has beside that K-mer recur.
    """

    def make(batches):
        for batch in portions(batches):
            data, starts = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            cut = batch.column(2).offsets.to_numpy()
            at, sides = (batch.column(2).values.field(k).to_numpy() for k in (0, 1))
            got = []
            for a, b in slices(np.diff(starts), SLICE_BYTES):
                part = data[starts[a] : starts[b]]
                if len(part) < SPAN or cut[a] == cut[b]:
                    continue
                row = np.repeat(np.arange(a, b), np.diff(cut[a : b + 1]))
                begin = at[cut[a] : cut[b]].astype(np.int64) + starts[row] - starts[a]
                hashes = _Hashes(part)
                place = np.arange(len(part) - K + 1)
                h = hashes.of(place, place + K) | np.uint64(1)
                least = _running(h, W, np.minimum)
                found, owners = [], []
                for left in range(W):  # bytes of the string before its K-mer
                    every = begin - left
                    some = ((sides[cut[a] : cut[b]] & LEFT) > 0) & (left >= SIDE) | ((sides[cut[a] : cut[b]] & RIGHT) > 0) & (W - 1 - left >= SIDE)
                    some &= (every >= starts[row] - starts[a]) & (every + SPAN <= starts[row + 1] - starts[a])
                    every, anchor, owner = every[some], begin[some], row[some]
                    own = least[every] == h[anchor]
                    found.append(every[own])
                    owners.append(owner[own])
                every, back = np.unique(np.concatenate(found), return_index=True)
                owner = np.concatenate(owners)[back]
                got.append((hashes.of(every, every + SPAN), ids[owner], (every + starts[a] - starts[owner]).astype(np.int32)))
            if not got:
                continue
            key, doc, pos = (np.concatenate(x) for x in zip(*got))
            order, first = _first_rows(doc, key)
            sent, met = order[first], order[~first]
            yield pack(((key[sent] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), (key[sent], doc[sent], pos[sent]))
            if len(met):
                ranges = _merged(doc[met], pos[met], (pos[met] + SPAN).astype(np.int32))
                yield pack(np.abs(ranges[0] % buckets), ranges, 1)

    def reduce(table):
        key, doc, pos = unpack(table, 0, (np.uint64, np.int64, np.int32))
        met = earlier(key, doc)
        d, lo, hi = _merged(*(np.concatenate(x) for x in zip((doc[met], pos[met], (pos[met] + SPAN).astype(np.int32)), unpack(table, 1, _HIT))))
        return pa.Table.from_batches([rows_out(_FOUND, doc_id=d, lo=lo, hi=hi, open=np.zeros(len(d), bool))])

    return exchange(asked, make, reduce, _FOUND_DDL)


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lo, hi): byte ranges of each text that earlier documents have, in no order and overlapping.

    Rows without id are neither earlier nor later than any. Rows of equal id are not earlier than each other.
    """
    rows = narrow(docs, id_col, text_col).where("doc_id is not null and text is not null")
    buckets = bucket_count(rows)
    found = stage(_find_anchors(rows, buckets), "anchors")
    asked = found.where("open").groupBy("doc_id").agg(F.collect_list(F.struct("lo", F.col("hi").alias("sides"))).alias("at"))
    asked = stage(asked, "asked")
    near, _ = thin(rows, asked)
    tested = _test_strings(near.join(apart(asked), "doc_id").select("doc_id", "text", "at"), buckets)
    return found.where("not open").select("doc_id", "lo", "hi").union(tested.select("doc_id", "lo", "hi"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept, spans): each text without the bytes that earlier documents cover.

    kept is the remaining bytes, spans the removed ranges [lo, hi) in order. Null is an empty text. Repeated rows stay.
    An id names one text; different texts under one id are each cut by all ranges found for the id.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()),
        ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
    ])
    out = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<lo:long,hi:long>>"
    rows = narrow(docs, id_col, text_col)
    ranges = stage(covered(rows).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("at")), "ranges")
    near, far = thin(rows, ranges)

    def cut(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                n, gone, kept, spans = [], [], [], []
                for text, at in zip(part.column(1), part.column(2)):
                    raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                    mark = np.zeros(len(raw) + 1, np.int64)
                    if at.is_valid:
                        lo, hi = (at.values.field(i).to_numpy() for i in (0, 1))
                        np.add.at(mark, np.minimum(lo, len(raw)), 1)
                        np.add.at(mark, np.minimum(hi, len(raw)), -1)
                    drop = np.cumsum(mark)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], drop.view(np.int8), [0]))))
                    n.append(len(raw))
                    gone.append(int(drop.sum()))
                    kept.append(raw[~drop].tobytes())
                    spans.append([{"lo": int(x), "hi": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                yield rows_out(schema, doc_id=part.column(0), n_bytes=n, n_removed=gone, kept=kept, spans=spans)

    whole = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    untouched = far.select("doc_id", F.octet_length(whole).cast("long"), F.lit(0).cast("long"), whole, none)
    return near.join(apart(ranges), "doc_id", "left").select("doc_id", "text", "at").mapInArrow(cut, out).union(untouched)


def digest(kept: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what ``dedup`` returns."""
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
