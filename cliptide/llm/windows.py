"""Near-duplicate passages by compact windows.

The tokens of a text are its word shingles. For a min-hash function, every token sequence [i, j] takes the hash of its
least token; the Cartesian tree over the tokens' hashes groups the sequences: a compact window (l, c, r) stands for all
sequences with l <= i <= c <= j <= r, whose least token is c. Only windows that hold a sequence of the least passage
length count, about two for each such length and function.

1. Windows with the same function and least token in two documents share a signature. The windows of HASHES functions
   are joined as intervals: where at least AGREE functions have a shared window is a candidate region. A passage with
   similarity 0.8 or more shares a function's window with probability 0.8 at least, so fewer than AGREE are shared
   once in 600 times; an exact copy shares all.
2. Verification is exact: the shingles of candidate regions, and of no other, are held against those of documents with
   a smaller id. A passage is a longest run of shingles of which at least SIMILAR recur in earlier documents.

Every match has a region on both sides, so the regions hold all that is compared. Hot signatures are reduced to one row
a batch before the shuffle; nothing is paired within a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stage
from .packed import apart, bucket_count, exchange, pack, thin, unpack
from .text import let_go, lower_ascii, mix, narrow, portions, rows_out, shingle_hash, slices, span_hash, utf8, word_spans

#: Words of a shingle and of the shortest passage, and the least part of its shingles found earlier.
WORDS, LEAST_WORDS, SIMILAR = 5, 50, 0.8
HASHES, AGREE = 6, 2
SLICE_BYTES = 500_000
_LEAST = LEAST_WORDS - WORDS + 1


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of the rows of a buffer, their rows, and where each row's shingles start.

    Words are runs of bytes other than ASCII white space, without ASCII case; a row under WORDS words has no shingle.
    """
    begin, end, of = word_spans(data, starts)
    s = shingle_hash(span_hash(lower_ascii(data), begin, end), WORDS)
    inside = of[WORDS - 1 :] == of[: len(s)] if len(s) else np.zeros(0, bool)
    s, row = s[inside], of[: len(inside)][inside]
    return s, row, np.searchsorted(row, np.arange(len(starts)))


def _running(x: np.ndarray, width: int, pick) -> np.ndarray:
    span = 1
    while span < width:
        step = min(span, width - span)
        x = pick(x[: len(x) - step], x[step:])
        span += step
    return x


def _nearest(h: np.ndarray, row: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """Index of the nearest lesser value (or equal one) before or after, in the same row; -1 if there is none."""
    near, todo = np.arange(len(h)) + step, np.arange(len(h))
    while len(todo):
        at = near[todo]
        out = (at < 0) | (at >= len(h))
        out |= row[np.where(out, 0, at)] != row[todo]
        near[todo[out]] = -1
        todo, at = todo[~out], at[~out]
        skip = h[at] > h[todo] if equal else h[at] >= h[todo]
        todo, at = todo[skip], at[skip]
        near[todo] = near[at]
        todo = todo[near[todo] >= 0]
    return near


def compact_windows(s: np.ndarray, row: np.ndarray, starts: np.ndarray, function: int, least: int = _LEAST):
    """Row, l, c, r (places in the row) of the windows of one function that hold ``least`` tokens or more."""
    none = np.zeros(0, np.int64)
    if len(s) < least:
        return none, none, none, none
    h = mix(s, function + 1) | np.uint64(1)
    low = _running(h, least, np.minimum)
    low[row[: len(low)] != row[least - 1 :]] = 0
    wide = np.concatenate((np.zeros(least - 1, np.uint64), low, np.zeros(least - 1, np.uint64)))
    c = np.flatnonzero(_running(wide, least, np.maximum)[: len(h)] == h)
    # The nearest lesser token of a window's least one is the least one of a window too, so these suffice for the tree.
    of = row[c]
    before, after = _nearest(h[c], of, -1, True), _nearest(h[c], of, 1, False)
    left = np.where(before >= 0, c[before] + 1, starts[of])
    right = np.where(after >= 0, c[after] - 1, starts[of + 1] - 1)
    good = right - left + 1 >= least
    base = starts[of[good]]
    return of[good], left[good] - base, c[good] - base, right[good] - base


_WINDOW = (np.uint64, np.int64, np.int32, np.int32, np.int8)
_SHARED = pa.schema([("doc_id", pa.int64()), ("hash_fn", pa.int8()), ("lo", pa.int32()), ("hi", pa.int32())])


def _by_key(key, doc):
    """Order by key and document; start of each key's rows; is the row of the key's least document; do documents differ."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    first = d[start][group] if len(k) else d
    last = d[np.concatenate((start[1:], [len(k)])) - 1][group] if len(k) else d
    return order, first, d == first, first != last


def _shared_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, hash_fn, lo, hi): windows whose signature another document has."""

    def make(batches):
        for batch in portions(batches):
            data, starts = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            got = []
            for a, b in slices(np.diff(starts), SLICE_BYTES):
                s, row, at = tokens(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                for f in range(HASHES):
                    of, lo, c, hi = compact_windows(s, row, at, f)
                    key = mix(s[at[of] + c], 101 + f)
                    got.append((key, ids[a:b][of], lo.astype(np.int32), hi.astype(np.int32), np.full(len(of), f, np.int8)))
            if not got:
                continue
            columns = [np.concatenate(x) for x in zip(*got)]
            order, _, first, differ = _by_key(columns[0], columns[1])
            columns = [c[order] for c in columns]
            if differ.any():
                met = [c[differ] for c in columns[1:]]
                yield pack(np.abs(met[0] % buckets), met, 1)
            columns = [c[first] for c in columns]
            yield pack((columns[0] % np.uint64(buckets)).astype(np.int64), columns)

    def reduce(table):
        columns = unpack(table, 0, _WINDOW)
        order, _, _, differ = _by_key(columns[0], columns[1])
        met = [np.concatenate(x) for x in zip([c[order][differ] for c in columns[1:]], unpack(table, 1, _WINDOW[1:]))]
        return pa.Table.from_batches([rows_out(_SHARED, doc_id=met[0], hash_fn=met[3], lo=met[1], hi=met[2])])

    return exchange(rows, make, reduce, "doc_id long, hash_fn byte, lo int, hi int")


def _join_intervals(fn: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [begin, end) where windows of at least AGREE functions lie over each other, of the least length."""
    size = int(hi.max()) + 2
    functions = np.zeros(size, np.int64)
    for f in np.unique(fn):
        mark = np.zeros(size, np.int64)
        np.add.at(mark, lo[fn == f], 1)
        np.add.at(mark, hi[fn == f] + 1, -1)
        functions += np.cumsum(mark) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (functions >= AGREE).astype(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= _LEAST * SIMILAR
    return begin[long], end[long]


def _regions(shared: DataFrame) -> DataFrame:
    """(doc_id, at): candidate regions of each document, as ranges of shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))])

    def run(batches):
        for batch in batches:
            ids, at = [], []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                own = batch.column(1)[i].values
                begin, end = _join_intervals(*(own.field(k).to_numpy() for k in range(3)))
                if len(begin):
                    ids.append(doc)
                    at.append([{"lo": a, "hi": b} for a, b in zip(begin.tolist(), end.tolist())])
            yield rows_out(schema, doc_id=ids, at=at)

    windows = shared.groupBy("doc_id").agg(F.collect_list(F.struct("hash_fn", "lo", "hi")).alias("w"))
    return windows.mapInArrow(run, "doc_id long, at array<struct<lo:int,hi:int>>")


_EARLIER = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), ("n", pa.int32()), ("source_id", pa.int64())])


def _runs(doc, place, source):
    """Neighbouring places of a document with the same source as one run."""
    order = np.lexsort((place, doc))
    doc, place, source = doc[order], place[order], source[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    doc, place, source = doc[keep], place[keep], source[keep]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(doc)]))).astype(np.int32)
    return doc[first], place[first], n, source[first]


def _earlier_shingles(regions_with_text: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, place, n, source_id): runs of shingles that documents with smaller ids have in their regions."""

    def make(batches):
        for batch in portions(batches):
            data, starts = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            at, cut = batch.column(2), batch.column(2).offsets.to_numpy()
            lo, hi = (at.values.field(k).to_numpy() for k in (0, 1))
            got = []
            for a, b in slices(np.diff(starts), SLICE_BYTES):
                s, row, first = tokens(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                of = np.repeat(np.arange(b - a), np.diff(cut[a : b + 1]))
                begin, end = lo[cut[a] : cut[b]] + first[of], hi[cut[a] : cut[b]] + first[of]
                inside = np.zeros(len(s) + 1, np.int64)
                np.add.at(inside, begin, 1)
                np.add.at(inside, np.minimum(end, len(s)), -1)
                p = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
                got.append((s[p], ids[a:b][row[p]], (p - first[row[p]]).astype(np.int32)))
            if not got:
                continue
            key, doc, place = (np.concatenate(x) for x in zip(*got))
            order, source, first, _ = _by_key(key, doc)
            key, doc, place = key[order], doc[order], place[order]
            if not first.all():
                runs = _runs(doc[~first], place[~first], source[~first])
                yield pack(np.abs(runs[0] % buckets), runs, 1)
            key, doc, place = key[first], doc[first], place[first]
            yield pack((key % np.uint64(buckets)).astype(np.int64), (key, doc, place))

    def reduce(table):
        key, doc, place = unpack(table, 0, (np.uint64, np.int64, np.int32))
        order, source, first, _ = _by_key(key, doc)
        met = ~first
        runs = _runs(doc[order][met], place[order][met], source[met])
        doc, place, n, source = (np.concatenate(x) for x in zip(runs, unpack(table, 1, (np.int64, np.int32, np.int32, np.int64))))
        return pa.Table.from_batches([rows_out(_EARLIER, doc_id=doc, place=place, n=n, source_id=source)])

    return exchange(regions_with_text, make, reduce, "doc_id long, place int, n int, source_id long")


def best_runs(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint longest stretches over sorted disjoint ranges of found shingles, at least SIMILAR of each found.

    A found shingle scores 1 - SIMILAR and another one -SIMILAR; these are all maximal scoring stretches.
    """
    gain = 1 - SIMILAR
    done: list[list[float]] = []  # begin, end, score before, score after
    score = 0.0
    for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
        if i:
            score -= SIMILAR * (a - int(end[i - 1]))
        now = [a, b, score, score + gain * (b - a)]
        score = now[3]
        while True:
            j = len(done) - 1
            while j >= 0 and done[j][2] >= now[2]:
                j -= 1
            if j < 0 or done[j][3] >= now[3]:
                done.append(now)
                break
            now = [done[j][0], now[1], done[j][2], now[3]]
            del done[j:]
    return [(int(a), int(b)) for a, b, _, _ in done]


_PASSAGE = pa.schema([("doc_id", pa.int64()), ("source_id", pa.int64()), ("word_start", pa.int64()), ("word_end", pa.int64()), ("similarity", pa.float64())])


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source_id, word_start, word_end, similarity): passages that documents with smaller ids have.

    Words are counted from 0, word_end is the word after the last one. similarity is the part of the passage's shingles
    found in earlier documents, at least SIMILAR; source_id is the earlier document most of them are first found in.
    The first document with a passage has no row for it. Null and short texts have no passages; rows without id neither
    have nor give any; repeated rows of one id are no copies of each other and give their passages once.
    """
    rows = narrow(docs, id_col, text_col).where("doc_id is not null and text is not null")
    buckets = bucket_count(rows)
    shared = stage(_shared_windows(rows, buckets), "windows")
    regions = stage(_regions(shared), "regions")
    near, _ = thin(rows, regions)
    found = stage(_earlier_shingles(near.join(apart(regions), "doc_id").select("doc_id", "text", "at"), buckets), "found")

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                own = batch.column(1)[i].values
                place, n, source = (own.field(k).to_numpy() for k in range(3))
                order = np.argsort(place, kind="stable")
                place, n, source = place[order].astype(np.int64), n[order].astype(np.int64), source[order]
                # A place may be met by a batch and by a bucket; it counts once.
                stop = np.maximum.accumulate(place + n)
                place = np.maximum(place, np.concatenate(([0], stop[:-1])))
                n = stop - place
                place, n, source = place[n > 0], n[n > 0], source[n > 0]
                for a, b in best_runs(place, place + n):
                    if b - a < _LEAST:
                        continue
                    inside = (place < b) & (place + n > a)
                    who, which = np.unique(source[inside], return_inverse=True)
                    weight = np.bincount(which, weights=n[inside])
                    out.append((doc, int(who[weight.argmax()]), a, b + WORDS - 1, float(n[inside].sum() / (b - a))))
            yield rows_out(_PASSAGE, **{f.name: [x[i] for x in out] for i, f in enumerate(_PASSAGE)})

    runs = found.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n", "source_id")).alias("r"))
    return runs.mapInArrow(run, "doc_id long, source_id long, word_start long, word_end long, similarity double")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with the passages of earlier documents cut out of the texts; the first copy stays.

    The cut takes the words and the white space after them. A document of which no word is left goes. The length column,
    if there is one, follows the text. Different texts under one id are each cut at all places found for the id.
    """
    cuts = stage(passages(docs, id_col, text_col).groupBy("doc_id").agg(F.collect_list(F.struct("word_start", "word_end")).alias("__cuts")).withColumnRenamed("doc_id", "__cut_id"), "cuts")
    near, far = thin(docs, cuts.withColumnRenamed("__cut_id", id_col), id_col)
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        let_go()
        for batch in batches:
            texts = []
            for text, own in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                text = text.as_py()
                if own.is_valid and text is not None:
                    raw = text.encode()
                    data = np.frombuffer(raw, np.uint8)
                    begin, _, _ = word_spans(data, np.array([0, len(data)]))
                    edge = np.concatenate((begin, [len(data)]))
                    keep = np.ones(len(data), bool)
                    for c in own.as_py():
                        a, b = (min(c[k], len(edge) - 1) for k in ("word_start", "word_end"))
                        keep[edge[a] : edge[b]] = False
                    text = data[keep].tobytes().decode().rstrip()
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if length_at is not None:
                columns[length_at] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(length_at).type)
            left = [t is None or bool(t.strip()) or not own.is_valid for t, own in zip(texts, batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(left, pa.bool_()))

    joined = near.join(apart(cuts), near[id_col] == F.col("__cut_id"), "left").select(*[near[c] for c in docs.columns], "__cuts")
    return joined.mapInArrow(run, docs.schema).union(far)
