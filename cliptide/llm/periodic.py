"""Periodic runs of words, found by a harmonic grid and longest common extensions over a difference cover.

A run is a stretch of words with smallest period q, at least ``times`` times q and ``least`` words long, that no neighbour
extends. In it, (times - 1) * q neighbouring words or more equal the word q further on. So for each q it is enough to look
at every (times - 1) * q-th word: over all q these grids have n log n places (the harmonic sum). Where a word on the grid
equals the word q further on, the run's ends follow from how far the text agrees with itself from there, both ways.

How far it agrees is a longest common extension. Among any two positions and the next MODULUS - 1 steps there is a step
that takes both into the difference cover, so a few words are compared and then two sampled suffixes. Only the suffixes at
cover positions are sorted; a sparse table of the least common prefixes between neighbours answers for any two of them.
Texts without a place that agrees that far, which are most, are never sorted.

Words are compared as numbers that a table of exact words gives out. A text is one task's work; no row is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import narrow, portions, rows_out, slices, utf8

#: Every difference modulo 13 is one of two members of the cover.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Shortest run, in words and in periods.
LEAST, TIMES = 6, 4
#: Bytes of text whose words are numbered together, and bytes that are split into words at once.
PORTION, PIECE = 1_200_000, 1 << 20

_SAMPLED = np.isin(np.arange(MODULUS), COVER)
#: Steps from residues (a, b) to the next place where both are in the cover.
_STEP = np.array([[next(t for t in range(MODULUS) if _SAMPLED[(a + t) % MODULUS] and _SAMPLED[(b + t) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)])


def _agree(w: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many words agree from i and j on in direction ``way``, up to ``most``; ends of texts must differ from all words."""
    told = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    for t in range(int(most.max(initial=0))):
        live = live[(w[i[live] + way * t] == w[j[live] + way * t])]
        told[live] += 1
        live = live[most[live] > t + 1]
        if not len(live):
            break
    return told


class Extensions:
    """Longest common extensions to the right in an array of numbers that ends with a number of its own."""

    def __init__(self, w: np.ndarray):
        self.w = w
        n = len(w)
        place = np.flatnonzero(_SAMPLED[np.arange(n) % MODULUS])
        at = np.full(n + 1, -1, np.int64)  # number of a sampled suffix by its place
        at[place] = np.arange(len(place))
        rank = self._first_ranks(place)
        levels, step = [], MODULUS
        while rank.max(initial=0) < len(place) - 1:
            levels.append((step, rank))
            follow = at[np.minimum(place + step, n)]
            key = rank * (len(place) + 1) + np.where(follow < 0, 0, rank[follow] + 1)
            rank = _ranked(key, np.argsort(key, kind="stable"))
            step *= 2
        order = np.argsort(rank)
        self.at, self.rank = at, rank
        self.table = _least(self._neighbours(place[order[:-1]], place[order[1:]], levels))

    def _first_ranks(self, place: np.ndarray) -> np.ndarray:
        """Ranks of the sampled suffixes by their first MODULUS words, several words to a sort key."""
        padded = np.concatenate((self.w.astype(np.int64) + 1, np.zeros(MODULUS, np.int64)))
        bits = max(1, int(padded.max()).bit_length())
        keys = []
        for lo in range(0, MODULUS, 62 // bits):
            key = np.zeros(len(place), np.int64)
            for t in range(lo, min(lo + 62 // bits, MODULUS)):
                key = key << bits | padded[place + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(place), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(len(place), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _neighbours(self, a: np.ndarray, b: np.ndarray, levels: list) -> np.ndarray:
        """Common prefix of suffixes next to each other: whole levels of equal rank, then fewer than MODULUS words."""
        n, far = len(self.w), np.zeros(len(a), np.int64)
        for step, rank in reversed(levels):
            x, y = self.at[np.minimum(a + far, n)], self.at[np.minimum(b + far, n)]
            far += step * ((x >= 0) & (y >= 0) & (rank[x] == rank[y]))
        return far + _agree(self.w, a + far, b + far, np.full(len(a), MODULUS), 1)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = _STEP[i % MODULUS, j % MODULUS]
        told = _agree(self.w, i, j, step, 1)
        some = np.flatnonzero(told == step)
        if len(some):
            a, b = self.rank[self.at[i[some] + step[some]]], self.rank[self.at[j[some] + step[some]]]
            told[some] += _range_least(self.table, np.minimum(a, b), np.maximum(a, b))
        return told


def _ranked(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate(([False], key[order][1:] != key[order][:-1])))
    return rank


def _least(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: least value of every range whose length is a power of two."""
    table, width = [values], 1
    while 2 * width <= len(values):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    return table


def _range_least(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least value of the ranges [lo, hi), none empty."""
    out = np.empty(len(lo), np.int64)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    for k in np.unique(level):
        some = level == k
        out[some] = np.minimum(table[k][lo[some]], table[k][hi[some] - (1 << int(k))])
    return out


def _joined(texts: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array, each between two numbers that occur nowhere else; and where each text begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(np.concatenate(([0], sizes[:-1] + 1))) + 1
    w = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    ends = np.concatenate((begin - 1, [len(w) - 1]))
    w[ends] = vocabulary + np.arange(len(ends))
    for t, a in zip(texts, begin):
        w[a : a + len(t)] = t
    return w, begin


def _grid(w: np.ndarray, begin: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i on the grid of each period q with equal words at i and i + q; texts stand in falling order of size."""
    places, periods = [], []
    for q in range(1, int(sizes.max(initial=0)) // times + 1):
        enough = int(np.searchsorted(-sizes, -max(least, times * q), side="right"))
        end = int(begin[enough - 1] + sizes[enough - 1]) if enough else 0
        if end <= q:
            break
        found = np.flatnonzero(w[0 : end - q : (times - 1) * q] == w[q : end : (times - 1) * q])
        if len(found):
            places.append(found * ((times - 1) * q))
            periods.append(np.full(len(found), q, np.int64))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + places), np.concatenate(none + periods)


def runs(texts: list[np.ndarray], vocabulary: int, least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """The runs of each text of numbers below ``vocabulary``: rows (start, length, period) by start, then period."""
    by_size = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    ordered = [texts[k] for k in by_size]
    w, begin = _joined(ordered, vocabulary)
    sizes = np.array([len(t) for t in ordered], np.int64)
    i, q = _grid(w, begin, sizes, least, times)
    text = np.searchsorted(begin, i, side="right") - 1
    one = i + q < (begin + sizes)[text] if len(sizes) else np.zeros(0, bool)  # both places in one text
    i, q, text = i[one], q[one], text[one]
    # The words up to the next place in the cover decide about nearly all.
    n = len(w)
    step_right, step_left = _STEP[i % MODULUS, (i + q) % MODULUS], _STEP[(n - i) % MODULUS, (n - i - q) % MODULUS]
    right, left = _agree(w, i, i + q, step_right, 1), _agree(w, i - 1, i + q - 1, step_left, -1)
    right_open, left_open = right == step_right, left == step_left
    keep = right_open | left_open | (left + right + q >= np.maximum(least, times * q))
    i, q, text, left, right, far = i[keep], q[keep], text[keep], left[keep], right[keep], (right_open | left_open)[keep]
    if far.any():
        some = np.unique(text[far])
        part, part_begin = _joined([ordered[k] for k in some], vocabulary)
        at = i[far] - begin[text[far]] + part_begin[np.searchsorted(some, text[far])]
        right[far] = Extensions(part)(at, at + q[far])
        left[far] = Extensions(np.ascontiguousarray(part[::-1]))(len(part) - at, len(part) - at - q[far])
    start, length = i - left, left + right + q
    keep = length >= np.maximum(least, times * q)
    text, start, length, q = text[keep], (start - begin[text])[keep], length[keep], q[keep]
    # A multiple of a period gives the same stretch; the smallest is the run's.
    order = np.lexsort((q, length, start, text))
    text, start, length, q = text[order], start[order], length[order], q[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, found = text[first], np.stack((start, length, q), 1)[first]
    by_period = np.lexsort((found[:, 2], found[:, 0], text))
    text, found = text[by_period], found[by_period]
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    out: list[np.ndarray] = [found[:0]] * len(texts)
    for k, was in enumerate(by_size):
        out[was] = found[cut[k] : cut[k + 1]]
    return out


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of a text that end at white space."""
    at = 0
    while len(raw) - at > PIECE:
        end = at + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _repeats(n: int, found: np.ndarray) -> np.ndarray:
    """Words that a run holds after its first period."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, found[:, 0] + found[:, 2], 1)
    np.add.at(mark, found[:, 0] + found[:, 1], -1)
    return np.cumsum(mark[:-1]) > 0


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
])
_OUT_DDL = "doc_id long, n_words long, kept string, runs array<struct<start:long,length:long,period:long>>"


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, kept, runs) of every row of docs.

    Words are what stands between ASCII white space. runs holds (start, length, period) in words, by start, then period;
    kept is the text without what a run repeats after its first period, words joined by one space. A text without a run
    keeps all its words. Null, empty and blank texts have no words, no runs and an empty kept text. Rows stand for
    themselves, equal ids and null ids too; an empty table gives no rows; other columns are not read. A task holds about
    a dozen times the bytes of one text, at least of PORTION bytes.
    """

    def work(batches):
        for batch in portions(batches, limit=PORTION):
            data, starts = utf8(batch.column(1))
            number: defaultdict = defaultdict()
            number.default_factory = number.__len__
            texts = []
            for a, b in zip(starts[:-1], starts[1:]):
                parts = [np.fromiter(map(number.__getitem__, piece.split()), np.int32) for piece in _pieces(data[a:b].tobytes())]
                texts.append(np.concatenate(parts))
            vocabulary = list(number)
            found = runs(texts, len(vocabulary), least, times)
            kept = []
            for t, r in zip(texts, found):
                t = t[~_repeats(len(t), r)] if len(r) else t
                kept.append(b" ".join(map(vocabulary.__getitem__, t.tolist())).decode())
            cut = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            columns = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(columns[:, k])) for k in range(3)], ["start", "length", "period"])
            yield rows_out(_OUT, doc_id=batch.column(0), n_words=[len(t) for t in texts], kept=kept, runs=pa.ListArray.from_arrays(cut, rows))

    return narrow(docs, id_col, text_col).mapInArrow(work, _OUT_DDL)


def digest(collapsed: DataFrame) -> DataFrame:
    """Of each row's runs: their number, the one of greatest length by period, and digests of the list and of the kept text."""
    best = F.expr(
        "element_at(array_sort(runs, (a, b) -> case when a.length * b.period > b.length * a.period then -1"
        " when a.length * b.period < b.length * a.period then 1 when a.start < b.start then -1 when a.start > b.start then 1"
        " when a.period < b.period then -1 when a.period > b.period then 1 else 0 end), 1)"
    )
    some = collapsed.withColumn("best", F.when(F.size("runs") > 0, best))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return some.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) in which one text in ten, by its id's CRC-32, has its words from some place on made periodic."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    split = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("words"))
    sized = split.withColumn("n", F.size("words")).withColumn("a", F.expr("case when n > 0 then g % n end"))
    timed = sized.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    cycle: Column = F.expr("flatten(array_repeat(slice(words, cast(a + 1 as int), cast(p as int)), cast((n - a + p - 1) div p as int)))")
    changed = F.slice(F.concat(F.expr("slice(words, 1, cast(a as int))"), cycle), 1, F.col("n"))
    return timed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))
