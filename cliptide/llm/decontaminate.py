"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For an item of w words, every window of w words of a document is a candidate place if eight ninths of its shingles are
those of an item of that size; with fewer the similarity is below 0.8, so nothing is lost. The window's SimHash over its shingles is
compared with the items through blocks of bits: two fingerprints at most RADIUS bits apart are at most RADIUS / BLOCKS
bits apart in some block, so only items that near in a block are looked at. What is within the radius is
verified by the weighted Jaccard similarity of the two shingle multisets, exactly.

Most texts share no shingle with any item. They are told away first, many texts at a time (``Shard.suspects``).

Items travel in shards of bounded size. A shard is broadcast and the documents are scanned once for each shard, so a
benchmark of any size is covered; one that fits a shard needs one scan and no shuffle of texts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SLICE_CHARS, mix, narrow, portions, rows_out, shingle_hash, slices, span_hash

#: Words of a shingle and the least similarity of a match.
WORDS, SIMILAR = 5, 0.8
#: Similarity 0.8 puts two fingerprints about 10 of 64 bits apart, with a spread of 3: 22 is four spreads beyond.
RADIUS, BLOCKS = 22, 4
#: Bytes of item text in one broadcast shard.
SHARD_BYTES = 4_000_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@lru_cache(1)
def _in_words() -> np.ndarray:
    """For each code point: do words have it."""
    out = np.zeros(0x110000, bool)
    every = np.arange(len(out), dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    for m in _WORD.finditer(every):
        out[m.start() : m.end()] = True
    return out


def shared_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of every shingle of WORDS words of several texts, the text of each, and the number of words of each text.

    The words are those of ``words``. Equal shingles have equal hashes, which are quicker than those of ``shingles`` and
    tell only where to look.
    """
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.flatnonzero(np.diff(_in_words()[code], prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    row = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), begin, side="right")
    whole = row[WORDS - 1 :] == row[: max(0, len(row) - WORDS + 1)]
    return shingle_hash(span_hash(code, begin, end), WORDS)[whole], row[WORDS - 1 :][whole], np.bincount(row, minlength=len(texts))


def _among(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``values``, which are not none."""
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


class Filter:
    """Low bits of hashes, so that most others are told away by one look."""

    def __init__(self, hashes: np.ndarray):
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._low(hashes)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.seen[self._low(h)])

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << 20) - 1)).astype(np.int64)


def word_hashes(tokens: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hash of each word; ``known`` is a small memory of recent words."""
    if len(known) > 200_000:
        known.clear()
    out = np.empty(len(tokens), np.uint64)
    for i, w in enumerate(tokens):
        h = known.get(w)
        if h is None:
            h = known[w] = int.from_bytes(_digest(w), "little")
        out[i] = h
    return out


def _digest(word: str) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(word.encode("utf-8", "surrogatepass"), 5)


def shingles(h: np.ndarray) -> np.ndarray:
    """Hash of every shingle; fewer words than a shingle make one shingle of all."""
    if not len(h):
        return h
    width = min(WORDS, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j]
    return mix(out, width)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _packed(votes: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * votes > n, axis=1).view(">u8").reshape(-1).astype(np.uint64)


class Shard:
    """Items of one shard with their fingerprints, block tables, and the shingles that lead to them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = []
        self.short: dict[tuple[str, ...], list[int]] = {}
        of: list[tuple[int, int]] = []
        known: dict[str, int] = {}
        for item, text in items:
            w = words(text)
            if not w:
                continue
            if len(w) < WORDS:
                self.short.setdefault(tuple(w), []).append(item)
                continue
            s = shingles(word_hashes(w, known))
            values, count = np.unique(s, return_counts=True)
            print_ = int(_packed(_bits(s).sum(axis=0, dtype=np.int64)[None], len(s))[0])
            of += [(int(v), len(self.items)) for v in values]
            self.items.append((item, len(w), values, count, print_))
        of.sort()
        self.shingle = np.array([v for v, _ in of], np.uint64)
        self.owner = np.array([i for _, i in of], np.int64)
        self.prints = np.array([x[4] for x in self.items], np.uint64)
        self.size = np.array([x[1] for x in self.items], np.int64)
        self.filter = Filter(self.shingle)
        self.of_size = {n: np.unique(self.shingle[self.size[self.owner] == n]) for n in np.unique(self.size).tolist()}
        texts = [text for _, text in items]
        shared = [shared_shingles(texts[lo:hi])[0] for lo, hi in slices([len(t) for t in texts])]
        self.shared = np.unique(np.concatenate([np.zeros(0, np.uint64), *shared]))
        self.shared_filter = Filter(self.shared)
        width = 64 // BLOCKS
        self.blocks = [(self.prints >> np.uint64(b * width)).astype(f"u{width // 8}") for b in range(BLOCKS)]

    def suspects(self, texts: list[str | None]) -> np.ndarray:
        """Places of the texts that share a shingle with an item, or are short where an item is; no other holds an item.

        Texts longer than a slice are not looked into here and are suspects, so that memory does not follow their length.
        """
        found = np.array([len(t or "") > SLICE_CHARS for t in texts], bool)
        texts = [None if long else t for t, long in zip(texts, found.tolist())]
        for lo, hi in slices([len(t or "") for t in texts]):
            shingle, row, count = shared_shingles(texts[lo:hi])
            if self.short:
                found[lo:hi] |= (count > 0) & (count < WORDS)
            if len(self.shared):
                at = self.shared_filter.places(shingle)
                found[lo + row[at[_among(self.shared, shingle[at])]]] = True
        return np.flatnonzero(found)

    def near_items(self, fingerprint: int) -> np.ndarray:
        """Items whose fingerprint is within RADIUS, through the blocks."""
        width = 64 // BLOCKS
        near = np.zeros(len(self.prints), bool)
        for b, block in enumerate(self.blocks):
            mine = block.dtype.type((fingerprint >> (b * width)) & ((1 << width) - 1))
            near |= np.bitwise_count(block ^ mine) <= RADIUS // BLOCKS
        at = np.flatnonzero(near)
        return at[np.bitwise_count(self.prints[at] ^ np.uint64(fingerprint)) <= RADIUS]

    def matches(self, text: str | None, known: dict[str, int]) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, end word) of the best window for each item found in a whole text."""
        w = words(text)
        if len(w) < WORDS:
            return [(i, 1.0, 0, len(w)) for i in self.short.get(tuple(w), ())] if w else []
        if not len(self.shingle):
            return []
        s = shingles(word_hashes(w, known))
        places = self.filter.places(s)
        if not len(places):
            return []
        lo = np.searchsorted(self.shingle, s[places])
        hi = np.searchsorted(self.shingle, s[places], side="right")
        n = hi - lo
        if not n.any():
            return []
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item = self.owner[at]
        best: dict[int, tuple[float, int, int]] = {}
        for size in np.unique(self.size[item]).tolist():
            wide = min(size, len(w)) - WORDS + 1  # shingles of a window
            total = np.concatenate(([0], np.cumsum(self._hits(s, size), dtype=np.int64)))
            # At 0.8, eight ninths of a window's shingles, repeats included, are also the item's.
            first = np.flatnonzero(9 * (total[wide:] - total[:-wide]) >= 8 * wide)
            for begin in np.array_split(first, max(1, len(first) * wide // 200_000)):
                if not len(begin):
                    continue
                votes = self._votes(s, begin, wide)
                for at_word, mark in zip(begin.tolist(), _packed(votes, wide).tolist()):
                    window = None
                    for k in self.near_items(mark).tolist():
                        if self.size[k] != size:
                            continue
                        if window is None:
                            window = np.unique(s[at_word : at_word + wide], return_counts=True)
                        like = weighted_jaccard(window, self.items[k][2:4])
                        if like >= SIMILAR and (k not in best or like > best[k][0]):
                            best[k] = (like, at_word, at_word + wide + WORDS - 1)
        return [(self.items[k][0], *v) for k, v in sorted(best.items())]

    def _hits(self, s: np.ndarray, size: int) -> np.ndarray:
        """For each place of a text: is its shingle one of an item of this size."""
        return _among(self.of_size[size], s)

    @staticmethod
    def _votes(s: np.ndarray, begin: np.ndarray, wide: int) -> np.ndarray:
        """Set bits, by bit, of the windows that begin at ``begin``; only what windows cover is summed, however far apart."""
        new = np.ones(len(begin), bool)
        new[1:] = np.diff(begin) > wide
        head = np.flatnonzero(new)
        low, run = begin[head], np.cumsum(new) - 1
        length = begin[np.append(head[1:], len(begin)) - 1] + wide - low
        at = np.cumsum(length) - length
        covered = np.repeat(low - at, length) + np.arange(length.sum())
        sums = np.zeros((len(covered) + 1, 64), np.int32)
        np.cumsum(_bits(s[covered]), axis=0, out=sums[1:])
        here = at[run] + begin - low[run]
        return sums[here + wide] - sums[here]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater; a shingle's weight is how often it occurs."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = np.minimum(np.where(b[0][at] == a[0], b[1][at], 0), a[1]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def shards(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES):
    """The items, a shard of about ``shard_bytes`` at a time; an item without text or id has nothing to be found."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = max(1, -(-2 * size // shard_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield Shard([(r["item_id"], r["text"]) for r in part.collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, word_start, word_end): each item found in each document, at its best window.

    Words are runs of letters, digits and underscores without case. Items under five words are found only in a document
    that has the same words and no others. Null and empty texts hold nothing; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("word_start", pa.int64()), ("word_end", pa.int64())])
    rows = narrow(docs, id_col, text_col)
    out = None
    for shard in shards(benchmark, item_col, shard_bytes=shard_bytes):
        shared = spark.sparkContext.broadcast(shard)

        def run(batches, shared=shared):
            known: dict[str, int] = {}
            for batch in portions(batches):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = [(ids[i], *m) for i in shared.value.suspects(texts).tolist() for m in shared.value.matches(texts[i], known)]
                yield rows_out(schema, **{f.name: [x[i] for x in found] for i, f in enumerate(schema)})

        part = rows.mapInArrow(run, "doc_id long, item_id long, similarity double, word_start long, word_end long")
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs``, all columns, without the documents that hold a benchmark item; decided in the scan, without a join."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for shard in shards(benchmark, shard_bytes=shard_bytes):
        shared = spark.sparkContext.broadcast(shard)

        def run(batches, shared=shared):
            known: dict[str, int] = {}
            for batch in portions(batches, at):
                texts, clean = batch.column(at).to_pylist(), np.ones(len(batch), bool)
                for i in shared.value.suspects(texts).tolist():
                    clean[i] = not shared.value.matches(texts[i], known)
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
