"""Byte-level BPE as a lazily determinised finite-state transducer, with streaming decode.

The nondeterministic transducer reads bytes. One of its states is (last token written, bytes read of the next token);
it may write a token when the bytes form one and the pair (last token, token) is stable, that is, merging its joined
bytes gives the pair back. A token sequence is the BPE of its bytes exactly when all its neighbours are stable pairs, so
for every prefix one path, and one only, stands at a token boundary.

The deterministic transducer's state is the set of live paths with what each has still to write. The bytes that a path
has read are a suffix of the input that begins some longer token, so the longest of them, the place, gives them all: a
state is a place and one (last token, what is to write) for each path, oldest first. Which paths stay open after a byte
and which close a token follow from place and byte alone and are found once (an arc); a move has only to ask the closing
paths, longest first, for the one whose pair is stable. Output that all live paths share is written at once: a token
leaves after a lookahead of at most the longest token. Arcs, states and moves are made when first met and kept up to a
bound, so memory does not grow with the corpus.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import KEPT, narrow, rows_out

#: Transitions and whole matches kept by one Python worker before it starts anew.
KEEP_TRANSITIONS = 300_000
KEEP_MATCHES = 500_000
#: Ids decoded at a time by the streaming decoder.
DECODE_CHUNK = 65_536


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes one match of the pattern at a time; a match that is itself a token is that token."""

    def __init__(self, ranks: dict[bytes, int], keep: int = KEEP_TRANSITIONS):
        self.ranks, self.keep = ranks, keep
        self.piece = {i: t for t, i in ranks.items()}
        #: What a longer token begins with.
        self.open: set[bytes] = {t[:n] for t in ranks for n in range(len(t))}
        self.stable: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self._clear()

    def _clear(self) -> None:
        #: Places by number: their bytes, and where in them the open paths start, oldest first.
        self.places: list[tuple[bytes, tuple[int, ...]]] = [(b"", (0,))]
        self.place_number = {b"": 0}
        #: By place and byte: the next place, (path, token) for what closes, longest first, and the paths that stay open.
        self.arcs: dict[int, tuple[int, list[tuple[int, int]], list[int]]] = {}
        self._clear_states()

    def _clear_states(self) -> None:
        start = (0, ((-1, ()),))
        self.number = {start: 0}
        self.states: list[tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]] = [start]
        #: By state and byte: the next state, with the ids written if there are any.
        self.moves: dict[int, int | tuple[int, tuple[int, ...]]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte or a token that merging never reaches."""
        if token not in self.split:
            b, parts = self.piece[token], [self.piece[token][i : i + 1] for i in range(len(self.piece[token]))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 and len(b) > 1 else None
        return self.split[token]

    def reached(self, token: int) -> bool:
        return len(self.piece[token]) == 1 or self.halves(token) is not None

    def pair_ok(self, last: int, token: int) -> bool:
        """Undo the merges of both sides, latest first; the pair is stable if at no time a token across the border comes first.

        A merge across the border comes before a later merge of its left part, and before one of its right part
        also at equal rank, as the leftmost of equal ranks goes first.
        """
        if last < 0:
            return self.reached(token)
        key = last << 32 | token
        ok = self.stable.get(key)
        if ok is None:
            ok = self.reached(token)
            left, right, before = last, token, 1 << 60
            rank, piece, split = self.ranks.get, self.piece, self.split
            while ok:
                if rank(piece[left] + piece[right], 1 << 60) < before:
                    ok = False
                    break
                one = split[left] if left in split else self.halves(left)
                two = split[right] if right in split else self.halves(right)
                if one is None and two is None:
                    break
                if two is None or one is not None and left > right:
                    left, before = one[1], left
                else:
                    right, before = two[0], right + 1
            if len(self.stable) >= self.keep:
                self.stable.clear()
            self.stable[key] = ok
        return ok

    def _arc(self, place: int, byte: int) -> tuple[int, list[tuple[int, int]], list[int]]:
        read, starts = self.places[place]
        read += bytes((byte,))
        closing, staying = [], []
        for path, start in enumerate(starts):
            token = self.ranks.get(read[start:])
            if token is not None and self.reached(token):
                closing.append((path, token))
            if read[start:] in self.open:
                staying.append(path)
        base = starts[staying[0]] if staying else len(read)
        target = self.place_number.get(read[base:])
        if target is None:
            target = self.place_number[read[base:]] = len(self.places)
            self.places.append((read[base:], (*(starts[path] - base for path in staying), len(read) - base)))
        arc = self.arcs[place << 8 | byte] = (target, closing, staying)
        return arc

    def _move(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        place, live = self.states[state]
        arc = self.arcs.get(place << 8 | byte)
        if arc is None:
            arc = self._arc(place, byte)
        target_place, closing, staying = arc
        known = self.stable.get
        for path, token in closing:
            last, out = live[path]
            ok = known(last << 32 | token)
            if ok or ok is None and self.pair_ok(last, token):
                break
        else:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        paths = [live[path] for path in staying]
        paths.append((token, (*out, token)))
        shared, low = 0, paths[0][1]
        if low:  # else the oldest path waits for nothing, and nothing is shared
            outs = [out for _, out in paths]
            low, high = min(outs), max(outs)
            while shared < len(low) and low[shared] == high[shared]:
                shared += 1
            if shared:
                paths = [(last, out[shared:]) for last, out in paths]
        key = (target_place, tuple(paths))
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.states)
            self.states.append(key)
        step = self.moves[state << 8 | byte] = (target, low[:shared]) if shared else target
        return step

    def encode(self, match: bytes) -> list[int]:
        whole = self.ranks.get(match)
        if whole is not None:
            return [whole]
        if len(self.arcs) > self.keep:
            self._clear()
        elif len(self.moves) > self.keep:
            self._clear_states()
        state, out, known = 0, [], self.moves.get
        for byte in match:
            step = known(state << 8 | byte)
            if step is None:
                step = self._move(state, byte)
            if type(step) is tuple:
                state, ids = step
                out.extend(ids)
            else:
                state = step
        out.extend(self.states[state][1][-1][1])  # the newest path stands at a token boundary
        return out


class Utf8Stream:
    """Incremental UTF-8: takes bytes in any cuts, gives the text known so far; a broken sequence becomes U+FFFD.

    The state is the bytes of an open sequence, three at most.
    """

    def __init__(self):
        self.open = b""

    def push(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 != 0x80:
                width = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
                if width > back:
                    cut -= back
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def decode_stream(chunks: Iterable[Iterable[int]], piece: dict[int, bytes]) -> Iterator[str]:
    """Text of a stream of id chunks; a character may start in one chunk and end in a later one."""
    stream = Utf8Stream()
    for ids in chunks:
        yield stream.push(b"".join([piece[i] for i in ids]))
    yield stream.finish()


class Codec:
    """The transducer behind the pattern that cuts a text, with the recent matches kept."""

    def __init__(self, rank_path: str, pattern: str):
        self.fst = Transducer(read_ranks(rank_path))
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.decimal = {i: str(i) for i in self.fst.piece}

    def _new(self, match: str) -> tuple[int, ...]:
        if len(self.known) >= KEEP_MATCHES:
            self.known.clear()
        ids = tuple(self.fst.encode(match.encode()))
        if len(match) <= 64:
            self.known[match] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, new = self.known.get, self._new
        return [i for m in self.find(text) for i in (get(m) or new(m))]

    def decode(self, ids: list[int]) -> str:
        cuts = (ids[i : i + DECODE_CHUNK] for i in range(0, len(ids), DECODE_CHUNK))
        return "".join(decode_stream(cuts, self.fst.piece))


def codec(rank_path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    key = (rank_path, pattern)
    if key not in KEPT:
        KEPT[key] = Codec(*key)
    return KEPT[key]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text; null and empty texts have no ids. Needs no shuffle.

    ``rank_path`` must be readable on every worker, like any installed file.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        c = codec(rank_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield rows_out(schema, doc_id=part.column(0), ids=[c.encode(t or "") for t in part.column(1).to_pylist()])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids) by the streaming decoder."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        c = codec(rank_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield rows_out(schema, doc_id=part.column(0), text=[c.decode(i or []) for i in part.column(1).to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode and digest in one pass over the texts.

    Null and empty texts give no ids and the digest of no bytes. Repeated rows give repeated results.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        gc.disable()  # the tables hold no cycles, and scanning them again and again is most of a task's time
        try:
            c = codec(rank_path, pattern)
            decimal = c.decimal
            sha = lambda raw: hashlib.sha256(raw).hexdigest()
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    n, a, b = [], [], []
                    for text in part.column(1).to_pylist():
                        ids = c.encode(text or "")
                        n.append(len(ids))
                        a.append(sha(",".join([decimal[i] for i in ids]).encode()))
                        b.append(sha(c.decode(ids).encode()))
                    yield rows_out(schema, doc_id=part.column(0), n_tokens=n, ids_sha256=a, decoded_sha256=b)
        finally:
            gc.enable()

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
