"""Main text of web pages: markup first, then a suffix array for each host.

A page is read into blocks in one scan over its tags. What the markup names as menu, footer, form, advert, comment and
the like is left out; the blocks of the largest article element, or else of the main element, are the candidate text,
and without either all that is left is.

Boilerplate that markup does not name repeats over a host. The token streams of a host's pages are concatenated and
their suffixes sorted by the first RUN tokens; a stretch of suffixes that agree in all of them is a substring repeated
across its distinct pages. Substrings on a large part of the host's pages cover boilerplate: blocks they cover are
removed, unique runs stay. Pages of equal text count as one. The part is larger inside an article, so that
paragraphs that some articles share, or articles copied a few times, stay whole.

A host with very many pages is counted in shards of distinct pages, dealt by a hash of their text. A page is of one
shard, so counts of shards add up to the host's, and a substring on a given part of the host's pages is on that part of
some shard's at least. Shards name those; the pages of all shards that hold them are then counted, and every page of the
host is held against the same substrings. The result does not depend on the size of a shard, but for collisions of 64-bit
hashes of substrings.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stage
from .text import let_go, rows_out, shingle_hash, span_hash, utf8, word_spans
from .url_list import host_of

#: Tokens of a repeated substring, and the part of a block that substrings must cover.
RUN, COVER = 6, 0.8
#: Part of a host's distinct pages that makes a substring boilerplate, inside an article or main element and elsewhere;
#: and the fewest pages.
WITHIN, ELSEWHERE, LEAST_PAGES = 0.5, 0.3, 4
#: Pages of a host's shard, and the most hosts that may have more than one; rows a Python task reads at a time, and
#: the pages that a task remembers to send only once.
SHARD_PAGES, LARGE_HOSTS = 256, 200_000
ROWS, REMEMBERED = 500, 100_000

# Fixed values of the markup language: elements whose content is no text, elements without content, elements that are
# no part of a sentence, and elements that are not the main text.
RAW = "script style noscript template iframe textarea title svg canvas object select noframes".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
ASIDE = frozenset("head nav footer aside form button menu dialog fieldset audio video".split())
#: Words of class, id and role that name parts other than the main text; those of the second list do so outside articles.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar "
    "sidenav related recommended recommendations share sharing social comment comments commentlist disqus reply replies "
    "respond breadcrumb breadcrumbs menu nav navbar navigation footer colophon widget widgets pagination pager login "
    "search skip complementary contentinfo toolbar".split()
)
NAMED_OUTSIDE = frozenset("header masthead topbar top hero toc".split())
#: Words of NAMED that also head sections of an article ("related-work", "share-prices"): inside one they count only in a
#: name made of such words and words of layout alone.
UNSURE = frozenset(
    "ad ads promotion banner consent notice notices alert related recommended recommendations share sharing social comment comments reply "
    "replies respond menu navigation search skip login subscription complementary".split()
)
LAYOUT = frozenset(
    "area article articles bar block body bottom box btn button buttons card center col column container content element first frame grid "
    "group head header heading icon icons id inline inner item items js large last left link links list main mobile module news outer page "
    "pane panel part post posts primary right row secondary section side site slot small sticky stories story strip tab tabs text thread "
    "title tool tools top unit view wrap wrapper zone".split()
)

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[/a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")


def _left_out(name: str, rest: str, inside: bool) -> bool:
    if name in ASIDE or name == "header" and not inside:
        return True
    if not rest or name in ("html", "body", "article", "main"):
        return False
    for m in _NAMES.finditer(rest):
        for word in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _PART.findall(word)
            if not inside:
                if any(p in NAMED or p in NAMED_OUTSIDE for p in parts):
                    return True
                continue
            named = [p for p in parts if p in NAMED]
            if named and (any(p not in UNSURE for p in named) or all(p in NAMED or p in LAYOUT for p in parts)):
                return True
    return bool(_HIDDEN.search(rest))


def blocks(page: str | None) -> tuple[bool, list[str]]:
    """Candidate blocks of a page in page order, and whether an article or main element holds them.

    Character references are decoded and white space in a block is one space. Unclosed and crossing elements end where
    an outer one ends; the start of an article ends an element left open before it.
    """
    page = page or ""
    found: dict[int, list[str]] = {}
    held: list[str] = []
    open_: list[str] = []
    region, articles = 0, 0  # 0 outside, -1 in main, from 1 the articles
    out_at = 0  # depth at which an element that is left out began; 0: none
    at = 0

    def flush():
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            found.setdefault(region, []).append(text)

    for m in _MARK.finditer(page):
        if not out_at and m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["raw"] or "").lower()
        if not name or m["raw"]:
            if m["raw"] and not out_at:
                held.append(" ")
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            held.append(" ")
        if m["end"]:
            if name in open_:
                while open_.pop() != name:
                    pass
                if len(open_) < out_at:
                    out_at = 0
                if region > 0 and "article" not in open_:
                    region = -1 if "main" in open_ else 0
                elif region < 0 and "main" not in open_:
                    region = 0
            continue
        if name in VOID or m["rest"].endswith("/"):
            continue
        if name in ("article", "main") and region <= 0 and out_at and open_[out_at - 1] not in ("aside", "form", "footer"):
            out_at = 0
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and open_ and open_[-1] == name:
            open_.pop()
            if len(open_) < out_at:
                out_at = 0
        open_.append(name)
        if not out_at and _left_out(name, m["rest"], region != 0):
            out_at = len(open_)
        if not out_at and name == "article" and region <= 0:
            articles += 1
            region = articles
        elif not out_at and name == "main" and region == 0:
            region = -1
    if not out_at:
        held.append(page[at:])
    flush()
    size = lambda k: sum(map(len, found[k]))
    best = max((k for k in found if k > 0), key=size, default=-1)
    return (True, found[best]) if best in found else (False, found.get(0, []))


def repeated(pages: list[list[str]]) -> list[list[tuple[float, int]]]:
    """For each block of each page of one host: (largest part of the distinct pages that its substrings cover, pages).

    The part is that of the least common substring among those that cover COVER of the block.
    """
    words = [[b.split() for b in p] for p in pages]
    sizes = [[len(b) for b in p] for p in words]
    flat = [w for p in words for b in p for w in b]
    if not flat:
        return [[(0.0, 0)] * len(p) for p in pages]
    number: dict[str, int] = {}
    token = np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int64, len(flat))
    page = np.repeat(np.arange(len(pages)), [sum(s) for s in sizes])
    # Pages of equal text are one page.
    same: dict[tuple[str, ...], int] = {}
    face = np.array([same.setdefault(tuple(p), len(same)) for p in pages])
    # Ranks of suffixes by their first 1, 2, 4, ... tokens up to RUN; a page's end sorts before every token.
    rank, width = token + 1, 1
    end = np.searchsorted(page, page, side="right")
    place = np.arange(len(token))
    while width < RUN:
        step = min(width, RUN - width)
        later = np.where(place + step < end, rank[np.minimum(place + step, len(rank) - 1)], 0)
        _, rank = np.unique(rank * (len(token) + 2) + later, return_inverse=True)
        rank, width = rank + 1, width + step
    order = np.lexsort((face[page], rank))
    r, f = rank[order], face[page][order]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    fresh = new.copy()
    fresh[1:] |= f[1:] != f[:-1]
    group = np.cumsum(new) - 1
    count = np.bincount(group, weights=fresh)[group]
    pages_of = np.zeros(len(r), np.int64)
    pages_of[order] = count
    pages_of[place + RUN > end] = 1  # a shorter suffix is no long substring
    # Most pages that share a substring over each token.
    over = pages_of.copy()
    for back in range(1, RUN):
        over[back:] = np.maximum(over[back:], np.where(page[back:] == page[:-back], pages_of[:-back], 0))
    out, at = [], 0
    for p in sizes:
        told = []
        for n in p:
            seen = np.sort(over[at : at + n])[::-1]
            least = int(seen[max(0, int(np.ceil(COVER * n)) - 1)]) if n else 0
            told.append((least / len(same), least))
            at += n
        out.append(told)
    return out


def face_of(held: list[str]) -> bytes:
    """Digest of a page's blocks: pages of equal text have the same."""
    digest = hashlib.blake2b(digest_size=16)
    for b in held:
        raw = b.encode()
        digest.update(len(raw).to_bytes(8, "little") + raw)
    return digest.digest()


def substrings(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the RUN tokens from each token on, whether they are of one text, and the text of every token."""
    data, starts = utf8(pa.array(texts, pa.large_string()))
    begin, end, text = word_spans(data, starts)
    hashes = shingle_hash(span_hash(data, begin, end), RUN).view(np.int64)
    return hashes, text[: len(hashes)] == text[len(text) - len(hashes) :], text


def often(texts: list[str], part: float) -> np.ndarray:
    """Substrings on ``part`` of the texts or more, which are distinct."""
    hashes, whole, text = substrings(texts)
    h, t = hashes[whole], text[: len(hashes)][whole]
    order = np.lexsort((t, h))
    h, t = h[order], t[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    values, count = np.unique(h[fresh], return_counts=True)
    return values[count / len(texts) >= part]


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Is each value in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _parsed(batches):
    """The rows of pages a few at a time with their blocks; html is the first column."""
    let_go()
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, [blocks(h) for h in part.column(0).to_pylist()]


def _unseen(seen: set, host: str, face: bytes) -> bool:
    if (host, face) in seen:
        return False
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add((host, face))
    return True


def _numbers(column: pa.Array, k: int) -> np.ndarray:
    at = column[k]
    return at.values.to_numpy() if at.is_valid else np.zeros(0, np.int64)


def shared_substrings(pages: DataFrame) -> DataFrame:
    """(host, within, elsewhere): sorted hashes of the substrings on WITHIN and on ELSEWHERE of a host's distinct pages.

    ``pages`` has html, host and cuts, the number of shards of the host. Hosts without such a substring have no row.
    """
    least = min(WITHIN, ELSEWHERE)
    sent = pa.schema([("host", pa.string()), ("shard", pa.int64()), ("face", pa.binary()), ("words", pa.binary())])
    named = pa.schema([("host", pa.string()), ("faces", pa.int64()), ("at", pa.list_(pa.int64()))])
    marked = pa.schema([("host", pa.string()), ("face", pa.binary()), ("bits", pa.binary())])
    counted = pa.schema([("host", pa.string()), ("place", pa.int64()), ("n", pa.int64())])

    def send(batches):
        seen: set = set()
        for part, got in _parsed(batches):
            out = []
            for host, cuts, (_, held) in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), got):
                face = face_of(held)
                if _unseen(seen, host, face):
                    out.append((host, int.from_bytes(face[:7], "little") % cuts, face, zlib.compress(" ".join(held).encode(), 1)))
            yield rows_out(sent, **{f.name: [x[i] for x in out] for i, f in enumerate(sent)})

    def name(batches):
        # Rows come in the order of host, shard and face.
        key, last, texts = None, None, []

        def told():
            return rows_out(named, host=[key[0]], faces=[len(texts)], at=[often(texts, least)])

        let_go()
        for batch in batches:
            for host, shard, face, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (host, shard) != key:
                    if texts:
                        yield told()
                    key, last, texts = (host, shard), None, []
                if face != last:
                    last = face
                    texts.append(zlib.decompress(words).decode())
        if texts:
            yield told()

    shards = pages.select("html", "host", "cuts").mapInArrow(send, "host string, shard long, face binary, words binary")
    shards = shards.repartition("host", "shard").sortWithinPartitions("host", "shard", "face")
    named_rows = shards.mapInArrow(name, "host string, faces long, at array<long>")
    asked = named_rows.groupBy("host").agg(F.sum("faces").alias("faces"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    asked = stage(asked.where(F.size("at") > 0), "asked")

    def mark(batches):
        seen: set = set()
        for part, got in _parsed(batches):
            hosts, faces = part.column(1).to_pylist(), [face_of(g[1]) for g in got]
            new = [k for k in range(len(got)) if _unseen(seen, hosts[k], faces[k])]
            hashes, whole, text = substrings([" ".join(got[k][1]) for k in new])
            cut = np.searchsorted(text[: len(hashes)], np.arange(len(new) + 1))
            bits = []
            for i, k in enumerate(new):
                own = slice(cut[i], cut[i + 1])
                bits.append(np.packbits(_among(_numbers(part.column(2), k), np.unique(hashes[own][whole[own]]))).tobytes())
            yield rows_out(marked, host=[hosts[k] for k in new], face=[faces[k] for k in new], bits=bits)

    def add(batches):
        let_go()
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for host, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8))
                if host in sums:
                    sums[host] += one
                else:
                    sums[host] = one.astype(np.int64)
            for host, n in sums.items():
                place = np.flatnonzero(n)
                yield rows_out(counted, host=[host] * len(place), place=place, n=n[place])

    held = pages.select("html", "host").join(asked, "host").select("html", "host", "at").mapInArrow(mark, "host string, face binary, bits binary")
    once = held.groupBy("host", "face").agg(F.max("bits").alias("bits")).select("host", "bits")
    sums = once.mapInArrow(add, "host string, place long, n long").groupBy("host", "place").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES)
    sums = sums.groupBy("host").agg(F.collect_list(F.struct("place", "n")).alias("got")).join(asked, "host")

    def on(part: float):
        kept = F.filter("got", lambda x: x["n"] / F.col("faces") >= F.lit(part))
        return F.array_sort(F.transform(kept, lambda x: F.get("at", x["place"].cast("int"))))

    return stage(sums.select("host", on(WITHIN).alias("within"), on(ELSEWHERE).alias("elsewhere")), "shared")


def _kept(held: list[tuple[bool, list[str]]], limits: list[np.ndarray]) -> list[str]:
    """Texts of pages without the blocks that the substrings of their ``limits`` cover."""
    hashes, whole, text = substrings([" ".join(g[1]) for g in held])
    cut = np.searchsorted(text[: len(hashes)], np.arange(len(held) + 1))
    begins = np.zeros(len(text) + 1, np.int64)
    for k, table in enumerate(limits):
        own = slice(cut[k], cut[k + 1])
        begins[own] = _among(hashes[own], table) & whole[own]
    run = np.concatenate((np.zeros(RUN, np.int64), np.cumsum(begins)))
    over = run[RUN : RUN + len(text)] > run[: len(text)]
    sizes = [b.count(" ") + 1 for g in held for b in g[1]]
    covered = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=over, minlength=len(sizes))
    gone = iter((covered >= np.ceil(COVER * np.array(sizes, np.int64))).tolist())
    return ["\n\n".join([b for b in g[1] if not next(gone)]) for g in held]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: blocks of the main text joined by an empty line.

    Null pages, and pages without main text, have an empty text. Pages without a host are of one host of that kind.
    Repeated rows stay.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    counts = stage(rows.groupBy("host").count(), "hosts")
    total, greatest = counts.agg(F.sum("count"), F.max("count")).first()
    # At most LARGE_HOSTS hosts can have more pages than this.
    most = max(SHARD_PAGES, -(-(total or 0) // LARGE_HOSTS))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("within", pa.bool_()), ("blocks", pa.list_(pa.string()))])
    final = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    out = "page_id long, url string, text string, n_chars long"

    def read(batches):
        for part, got in _parsed(batches):
            yield rows_out(schema, page_id=part.column(1), url=part.column(2), host=part.column(3), within=[g[0] for g in got], blocks=[g[1] for g in got])

    def clean(group: pa.Table) -> pa.Table:
        held = group.column("blocks").to_pylist()
        texts = []
        for within, own, told in zip(group.column("within").to_pylist(), held, repeated(held)):
            limit = WITHIN if within else ELSEWHERE
            texts.append("\n\n".join(b for b, (part, n) in zip(own, told) if n < LEAST_PAGES or part < limit))
        return pa.Table.from_batches([rows_out(final, page_id=group.column("page_id").combine_chunks(), url=group.column("url").combine_chunks(), text=texts, n_chars=[len(t) for t in texts])])

    def finish(batches):
        for part, got in _parsed(batches):
            limits = [_numbers(part.column(3 if g[0] else 4), k) for k, g in enumerate(got)]
            texts = _kept(got, limits)
            yield rows_out(final, page_id=part.column(1), url=part.column(2), text=texts, n_chars=[len(t) for t in texts])

    def whole_hosts(some: DataFrame) -> DataFrame:
        read_rows = some.select("html", "page_id", "url", "host").mapInArrow(read, "page_id long, url string, host string, within boolean, blocks array<string>")
        return read_rows.groupBy("host").applyInArrow(clean, out)

    if (greatest or 0) <= most:
        return whole_hosts(rows)
    large = stage(counts.where(F.col("count") > most).select("host", F.ceil(F.col("count") / most).cast("long").alias("cuts")), "large")
    shared = shared_substrings(rows.join(large, "host"))
    cut_hosts = rows.join(large.select("host"), "host", "left_semi").join(shared, "host", "left").select("html", "page_id", "url", "within", "elsewhere").mapInArrow(finish, out)
    return whole_hosts(rows.join(large.select("host"), "host", "left_anti")).union(cut_hosts)
