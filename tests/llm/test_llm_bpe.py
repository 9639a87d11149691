import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cliptide.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
WANT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aaeinst  \n\t'!0é日😀"))), max_size=60))
def test_ids_are_the_library_s(text):
    c = bpe.codec(PATH, P.PATTERN)
    ids = c.encode(text)
    assert ids == WANT.encode_ordinary(text)
    assert c.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=5))
def test_utf8_stream_in_any_cuts(raw, cuts):
    s, at, out = bpe.Utf8Stream(), 0, ""
    for c in sorted(min(c, len(raw)) for c in cuts) + [len(raw)]:
        out += s.push(raw[at:c])
        at = c
    assert out + s.finish() == raw.decode("utf-8", "replace")


def test_small_memory_gives_the_same_ids():
    fst = bpe.Transducer(bpe.read_ranks(PATH), keep=20)
    for word in ("unbelievable", "aaaaaaaaaaaaaaaaaaaaa", "donaudampfschifffahrt") * 3:
        assert fst.encode(word.encode()) == WANT.encode_ordinary(word)


def test_digest_and_round_trip(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    got = bpe.digest(odd, PATH, P.PATTERN).collect()
    want = []
    for r in rows:
        ids = WANT.encode_ordinary(r.text or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    back = bpe.decode(bpe.encode(odd, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in rows)
    assert bpe.digest(empty, PATH, P.PATTERN).count() == 0
