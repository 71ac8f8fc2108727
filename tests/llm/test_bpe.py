import base64
import struct

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import bpe
from tests.llm import brute

RAW = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MODEL = bpe.model(RAW, P.PATTERN)


def ids(text):
    return list(struct.unpack(f"<{len(x) // 4}I", x)) if (x := MODEL.encode(text)) else []


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=80))
def test_any_text_encodes_as_the_library_does_and_decodes(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert MODEL.decode(MODEL.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyzéß' 01\n", max_size=200))
def test_words_encode_as_the_library_does(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_long_runs():
    for text in ("a" * 5000, "ab" * 3000, " " * 3000, "é" * 2000):
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_minimal_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.MinimalPerfectHash(keys)
    assert sorted(h.lookup(keys).tolist()) == list(range(5000))
    other = h.lookup([f"x{i}".encode() for i in range(1000)])
    assert other.min() >= -1 and other.max() < 5000
    assert bpe.MinimalPerfectHash([]).lookup([b"a"]).tolist() == [-1]


def test_query(spark, sf, docs):
    got = sorted(map(tuple, bpe.op5_byte_bpe(spark, sf).collect()))
    pack = lambda t: struct.pack(f"<{len(x)}I", *x) if (x := LIBRARY.encode_ordinary(t)) else b""
    assert got == [(i, len(pack(t)) // 4, brute.sha(pack(t)), brute.sha(t)) for i, t in docs]


def test_odd_rows(odd, odd_rows):
    got = bpe.encode_documents(odd, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    want = [(i, len(LIBRARY.encode_ordinary(t or "")), t or "") for i, t in odd_rows]
    assert sorted([(r.doc_id, r.n_tokens, r.decoded) for r in got], key=str) == sorted(want, key=str)
