"""Byte-level BPE against the public library, and round trips."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from starquilt.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    "", " ", "  ", "a", "  a", "a  ", "\n\n x", "don't we'll I'd 's 'S ''s x''s !'s 'sx", "'", "a'", "'r", "'re", "'rex've", " 's", "\t's", "1's2't",
    "a b   c", "　x ", "日本語 text ٣٤ ½", "é́ ñ", "😀😀 ok", "<|endoftext|>", "x" * 5000, "ab" * 300, " " * 3000 + "z", "\x1c\x1d a", "a\x85b",
]


def ids(coder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in coder.encode_batch(texts)]


def test_odd_texts_together_and_alone(library):
    c = bpe.Coder(RANKS)
    want = [library.encode_ordinary(t) for t in ODD]
    assert ids(c, ODD) == want
    assert [ids(c, [t])[0] for t in ODD] == want
    assert ids(c, [None]) == [[]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé ñ\n\t '!srevltmd1２ 日😀")), max_size=6))
def test_any_texts(texts):
    c = bpe.coder(RANKS)
    split = regex.compile(P.PATTERN)
    assert ids(c, texts) == [[i for p in split.findall(t) for i in c.merge(p.encode())] for t in texts]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_long_texts_are_cut_where_nothing_is_lost(library, monkeypatch, size):
    monkeypatch.setattr(bpe, "SLICE", size)
    c = bpe.Coder(RANKS)
    r = np.random.default_rng(size)
    texts = ODD + ["".join(r.choice(list("aé \n\t'sx!1\x85日 "), 400)) for _ in range(40)]
    assert ids(c, texts) == [library.encode_ordinary(t) for t in texts]
    assert all("".join(bpe.cut(t)) == t for t in texts) and max(len(list(bpe.cut(t))) for t in texts) > 3


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=49, max_size=300).map(lambda b: bytes(x % 5 + 97 for x in b)))
def test_long_merge_is_the_short_merge(piece):
    c = bpe.coder(RANKS)
    if piece in c.ranks:
        return
    ids, out = [c.single[x] for x in piece], None
    while True:
        ranks = [c._pair(a, b) for a, b in zip(ids, ids[1:])]
        if not ranks or min(ranks) == 1 << 30:
            out = ids
            break
        i = ranks.index(min(ranks))
        ids = ids[:i] + [ranks[i]] + ids[i + 2 :]
    assert c._merge_long([c.single[x] for x in piece]) == out


def test_scan_is_the_running_product():
    _, product, of_symbol, _ = bpe._automaton()
    e = of_symbol[np.random.default_rng(1).integers(0, 9, 50_000)]
    acc, want = 0, []
    for x in e.tolist():
        acc = product[acc, x]
        want.append(acc)
    assert bpe.scan(e, product).tolist() == want


def test_query_and_odd_tables(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate([*ODD, None, "again", "again"])] + [(None, "no id", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode_documents(df, RANKS)).collect()}
    want = set()
    for i, t, _ in rows:
        x = library.encode_ordinary(t or "")
        want.add((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe.encode_documents(df.limit(0), RANKS).count() == 0


def test_offsets_cut_the_text(library):
    c = bpe.coder(RANKS)
    (x,) = c.encode_batch(["héllo wörld"])
    at, raw = c.offsets(x), c.decode(x)
    assert raw == "héllo wörld".encode() and at[-1] == len(raw)
    assert [raw[a:b] for a, b in zip(at, at[1:])] == [c.vocab[i] for i in np.frombuffer(x, "<u4")]
