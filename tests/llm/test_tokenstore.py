import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from starquilt.llm import tokenstore as t

FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(FILE)
    return lambda x: tok.encode(x or "", add_special_tokens=False).ids


ODD = [None, "", " ", "  a", "a  \n b", "don't  stop\x85 now", "a b   c", "<|endoftext|> x", "a <|endoftext|> x<|endoftext|>", "<|endoftext|", "日本 語", "\x1c\x1da \x1f b", "x" * 3000, "tab\t\tx \t y", "😀 😀", "trail  "]


def test_chunks_are_independent(library):
    c = t.LibraryCoder(FILE)
    r = random.Random(2)
    texts = ODD + ["".join(r.choices("aé \n\t'sx!1 \x85\x1c ", k=40)) for _ in range(1500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == [library(x) for x in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    h = t.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("width", [2, 4])
def test_shard_lookup(tmp_path, width):
    w = t.ShardWriter(f"{tmp_path}/s", 1, width)
    keys = [None, None, -5, 3, 3, 9]
    data = [struct.pack("<2I", i, i + 1) for i in range(6)]
    w.add(keys, data)
    assert w.close()[1:] == (6, 12)
    s = t.Shard(f"{tmp_path}/s")
    assert s.find(np.array([-5, 3, 9, 0, 4, 10**15])).tolist() == [2, 3, 5, -1, -1, -1]
    assert [s.ids(k) for k in range(6)] == data
    assert s.find(np.arange(10, 100_000)).max() == -1


def test_rows_of_a_shard_are_read_together(tmp_path):
    w = t.ShardWriter(f"{tmp_path}/s", 1, 2)
    data = [struct.pack(f"<{n}I", *range(n)) for n in random.Random(1).choices([0, 1, 7, 300], k=500)]
    w.add(list(range(500)), data)
    w.close()
    s = t.Shard(f"{tmp_path}/s")
    reads = []

    class Counted:
        def read_at(self, n, at, file=s.file):
            reads.append(n)
            return file.read_at(n, at)

    s.file = Counted()
    assert s.ids_of(np.arange(500)) == data and len(reads) == 1
    assert s.ids_of(np.arange(500), most=1000) == data and max(reads[1:]) <= 1000
    mixed = np.array([3, 4, 5, 9, 2, 2, 499])
    assert s.ids_of(mixed) == [data[k] for k in mixed]


def test_query_and_odd_rows(spark, library):
    r = random.Random(4)
    rows = [(i * 3 - 50, " ".join(r.choices(["alpha", "Beta's", "γ", "12", "\n"], k=r.randint(0, 60))), 0) for i in range(300)]
    rows += [(10**6 + i, x, 0) for i, x in enumerate(ODD)] + [(7, "same", 0)] * 40 + [(7, "other", 0)] + [(None, "n", 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    for size in (16 << 20, 1):
        got = t.store_and_read(df, FILE, shard_bytes=size).collect()
        assert len(got) == len(rows)
        want = sorted((i is not None, i or 0, len(library(x)) + 1, zlib.crc32(np.array([*library(x), 2], "<u4").tobytes())) for i, x, _ in rows)
        assert sorted((g.doc_id is not None, g.doc_id or 0, g.n_tokens, g.ids_crc32) for g in got) == want
        at = 0
        for g in sorted(got, key=lambda g: g.start):
            assert g.start == at
            at += g.n_tokens
        order = [g.doc_id for g in sorted(got, key=lambda g: g.start)]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert t.store_and_read(df.limit(0), FILE).count() == 0
