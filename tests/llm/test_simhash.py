import random

import numpy as np
import pytest
import xxhash

from starquilt.llm import simhash as s


def brute_print(text):
    words = []
    w = b""
    for c in (text or "").encode():
        c = c + 32 if 65 <= c <= 90 else c
        if c in (32, 9, 10, 11, 12, 13):
            words += [w] if w else []
            w = b""
        else:
            w += bytes([c])
    words += [w] if w else []
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_classes(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


TEXTS = [None, "", " \t", "one", "one two", "one two three", "ONE two\nthree", "a b c d", "É b c é b c", " ".join(f"w{i}" for i in range(20_000)), "x " * 9000]


def test_fingerprints():
    assert s.fingerprints(TEXTS).tolist() == [brute_print(t) for t in TEXTS]


def near(r, base, most):
    for _ in range(r.randint(0, most)):
        base ^= 1 << r.randrange(64)
    return base


@pytest.mark.parametrize("seed", range(4))
def test_trie_is_brute_force(seed):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = sorted({near(r, r.choice(centres), 5) for _ in range(700)} | {r.getrandbits(64) for _ in range(200)})
    got = s.trie_forest(np.array(prints, np.uint64), np.array([0, len(prints)]), room=500)
    assert got.tolist() == brute_classes(prints)
    half = len(prints) // 2
    both = s.trie_forest(np.array(prints, np.uint64), np.array([0, half, len(prints)]))
    assert both.tolist() == brute_classes(prints[:half]) + [half + x for x in brute_classes(prints[half:])]


@pytest.mark.parametrize("bucket", [4096, 20])
def test_classes_are_brute_force(spark, bucket):
    r = random.Random(9)
    centres = [r.getrandbits(64) for _ in range(4)] + [0]
    chain = [0xF0F0 << 20]
    for k in range(40):
        chain.append(chain[-1] ^ (0b111 << (k % 20 * 3)))
    prints = [near(r, r.choice(centres), 4) for _ in range(350)] + [r.getrandbits(64) for _ in range(100)] + chain
    rows = [(1000 - i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    want = brute_classes(prints)
    least = {}
    for i, c in enumerate(want):
        least[c] = min(least.get(c, 10**9), 1000 - i)
    df = spark.createDataFrame(rows, "_id long, _fp long")
    by = {x.fp: x.component_id for x in s.classes_of(df, bucket).collect()}
    assert [by[f] for _, f in rows] == [least[c] for c in want]


def test_query_odd_rows(spark):
    rows = [(i + 1, t, "c") for i, t in enumerate(TEXTS)] + [(None, "one two three", "c"), (50, "one two three", "c"), (50, "one two three", "c"), (None, "quite alone here now", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = s.near_classes(df).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    want = brute_classes(prints)
    least = {c: min((i for (i, _, _), d in zip(rows, want) if d == c and i is not None), default=None) for c in want}
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    assert sorted(map(tuple, got), key=key) == sorted([(i, f"{p:016x}", least[c]) for (i, _, _), p, c in zip(rows, prints, want)], key=key)
    left = s.drop_near_copies(df)
    assert left.columns == df.columns
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(str(v) for v in least.values())
    assert s.near_classes(df.limit(0)).count() == 0 and s.drop_near_copies(df.limit(0)).count() == 0
