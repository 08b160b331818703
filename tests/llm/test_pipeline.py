"""The pipeline against a brute-force version, stage by stage and as a whole."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P

import corpus_pipeline as p
from starquilt.llm import bpe, mixing
from test_langid import words
from test_simhash import brute_classes, brute_print


def fixture():
    r = random.Random(6)
    abc = {"aa": "abcdeiou", "bb": "klmnoeiu"}
    rows = [(i, words(r, abc[lang], r.randint(40, 120)), lang, f"s{r.randint(0, 3)}", 1) for i in range(120) for lang in [r.choice(list(abc))]]
    rows += [(200 + i, rows[i][1].upper(), rows[i][2], "s1", 1) for i in range(15)]
    rows += [(300 + i, rows[20 + i][1] + " tail", rows[20 + i][2], None, 1) for i in range(15)]
    return rows + [(400, "12 34", "aa", "s0", 1), (401, None, None, None, None), (402, "", "bb", "s0", 0)]


def test_stages_and_whole(spark, tmp_path):
    rows = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    want = [x for x in rows if any(c.isalpha() for c in x[1] or "")]
    got = p.language_id(spark, docs, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)

    best = {}
    for x in want:
        best[x[1].lower()] = max(best.get(x[1].lower(), x), x)
    want = sorted(best.values())
    got = p.exact_dedup(spark, got, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want

    classes = brute_classes([brute_print(x[1]) for x in want])
    least = {}
    for x, c in zip(want, classes):
        least[c] = min(least.get(c, x), x)
    want = sorted(least.values())
    assert len(want) < len(best)
    got = p.near_dedup(spark, got, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want

    copies = {x.doc_id: x.copies for x in mixing.mix(spark.createDataFrame(want, schema)).collect()}
    taken, size = defaultdict(int), defaultdict(int)
    for x in want:
        taken[x[3]] += copies[x[0]] * len(x[1].split())
        size[x[3]] += len(x[1].split())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())
    got = p.mix(spark, got, str(tmp_path))
    assert got.columns == docs.columns
    assert Counter(x.doc_id for x in got.collect()) == {k: v for k, v in copies.items() if v}

    coder = bpe.Coder(P.path("byte_bpe_50k.tiktoken"))
    expected = Counter()
    for x in want:
        ids = coder.encode_batch([x[1]])[0]
        expected[(x[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(x[1].encode()).hexdigest())] += copies[x[0]]
    assert Counter(map(tuple, p.run(spark, str(tmp_path)).collect())) == +expected


def test_empty_and_extra_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here", "aa", "s", 1, 5, 6)], "doc_id long, text string, lang string, source string, n_chars long, _sha int, copies int")
    at = docs
    for _, stage in p.STAGES[:-1]:
        at = stage(spark, at, "")
        assert at.columns == docs.columns
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, "").count() == 0
