import random
from collections import defaultdict

import pytest

from starquilt.llm import mixing
from starquilt.llm.shared import group_place


def brute_targets(words, budget=1.5, most=2.0):
    """Rounds of sharing what is left by weight."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    fixed, left = {}, budget * sum(words.values())
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        if not free:
            return fixed
        share = {s: left * weight[s] / total for s in free}
        above = [s for s in free if share[s] > most * words[s]]
        if not above:
            return fixed | share
        for s in above:
            fixed[s] = most * words[s]
        left = budget * sum(words.values()) - sum(fixed.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_copies(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", "é", "Z", "", None, "hot"]
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(int(r.expovariate(1 / 40)))), r.choice(names + ["hot"] * 5), 1) for i in range(1500)]
    rows += [(2000, None, "a", 1), (2001, "", "void", 1), (2002, "\t\n", "void", 1), (2003, "one two", None, 1), (2003, "one two", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    words = defaultdict(int)
    for _, t, s, _ in rows:
        words[s] += len((t or "").split())
    want = brute_targets(dict(words))
    taken, biggest = defaultdict(int), defaultdict(int)
    for x in got:
        assert x.source_size == words[x.source]
        assert x.target == pytest.approx(want[x.source], rel=1e-9)
        assert x.taken == x.copies * x.size and 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
        biggest[x.source] = max(biggest[x.source], x.size)
    for s in words:
        assert abs(taken[s] - want[s]) <= 2 * biggest[s] + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))


def test_rows_are_repeated(spark):
    df = spark.createDataFrame([(i, f"text number {i}", f"s{i % 4}", None) for i in range(200)], "doc_id long, text string, source string, copies string")
    copies = {x.doc_id: x.copies for x in mixing.mix(df).collect()}
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    seen = defaultdict(int)
    for x in out.collect():
        seen[x.doc_id] += 1
    assert seen == {k: v for k, v in copies.items() if v}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none_keep_their_own_copies(spark):
    r = random.Random(3)
    rows = [(None if i % 3 else i // 30, " ".join("w" * r.randint(1, 9)), f"s{i % 2}", i) for i in range(600)] + [(7, "alike " * 11, "s0", i) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(5)
    got = mixing.mix(df).collect()
    want, have = defaultdict(int), defaultdict(int)
    for x in got:
        want[(x.doc_id, x.source, x.size)] += x.copies
    out = mixing.mixed_rows(df).collect()
    for x in out:
        have[(x.doc_id, x.source, len(x.text.split()))] += 1
    assert have == {k: v for k, v in want.items() if v}
    each = defaultdict(int)
    for x in out:
        each[x.n if x.doc_id == 7 and x.text.startswith("alike") else None] += 1
    each.pop(None)
    alike = sum(x.copies for x in got if x.doc_id == 7 and x.size == 11)
    assert sum(each.values()) == alike and max(each.values()) - min(each.values() if len(each) == 90 else [0]) <= 1


def test_places_in_groups(spark):
    rows = [(None, "a", i) for i in range(400)] + [(1, "a", i) for i in range(3)] + [(1, None, 9)]
    df = spark.createDataFrame(rows, "k long, j string, _part int").repartition(6)
    by = defaultdict(list)
    for x in group_place(df, ["k", "j"], "place").collect():
        by[(x.k, x.j)].append(x.place)
    assert {k: sorted(v) for k, v in by.items()} == {(None, "a"): list(range(1, 401)), (1, "a"): [1, 2, 3], (1, None): [1]}


def test_all_texts_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(x.doc_id, x.size, x.taken, x.target) for x in mixing.mix(df).collect()} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}
