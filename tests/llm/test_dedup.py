import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from starquilt.llm import dedup


def brute(rows):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[(t or "").encode().lower()].append(i)
    return by


ROWS = [
    (5, "Hello", "x"), (7, "hELLO", "y"), (1, None, "z"), (2, "", "z"), (9, "ÉA", "q"), (8, "Éa", "q"), (6, "éa", "q"),
    (3, "long " * 40_000, "w"), (4, "long " * 40_000, "w"), *[(100 + i, "same", "h") for i in range(300)], *[(1000 + i, f"one {i}", "h") for i in range(300)],
]


def test_groups(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string").repartition(5)
    got = dedup.exact_groups(df).collect()
    by = brute(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t for i, t, _ in ROWS if i == r.doc_id)
        key = (text or "").encode().lower()
        assert (r.keep_id, r.group_size, r.kept) == (max(by[key]), len(by[key]), r.doc_id == max(by[key]))
        assert r.text_sha256 == hashlib.sha256(key).hexdigest()


def test_tiny_filter_gives_the_same(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string")
    a, b = (dedup.exact_groups(df, bits=m).orderBy("doc_id").collect() for m in (0.1, 64))
    assert a == b


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "a"), (1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "b"), (2, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup.exact_groups(df).collect()
    assert sorted((r.group_size, r.kept) for r in got) == [(1, True), (2, False), (2, True), (4, False), (4, False), (4, False), (4, True)]
    assert dedup.exact_groups(df.limit(0)).count() == 0
    assert dedup.drop_exact_copies(df).count() == 3
    assert dedup.drop_exact_copies(df.limit(0)).count() == 0


def test_dropping_keeps_whole_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, _x string").repartition(7)
    left = dedup.drop_exact_copies(df)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {max(v) for v in brute(ROWS).values()}
    assert left.count() == len(brute(ROWS))


@pytest.mark.parametrize("n", [3000, 60_000])
@pytest.mark.parametrize("page", [1 << 10, dedup.PAGE])
def test_filter_never_misses_and_seldom_alarms(spark, n, page):
    """At every size and in pages of any size: all repeats are found, and of the others under one in a hundred is taken for one."""
    digest = lambda i: F.unhex(F.sha2(i.cast("string"), 256))
    df = spark.range(n).select(digest(F.when(F.col("id") < n // 5, F.col("id") % (n // 10)).otherwise(F.col("id"))).alias("d"), (F.col("id") < n // 5).alias("again")).repartition(6)
    found = dedup.repeated_filter(df, "d", n, page=page)
    assert found.pages * found.page_bits >= 16 * n and found.page_bits <= page and (page > 1 << 10 or found.pages > 40)
    marked = dedup.with_maybe_repeated(df, "d", found, "maybe")
    assert marked.filter("again and not maybe").count() == 0
    assert marked.filter("maybe and not again").count() < n // 100


def test_layout_follows_the_rows():
    for rows in (1, 10**5, 10**8, 10**11):
        pages, bits = dedup.layout(rows, 16, dedup.PAGE, 12)
        assert 16 * rows <= pages * bits <= max(64 * rows, 1 << 18) and bits <= dedup.PAGE


def test_equal_id_and_text_keep_a_fixed_row(spark):
    df = spark.createDataFrame([(1, "a", str(i)) for i in range(50)], "doc_id long, text string, x string")
    kept = {tuple(dedup.drop_exact_copies(df.repartition(k)).collect()[0]) for k in (1, 3, 7)}
    assert len(kept) == 1
