import numpy as np
import pytest

from starquilt.llm import ann


def brute(rows, dim, every, top):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == dim and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            near = sorted({(-float((q * v).sum()), j) for j, v in ok if j != i})[:top]
            out[i] = [(j, -s) for s, j in near]
    return out


def collect(df):
    out = {}
    for x in sorted(df.collect(), key=lambda x: (x.query_id, x.rank)):
        out.setdefault(x.query_id, []).append((x.vec_id, x.score))
        assert x.rank == len(out[x.query_id])
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    v = np.r_[centres[r.integers(0, 12, 1500)] + 0.2 * r.normal(size=(1500, 16)), r.normal(size=(500, 16))]
    return [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]


def test_recall_and_scores(spark, rows, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 100)
    monkeypatch.setattr(ann, "SHARD", 300)
    got = collect(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)))
    want = brute(rows, 16, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    by = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        assert all(s == pytest.approx(float(by[q] @ by[i]), abs=1e-9) for i, s in near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_ties_copies_and_odd_rows(spark):
    odd = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows = odd + [(1000 + i, [3.0, 4.0]) for i in range(70)] + [(i, [1.0, float(i)]) for i in range(200, 215)] + [(200, [1.0, 200.0])]
    df = spark.createDataFrame([(i, v, 1.5) for i, v in rows], "vec_id long, embedding array<float>, score double")
    assert collect(ann.search(df)) == brute(rows, 2, 20, 20)


def test_few_and_none(spark):
    few = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert collect(ann.search(df)) == brute(few, 2, 20, 20)
    assert ann.search(df.limit(0)).count() == 0


def test_lists_go_on_until_they_hold_enough():
    order = np.array([[0, 1, 2, 3], [3, 2, 1, 0], [1, 0, 3, 2]])
    got = ann.probed_lists(order, np.array([100, 1, 0, 50]), 2, 60)
    assert [x.tolist() for x in got] == [[0, 1], [3, 2, 1, 0], [1, 0]]
    assert [x.tolist() for x in ann.probed_lists(order, np.array([1, 1, 1, 1]), 1, 60)] == order.tolist()


def test_isolated_queries_get_all_their_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "TARGET", 0.5)  # few lists for each query
    r = np.random.default_rng(9)
    centres = r.normal(size=(20, 16))
    v = np.r_[centres[r.integers(0, 20, 2900)] + 0.02 * r.normal(size=(2900, 16)), np.repeat(4 * r.normal(size=(20, 16)), 3, axis=0) + 0.01 * r.normal(size=(60, 16))]
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    got = collect(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=7))
    want = brute(rows, 16, 7, 20)
    assert got.keys() == want.keys() and {len(x) for x in got.values()} == {20}


def test_depth_follows_the_loss_of_the_codes(spark, rows, monkeypatch):
    """Codebooks of four entries tell little: the trial then asks for more exact scores, and recall holds."""
    monkeypatch.setattr(ann, "CODES", 4)
    monkeypatch.setattr(ann, "SLICES", 4)
    monkeypatch.setattr(ann, "SHORT", 1)
    got = collect(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    want = brute(rows, 16, 20, 20)
    each = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(each) >= 0.95 and min(each) >= 0.5


def recalls(spark, v, every=20):
    rows = [(i, x) for i, x in enumerate(np.asarray(v, np.float32).tolist())]
    got = collect(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=every))
    want = brute(rows, len(v[0]), every, 20)
    return np.array([len({i for i, _ in got.get(q, [])} & {i for i, _ in want[q]}) / 20 for q in want])


@pytest.mark.parametrize("scale", [1e-25, 1e20])
def test_very_small_and_very_large_vectors(spark, scale):
    each = recalls(spark, scale * np.random.default_rng(4).normal(size=(2500, 16)))
    assert each.mean() >= 0.95 and each.min() >= 0.5


def test_queries_unlike_the_other_rows(spark):
    """Lists are counted for the queries asked: other rows, of which there are twenty times as many, need fewer."""
    r = np.random.default_rng(5)
    v = r.normal(size=(40, 32))[r.integers(0, 40, 6000)] + 0.2 * r.normal(size=(6000, 32))
    v[::20] = -v[::20]
    each = recalls(spark, v)
    assert each.mean() >= 0.98 and (each < 0.5).mean() <= 0.02
