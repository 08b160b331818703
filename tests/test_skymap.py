"""Laws of maps: validity, coverage, updates, errors; against plain dictionaries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starquilt.functions import pixelization as px
from starquilt.operators import algebra
from starquilt.operators.algebra import product_union, sum_union
from starquilt.operators.geometry import Box, Circle, Ellipse, Polygon, realize_geom
from starquilt.operators.moc import to_moc
from starquilt.operators.sampling import make_uniform_randoms, make_uniform_randoms_fast
from starquilt.operators.skymap import SkyCoverage, SkyMap, expand_ranges

NC, NS = 8, 32
N = 12 * NS * NS


def new(spark, rows, dtype="float64", **how):
    kind = {"float64": "double", "int64": "bigint", "int32": "int", "float32": "float", "uint8": "smallint"}.get(dtype, "boolean")
    return SkyMap.from_frame(spark.createDataFrame([(p, v) for p, v in rows.items()], f"pix bigint, v {kind}"), NC, NS, dtype, **how)


def values(m):
    return {r[0]: r[1] if len(r) > 1 else True for r in m.df.collect()}


def covered(m):
    return sorted(r[0] for r in m.cov.collect())


# types --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("dtype,sentinel", [("int8", -128), ("int16", -32768), ("int32", -(1 << 31)), ("int64", -(1 << 63)), ("uint8", 0), ("uint16", 0), ("uint32", 0), ("uint64", 0), ("float32", -1.6375e30), ("float64", -1.6375e30), ("bool", False)])
def test_default_sentinels(spark, dtype, sentinel):
    m = SkyMap.make_empty(spark, NC, NS, dtype)
    assert m.sentinel == sentinel and m.n_valid == 0 and m.is_integer_map == (not dtype.startswith("float")) and m.is_unsigned_map == dtype.startswith("uint")


def test_bad_parameters(spark):
    for how in ({"dtype": "int32", "sentinel": 1.5}, {"dtype": "float64", "sentinel": 3}, {"dtype": "bool", "sentinel": True}, {"dtype": "int8", "sentinel": 300}, {"dtype": "int32", "bit_packed": True}, {"wide_mask_maxbits": 8, "sentinel": 5}, {"dtype": {"a": "float32"}, "primary": "b"}, {"dtype": "complex"}):
        with pytest.raises(ValueError):
            SkyMap.make_empty(spark, NC, NS, **how)
    with pytest.raises(ValueError):
        SkyMap.make_empty(spark, 64, 32)
    with pytest.raises(ValueError):
        SkyMap.make_empty(spark, NC, NS, metadata={"lower": 1})
    assert SkyMap.make_empty(spark, NC, NS, wide_mask_maxbits=7).wide_mask_maxbits == 8
    assert SkyMap.make_empty(spark, NC, NS, wide_mask_maxbits=100).wide_mask_width == 13


def test_copy_and_metadata(spark):
    m = new(spark, {1: 2.0}).with_metadata({"A": 1})
    assert m.metadata == {"A": 1} and m.copy().metadata is None and m.copy() == m and "SkyMap(" in repr(m)
    assert SkyMap.make_empty_like(m, dtype="int16", sentinel=None).dtype == "int16"


# coverage -----------------------------------------------------------------------------------------------------------
def test_coverage(spark):
    c = SkyCoverage.make_from_pixels(spark, NC, NS, [5, 2, 2])
    assert 5 in c and 3 not in c and c.nfine_per_cov == 16 and c.bit_shift == 4
    assert sorted(r[0] for r in c.append_pixels([3]).df.collect()) == [2, 3, 5]
    m = SkyMap.make_empty(spark, NC, NS, cov_pixels=[7])
    m = m.update_values_pix([0, 40], [1.0, m.sentinel])  # a sentinel covers, and is no value
    assert values(m) == {0: 1.0} and covered(m) == [0, 2, 7]
    assert covered(m.update_values_pix([100], None)) == [0, 2, 7]
    fraction = {r[0]: r[1] for r in m.coverage_map.collect()}
    assert len(fraction) == 768 and fraction[0] == 1 / 16 and fraction[7] == 0
    assert covered(m.get_single_covpix_map(0)) == [0] and m.get_single_covpix_map(300).n_valid == 0
    assert [x.n_valid for x in m.get_covpix_maps()] == [1, 0, 0]
    assert [[r[0] for r in f.collect()] for f in m.iter_valid_pixels_by_covpix()] == [[0], [], []]


def test_fracdet(spark):
    m = new(spark, {p: 1.0 for p in range(24)})
    assert values(m.fracdet_map(NS // 2)) == {p: 1.0 for p in range(6)} and values(m.fracdet_map(NC)) == {0: 1.0, 1: 0.5} and m.fracdet_map(NS).n_valid == 24
    for bad in (4, 64):
        with pytest.raises(ValueError):
            m.fracdet_map(bad)


# lookups ------------------------------------------------------------------------------------------------------------
def test_indexing(spark):
    m = new(spark, {p: float(p) for p in range(0, 100, 2)})
    assert m[4] == 4.0 and m[5] == m.sentinel and m[np.int64(6)] == 6.0
    assert [r.v for r in m[0:6].orderBy("pix").collect()] == [0.0, m.sentinel, 2.0, m.sentinel, 4.0, m.sentinel]
    assert m[:].count() == N and sorted(r.v for r in m[np.array([2, 4])].collect()) == [2.0, 4.0]
    for bad in (1.5, [1.5], (1.0,), True):
        with pytest.raises(IndexError):
            m[bad]
    with pytest.raises(ValueError):
        m.get_values_pix([1], nside=16)
    assert m.get_values_pix([]).count() == 0
    with pytest.raises(TypeError):
        m["v"]


def test_record(spark):
    df = spark.createDataFrame([(1, 2.0, 3), (2, -1.6375e30, 4)], "pix bigint, a double, b int")
    m = SkyMap.from_frame(df, NC, NS, {"a": "float64", "b": "int32"}, primary="a")
    assert m.n_valid == 1 and values(m["b"]) == {1: 3} and m["b"].sentinel == -(1 << 31) and tuple(m[1]) == (2.0, 3) and tuple(m[9]) == (m.sentinel, -(1 << 31))
    with pytest.raises(NotImplementedError):
        m + 1
    with pytest.raises(ValueError):
        m.update_values_pix([1], [(1.0, 2)], operation="add")
    assert tuple(m.update_values_pix([5], [(1.5, 7)])[5]) == (1.5, 7)


# updates ------------------------------------------------------------------------------------------------------------
def test_updates(spark):
    for sentinel in (None, 0.0):
        m = SkyMap.make_empty(spark, NC, NS, sentinel=sentinel)
        m = m.update_values_pix([0, 0, 10, 10, 1000, 1000, 1000, 10000], 1.0, operation="add")
        assert values(m) == {0: 2.0, 10: 2.0, 1000: 3.0, 10000: 1.0}
    with pytest.raises(ValueError):
        m.update_values_pix([1, 1], 2.0)
    with pytest.raises(ValueError):
        m.update_values_pix([1], 1.0, operation="or")
    with pytest.raises(ValueError):
        m.update_values_pix([1], 1.0, operation="mean")
    with pytest.raises(ValueError):
        m.update_values_pix([1, 2], [1.0])
    with pytest.raises(ValueError):
        new(spark, {1: 1}, "int64").update_values_pix([1], 1.5)
    i = new(spark, {1: 6, 2: 5}, "int32", sentinel=0)
    assert values(i.update_values_pix([1, 1, 3], [1, 8, 4], operation="or")) == {1: 15, 2: 5, 3: 4}
    assert values(i.update_values_pix([1, 1, 3], [6, 3, 4], operation="and")) == {1: 2, 2: 5}
    wrapped = new(spark, {1: 250}, "uint8").update_values_pix([1], 10, operation="add")
    assert values(wrapped) == {1: 4}
    b = new(spark, {1: True}, "bool")
    assert values(b.update_values_pix([2, 3], True)) == {1: True, 2: True, 3: True} and b.update_values_pix([1], False).n_valid == 0
    ranges = SkyMap.make_empty(spark, NC, NS, "int64").update_values_pix([(10, 20), (30, 31), (5, 5)], 3)
    assert sorted(values(ranges)) == [*range(10, 20), 30]
    assert sorted(values(SkyMap.make_empty(spark, NC, NS).update_values_pix([(10, 20), (15, 25)], 3.0))) == list(range(10, 25))
    with pytest.raises(ValueError):
        b.update_values_pix([(1, 2)], True, nest=False)
    with pytest.raises(NotImplementedError):
        b.update_values_pix([1], True, operation="add")


def test_items(spark):
    m = SkyMap.make_empty(spark, NC, NS).with_items(slice(0, 4), 1.0).with_items([7, 9], [2.0, 3.0]).with_items(np.int64(3), 5.0).with_items(slice(20, 30, 5), 6.0)
    assert values(m) == {0: 1.0, 1: 1.0, 2: 1.0, 3: 5.0, 7: 2.0, 9: 3.0, 20: 6.0, 25: 6.0}
    assert values(m.with_items(slice(0, 21), None)) == {25: 6.0} and values(m.with_items(slice(0, 2), [8.0, 9.0]))[1] == 9.0
    for bad in ("a", 1.5, True, [1.5]):
        with pytest.raises(IndexError):
            m.with_items(bad, 1.0)


def test_ring_numbers(spark):
    m = SkyMap.make_empty(spark, NC, NS).update_values_pix(list(range(20)), [float(k) for k in range(20)], nest=False)
    got = m.get_values_pix(list(range(20)), nest=False)
    assert sorted(r.v for r in got.collect()) == [float(k) for k in range(20)]


def test_wide_masks(spark):
    m = SkyMap.make_empty(spark, NC, NS, wide_mask_maxbits=128)
    m = m.set_bits_pix(list(range(10)), [4, 100])
    assert [m.check_bits_pix([3], [b]).first()["set"] for b in (2, 4, 100, 101)] == [False, True, True, False]
    m = m.clear_bits_pix([3], [4, 100])
    assert m.n_valid == 9
    for bad in ([128], [-1]):
        with pytest.raises(ValueError):
            m.set_bits_pix([1], bad)
    with pytest.raises(NotImplementedError):
        m & 5
    with pytest.raises(NotImplementedError):
        new(spark, {1: 1.0}).set_bits_pix([1], [2])
    high = SkyMap.make_empty(spark, NC, NS, wide_mask_maxbits=64).set_bits_pix([5], [63])
    assert high.n_valid == 1 and high.check_bits_pix([5], [63]).first()["set"]


def test_masks(spark):
    m = new(spark, {p: 1.0 for p in range(8)})
    mask = new(spark, {0: 1, 1: 2, 2: 3, 3: -4}, "int64", sentinel=0)
    assert sorted(values(m.apply_mask(mask))) == [3, 4, 5, 6, 7] and sorted(values(m.apply_mask(mask, mask_bits=1))) == [1, 3, 4, 5, 6, 7]
    with pytest.raises(NotImplementedError):
        m.apply_mask(m)
    with pytest.raises(NotImplementedError):
        m.apply_mask(SkyMap.make_empty(spark, NC, NS, wide_mask_maxbits=8), mask_bits=1)
    with pytest.raises(ValueError):
        m.apply_mask(SkyMap.make_empty(spark, NC, 64, "bool"))


def test_cast(spark):
    m = new(spark, {1: 1.9, 2: -3.5})
    assert values(m.astype("int32")) == {1: 1, 2: -3} and values(m.astype("bool")) == {1: True, 2: True}
    assert values(new(spark, {1: 300}, "int64").astype("uint8")) == {1: 44}
    for bad in (SkyMap.make_empty(spark, NC, NS, wide_mask_maxbits=8), SkyMap.make_empty(spark, NC, NS, "bool", bit_packed=True)):
        with pytest.raises(ValueError):
            bad.astype("int32")


# algebra ------------------------------------------------------------------------------------------------------------
def test_constants(spark):
    m = new(spark, {1: 4.0, 2: -9.0})
    assert values(m / 0.0) == {1: float("inf"), 2: float("-inf")} and values(m**2.0) == {1: 16.0, 2: 81.0} and values(m > 0.0) == {1: True}
    with pytest.raises(NotImplementedError):
        m & 3
    with pytest.raises(NotImplementedError):
        m + m
    i = new(spark, {1: 6}, "int64")
    for bad in (lambda: i / 2, lambda: i + 1.5):
        with pytest.raises(TypeError):
            bad()
    assert values(new(spark, {1: 200}, "uint8") + 100) == {1: 44}
    before = m
    m += 1.0
    assert values(m)[1] == 5.0 and values(before)[1] == 4.0
    assert (before == before.copy()) is True and (before != m) is True


def test_boolean_laws(spark):
    a, b = new(spark, {1: True, 2: True, 40: True}, "bool"), new(spark, {2: True, 3: True}, "bool")
    assert sorted(values(a & b)) == [2, 40] and covered(a & b) == [0, 2]  # beyond the other's coverage the left side stays
    assert sorted(values(a | b)) == [1, 2, 3, 40] and sorted(values(a ^ b)) == [1, 3, 40]
    assert (~a).n_valid == 29 and (a | True).n_valid == 32 and (a & False).n_valid == 0 and covered(a & False) == [0, 2] and (~~a) == a
    with pytest.raises(NotImplementedError):
        a + 1
    with pytest.raises(ValueError):
        a & SkyMap.make_empty(spark, NC, 64, "bool")
    with pytest.raises(NotImplementedError):
        ~new(spark, {1: 1.0})


def test_many_maps(spark):
    r = np.random.default_rng(12345)
    data = [{int(p): float(v) for p, v in zip(r.choice(N, 300, replace=False), r.normal(size=300))} for _ in range(3)]
    maps = [new(spark, d) for d in data] + [SkyMap.make_empty(spark, NC, NS)]
    every, all3 = set().union(*data), set.intersection(*map(set, data))
    got = values(algebra.sum_union(maps))
    assert set(got) == every and all(got[p] == pytest.approx(sum(d.get(p, 0) for d in data)) for p in every)
    assert algebra.sum_intersection(maps).n_valid == 0 and set(values(algebra.sum_intersection(maps[:3]))) == all3
    assert values(algebra.max_union(maps)) == {p: max(0.0, *(d[p] for d in data if p in d)) for p in every}
    assert values(algebra.min_union(maps)) == {p: min(d[p] for d in data if p in d) for p in every}
    for bad, kind in ((lambda: algebra.sum_union(maps[:1]), RuntimeError), (lambda: algebra.or_union(maps), ValueError), (lambda: algebra.floor_divide_intersection(maps), ValueError), (lambda: algebra.sum_union([maps[0], SkyMap.make_empty(spark, NC, 64)]), ValueError)):
        with pytest.raises(kind):
            bad()
    i, j = new(spark, {1: 7, 2: -7, 3: 5}, "int64"), new(spark, {1: -2, 2: 2, 3: 0}, "int64")
    assert values(algebra.floor_divide_intersection([i, j])) == {1: -4, 2: -4, 3: 0}
    for f in (algebra.min_union, algebra.divide_intersection):
        with pytest.raises(ValueError):
            f([i, j])
    nan = new(spark, {1: float("nan"), 2: 1.0})
    assert values(algebra.max_union([nan, new(spark, {1: 3.0})])) == {1: 3.0, 2: 1.0}


def test_resolution(spark):
    m = new(spark, {p: float(p) for p in range(6)})
    assert values(m.degrade(16)) == {0: 1.5, 1: 4.5} and values(m.degrade(16, "std"))[0] == pytest.approx(np.std([0, 1, 2, 3]))
    assert values(m.degrade(16, "sum")) == {0: 6.0, 1: 9.0, 2: 0.0, 3: 0.0} and values(m.degrade(16, "prod", empty_groups="null")) == {0: 0.0, 1: 20.0}
    assert m.degrade(NS) is m and values(m.upgrade(64)) == {4 * p + k: float(p) for p in range(6) for k in range(4)}
    with pytest.warns(ResourceWarning):
        low = m.degrade(4, "max")
    assert low.nside_coverage == 4 and values(low) == {0: 5.0}
    with pytest.warns(UserWarning):
        m.degrade(16, "mean", m)
    for bad, kind in ((lambda: m.degrade(64), ValueError), (lambda: m.degrade(16, "mode"), ValueError), (lambda: m.degrade(16, "wmean"), ValueError), (lambda: m.degrade(16, "or"), ValueError), (lambda: m.upgrade(16), ValueError), (lambda: m.degrade(16, "wmean", new(spark, {1: 1.0})), ValueError)):
        with pytest.raises(kind):
            bad()
    i = new(spark, {p: p for p in range(4000, 8000)}, "int64", sentinel=0)
    assert values(i.degrade(8, "or")) == {p >> 4: p + 15 for p in range(4000, 8000, 16)} and values(i.degrade(8, "and")) == {p >> 4: p for p in range(4000, 8000, 16)}
    low = new(spark, {0: 1}, "int32")  # the lowest number takes part where a pixel is missing
    assert values(low.degrade(16, "or")) == {0: 1 - (1 << 31)}
    packed = SkyMap.from_frame(spark.range(10).withColumnRenamed("id", "pix"), 4, NS, "bool", bit_packed=True)
    assert sorted(values(packed.degrade(16, "or"))) == [0, 1, 2] and sorted(values(packed.degrade(16, "and"))) == [0, 1]
    assert values(packed.degrade(16)) == {0: 1.0, 1: 1.0, 2: 1.0}
    with pytest.raises(NotImplementedError):
        packed.upgrade(64)
    with pytest.raises(NotImplementedError):
        SkyMap.make_empty(spark, NC, NS, wide_mask_maxbits=8).degrade(16, "mean")


def test_dense(spark):
    m = new(spark, {3: 1.0, 50: float("nan")})
    back = SkyMap.convert_healpix_map(m.generate_healpix_map(), NC, NS)
    assert values(back) == {3: 1.0}  # NaN is not above UNSEEN
    for bad in (lambda: m.generate_healpix_map(64),):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):
        SkyMap.make_empty(spark, NC, NS, wide_mask_maxbits=8).generate_healpix_map()
    with pytest.raises(ValueError):
        SkyMap.make_empty(spark, NC, NS, {"a": "float64"}, "a").generate_healpix_map()


# shapes -------------------------------------------------------------------------------------------------------------
def test_shapes(spark):
    c = Circle(200.0, 0.0, 20.0, 16)
    m = c.get_map(spark, NC, NS, "int16")
    assert set(values(m).values()) == {16} and m.get_valid_area() == pytest.approx(2 * np.pi * (1 - np.cos(np.radians(20))) * np.degrees(1) ** 2, rel=0.05)
    assert c.get_pixel_ranges(spark, NS).agg(F.sum(F.col("end") - F.col("start"))).first()[0] == m.n_valid
    for bad in (lambda: Circle([1.0, 2.0], 0.0, 1.0, 1), lambda: Polygon([1, 2], [1, 2], 1), lambda: Circle(0.0, 0.0, 1.0, 1, nside_render=64).get_pixels(spark, 32)):
        with pytest.raises(ValueError):
            bad()
    for winding in (1, -1):
        p = Polygon([200, 220, 220, 200][::winding], [-10, -10, 10, 10][::winding], 1)
        assert p.get_map(spark, NC, NS, "int32").get_valid_area() == pytest.approx(400, rel=0.1)
    assert Box(350, 10, -5, 5, 1).get_map(spark, NC, NS, "int32").get_valid_area() == pytest.approx(200, rel=0.2)
    assert Box(0, 360, 60, 90, True).get_map(spark, NC, NS, "bool").get_valid_area() == pytest.approx(41253 / 2 * (1 - np.sin(np.pi / 3)), rel=0.05)
    e = Ellipse(100, 20, 15.0, 15.0, 0.0, True)
    assert sorted(values(e.get_map(spark, NC, NS, "bool"))) == sorted(values(Circle(100, 20, 15.0, True).get_map(spark, NC, NS, "bool")))
    two = realize_geom([c, Box(190, 210, -5, 5, 1)], SkyMap.make_empty(spark, NC, NS, "int16", sentinel=0))
    assert set(values(two).values()) == {16, 17}
    for bad in (lambda: realize_geom(Circle(0, 0, 1, 1 << 20), SkyMap.make_empty(spark, NC, NS, "int16", sentinel=0)), lambda: realize_geom(c, SkyMap.make_empty(spark, NC, NS)), lambda: realize_geom(c, m, "and"), lambda: realize_geom(Circle(0, 0, 1, [3]), m)):
        with pytest.raises(ValueError):
            bad()


def test_shape_prefilter_loses_nothing(spark):
    """Going down level by level finds the same pixels as testing every centre."""
    from starquilt.functions import pixelization as px

    for s in (Circle(10.0, 89.5, 3.0, 1), Box(355, 20, 80, 90, 1), Polygon([0, 90, 180, 270], [80, 80, 80, 80], 1), Ellipse(300, -88, 6.0, 2.0, 45.0, 1)):
        every = px.with_vector(spark.range(px.n_pixels(256)).withColumnRenamed("id", "pix"), 256, "pix", ("x", "y", "z"))
        want = {r[0] for r in every.filter(s.inside((F.col("x"), F.col("y"), F.col("z")), 0.0)).select("pix").collect()}
        assert {r[0] for r in s.get_pixels(spark, 256).collect()} == want and want


def test_interpolation_of_a_constant(spark):
    full = SkyMap.from_frame(spark.range(N).select(F.col("id").alias("pix"), F.lit(3.0).alias("v")), NC, NS)
    points = spark.range(500).select("id", (F.rand(1) * 360).alias("ra"), (F.rand(2) * 180 - 90).alias("dec"))
    assert [r.v for r in full.interpolate_pos(points).collect()] == pytest.approx([3.0] * 500)
    holed = full.update_values_pix(list(range(100, 400)), None)
    some, part = holed.interpolate_pos(points), holed.interpolate_pos(points, allow_partial=True)
    assert some.filter("v < -1e30").count() > 0 and part.filter("v < -1e30").count() < some.filter("v < -1e30").count()
    with pytest.raises(NotImplementedError):
        new(spark, {1: True}, "bool").interpolate_pos(points)


def test_randoms(spark):
    m = new(spark, {p: 1.0 for p in [*range(100), 5000, 11000]})
    for got in (make_uniform_randoms_fast(m, 3000, seed=1), make_uniform_randoms(m, 1000, seed=2)):
        assert m.get_values_pos(got, valid_mask=True).filter("not valid").count() == 0
    assert make_uniform_randoms(m, 1000, seed=2).count() == 1000 and make_uniform_randoms_fast(m, 10, seed=1).count() == 10
    with pytest.raises(ValueError):
        make_uniform_randoms(SkyMap.make_empty(spark, NC, NS), 5)


def test_moc(spark):
    m = new(spark, {p: True for p in range(16, 37)}, "bool")
    got = sorted(r[0] for r in to_moc(m).collect())
    assert got == sorted([4 * 4**3 + 1, 4 * 4**4 + 8, 4 * 4**5 + 36])


def test_arithmetic_of_64_bits_wraps(spark):
    r = np.random.default_rng(4)
    v = np.r_[r.integers(-(2**62), 2**62, 200), np.array([2**62, -(2**62), 2**63 - 1, -(2**63) + 1, 3, -1, 0])]
    m = SkyMap.from_frame(spark.createDataFrame([(k, int(x)) for k, x in enumerate(v)], "pix bigint, v bigint"), 8, 128, "int64")
    low = np.iinfo(np.int64).min

    def same(got, want):
        assert {x.pix: x.v for x in got.df.collect()} == {k: int(x) for k, x in enumerate(want) if x != low}

    with np.errstate(over="ignore"):
        for c in (5, -7, 2**62, -(2**63) + 1):
            same(m + c, v + np.int64(c))
            same(m - c, v - np.int64(c))
            same(m * c, v * np.int64(c))
        same(m**3, v**3)
        same(sum_union([m, m, m]), v + v + v)
        same(product_union([m, m, m]), v * v * v)
        same(m.update_values_pix(list(range(len(v))), [int(x) for x in v], operation="add"), v + v)
        small = m.astype("int16", sentinel=-32768)
        assert {x.pix: x.v for x in (small * 3).df.collect()} == {k: int(x) for k, x in enumerate(v.astype(np.int16) * np.int16(3)) if x != -32768 and v.astype(np.int16)[k] != -32768}


def test_last_of_several_values_stays(spark):
    m = SkyMap.make_empty(spark, 8, 128, "int64", sentinel=0).update_values_pix([1, 2, 1, 1, 3, 2], [1, 2, 3, 4, 5, 6], check_unique=False)
    assert {x.pix: x.v for x in m.df.collect()} == {1: 4, 2: 6, 3: 5}
    flags = SkyMap.make_empty(spark, 8, 128, "bool").update_values_pix([1, 2, 1, 2], [True, False, False, True], check_unique=False)
    assert [x.pix for x in flags.df.collect()] == [2]
    rows = spark.createDataFrame([(5, k, (k * 7) % 50) for k in range(50)], "pix bigint, v bigint, t int").repartition(6)
    assert SkyMap.make_empty(spark, 8, 128, "int64").update_values_pix(rows, check_unique=False, order="t").df.collect()[0].v == 7


def test_ranges_are_as_long_as_they_can_be(spark):
    box = Box(10.0, 25.0, -5.0, 10.0, value=True)
    pixels = sorted(x.pix for x in box.get_pixels(spark, 1024).collect())
    ranges = sorted((x.start, x.end) for x in box.get_pixel_ranges(spark, 1024).collect())
    assert [p for a, b in ranges for p in range(a, b)] == pixels
    assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:])) and max(b - a for a, b in ranges) > 4096


def test_long_ranges_and_coarse_cells_are_written_out_in_steps(spark):
    from starquilt.operators.moc import from_moc

    spans = spark.createDataFrame([(5, 9), (16_777_000, 17_000_000), (7, 7)], "start bigint, end bigint")
    got = expand_ranges(spans, 24)
    assert got.count() == 4 + 223_000 and got.agg({"pix": "max"}).first()[0] == 16_999_999
    m = from_moc(spark.createDataFrame([(4 * 4**2 + 3,), (4 * 4**11 + 5,)], "uniq bigint"), 2)
    assert m.nside_sparse == 2048 and m.n_valid == 4**9 + 1
    assert {x.uniq for x in to_moc(m).collect()} == {4 * 4**2 + 3, 4 * 4**11 + 5}


def test_random_positions_of_a_small_field_over_the_meridian(spark):
    m = Circle(0.2, 30.0, 0.7, value=True).get_map(spark, 32, 1024, "bool")
    points = make_uniform_randoms(m, 3000, seed=5)
    looked = m.get_values_pos(points, valid_mask=True)
    assert looked.count() == 3000 and looked.filter("not valid").count() == 0
    assert make_uniform_randoms(m, 0).count() == 0


def test_multi_order_set_at_the_resolution_of_its_map(spark):
    from starquilt.operators.moc import from_moc

    m = SkyMap.make_empty(spark, 8, 128, "bool").update_values_pix([(0, 1024)], True)
    cells = to_moc(m)
    assert {x.uniq for x in cells.collect()} == {4 * 4**3 + i for i in range(4)}
    assert from_moc(cells, 8).nside_sparse == 8
    back = from_moc(cells, 8, 128)
    assert back.nside_sparse == 128 and sorted(x.pix for x in back.df.collect()) == list(range(1024))
    assert from_moc(spark.createDataFrame([(4 * 4**9 + 5,)], "uniq bigint"), 8, 128).nside_sparse == 512


@pytest.fixture
def on_a_border(spark):
    """A position on the border of two pixels of nside 128; its sine comes back otherwise from degrees."""
    return spark.createDataFrame([(67.5, 0.5625)], "ra double, z double").withColumn("dec", F.degrees(F.asin("z")))


def test_positions_by_sine(spark, on_a_border):
    at = {r.z: r.pix for r in px.with_pixel(on_a_border, 128, "ra", "z", sine=True).collect()}
    assert at == {0.5625: 4918}
    m = SkyMap.make_empty(spark, 8, 128).update_values_pix([4918], 7.0)
    assert [r.v for r in m.get_values_pos(on_a_border, "ra", "z", sine=True).collect()] == [7.0]
    # off the borders both ways agree
    many = spark.range(5000).selectExpr("(id * 137.508) % 360 AS ra", "((id * 7919) % 100003) / 50001.5D - 1 AS z").withColumn("dec", F.degrees(F.asin("z")))
    both = px.with_pixel(px.with_pixel(many, 128, "ra", "z", "p", sine=True), 128, "ra", "dec", "q")
    assert both.filter("p <> q").count() == 0


def test_updates_by_sine(spark, on_a_border):
    m = SkyMap.make_empty(spark, 8, 128).update_values_pos(on_a_border.withColumn("v", F.lit(2.0)), None, "ra", "z", operation="add", sine=True)
    assert [(r.pix, r.v) for r in m.df.collect()] == [(4918, 2.0)]
