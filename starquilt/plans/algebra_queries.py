"""Queries that combine maps with constants, with shapes and with each other."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import algebra, packed
from ..operators.skymap import SkyMap
from .base import COVERAGE, NSIDE, Tables, query, with_relations


# constants ----------------------------------------------------------------------------------------------------------
def _constant(name: str, source: str, sql: str, run: Callable[[SkyMap], SkyMap]) -> None:
    @query(name, with_relations(sql, source))
    def call(t: Tables) -> DataFrame:
        return run(getattr(t, source)()).df


_constant("const_add", "a", "SELECT pix, v + 7 AS v FROM a", lambda m: m + 7.0)
_constant("const_sub", "i", "SELECT pix, v - 7 AS v FROM i", lambda m: m - 7)
_constant("const_mul", "i", "SELECT pix, v * 3 AS v FROM i", lambda m: m * 3)
_constant("const_div", "a", "SELECT pix, v / CAST(8 AS DOUBLE) AS v FROM a", lambda m: m / 8.0)
_constant("const_div_zero", "i", "SELECT pix, CAST(CASE WHEN v > 0 THEN 'inf' WHEN v < 0 THEN '-inf' ELSE 'nan' END AS DOUBLE) AS v FROM i", lambda m: m.astype("float64") / 0.0)
_constant("const_pow", "q", "SELECT pix, v * v AS v FROM q", lambda m: m**2.0)
_constant("const_pow_int", "i", "SELECT pix, v * v * v AS v FROM i", lambda m: m**3)
_constant("const_inplace", "i", "SELECT pix, (v + 5) * 2 AS v FROM i", lambda m: _in_place(m))
_constant("const_lt", "q", "SELECT pix FROM q WHERE v < 20", lambda m: m < 20)
_constant("const_le", "q", "SELECT pix FROM q WHERE v <= 20", lambda m: m <= 20)
_constant("const_gt", "q", "SELECT pix FROM q WHERE v > 20", lambda m: m > 20)
_constant("const_ge", "q", "SELECT pix FROM q WHERE v >= 20", lambda m: m >= 20)
_constant("const_eq", "q", "SELECT pix FROM q WHERE v = 20", lambda m: m == 20)
_constant("const_ne", "q", "SELECT pix FROM q WHERE v <> 20", lambda m: m != 20)
_constant("const_and", "m", "SELECT pix, v & 6 AS v FROM m WHERE v & 6 <> 0", lambda m: m & 6)
_constant("const_or", "m", "SELECT pix, v | 4096 AS v FROM m", lambda m: m | 4096)
_constant("const_xor", "m", "SELECT pix, xor(v, 3) AS v FROM m WHERE xor(v, 3) <> 0", lambda m: m ^ 3)
_constant("wide_and_bits", "w", "SELECT pix, w0 & 18 AS w0, w1 & 64 AS w1 FROM w WHERE w0 & 18 <> 0 OR w1 & 64 <> 0", lambda m: m & [1, 4, 70])
_constant("wide_or_bits", "w", "SELECT pix, w0 | 18 AS w0, w1 | 64 AS w1 FROM w", lambda m: m | [1, 4, 70])
_constant("wide_xor_bits", "w", "SELECT pix, xor(w0, 18) AS w0, xor(w1, 64) AS w1 FROM w WHERE xor(w0, 18) <> 0 OR xor(w1, 64) <> 0", lambda m: m ^ [1, 4, 70])


def _modulo(x: str) -> str:
    """What 64-bit arithmetic makes of the exact result x."""
    turn = 1 << 64
    return f"CAST((({x} + {turn // 2}) % {turn} + {turn}) % {turn} - {turn // 2} AS BIGINT)"


_constant("const_mul_wrap", "big", f"SELECT pix, {_modulo('CAST(v AS HUGEINT) * 5')} AS v FROM big", lambda m: m * 5)
_constant("const_add_wrap", "big", f"SELECT pix, {_modulo('CAST(v AS HUGEINT) + 9000000000000000000')} AS v FROM big", lambda m: m + 9000000000000000000)
_constant("const_sub_wrap", "big", f"SELECT pix, {_modulo('CAST(v AS HUGEINT) - 9000000000000000000')} AS v FROM big", lambda m: m - 9000000000000000000)


def _in_place(m: SkyMap) -> SkyMap:
    m += 5
    m *= 2
    return m


# boolean maps -------------------------------------------------------------------------------------------------------
_DENSE = "SELECT c.cov_pix * 256 + k.range AS pix FROM (SELECT DISTINCT pix >> 8 AS cov_pix FROM ba) c, range(256) k"


def _boolean(name: str, sql: str, run: Callable[[SkyMap, SkyMap], SkyMap]) -> None:
    @query(name, with_relations(sql, "ba", "bb"))
    def call(t: Tables) -> DataFrame:
        return run(t.ba(), t.bb(packed=True)).df


_boolean("bool_and_map", "SELECT pix FROM ba WHERE pix IN (SELECT pix FROM bb) OR pix >> 8 NOT IN (SELECT pix >> 8 FROM bb)", lambda x, y: x & y)
_boolean("bool_or_map", "SELECT pix FROM ba UNION SELECT pix FROM bb", lambda x, y: x | y)
_boolean("bool_xor_map", "(SELECT pix FROM ba EXCEPT SELECT pix FROM bb) UNION (SELECT pix FROM bb EXCEPT SELECT pix FROM ba)", lambda x, y: x ^ y)
_boolean("bool_and_true", "SELECT pix FROM ba", lambda x, _: x & True)
_boolean("bool_and_false", "SELECT pix FROM ba WHERE false", lambda x, _: x & False)
_boolean("bool_or_true", _DENSE, lambda x, _: x | True)
_boolean("bool_xor_true", f"({_DENSE}) EXCEPT SELECT pix FROM ba", lambda x, _: x ^ True)
_boolean("bool_invert", f"({_DENSE}) EXCEPT SELECT pix FROM ba", lambda x, _: ~x)
_boolean("bool_difference", f"SELECT pix FROM ba WHERE pix IN (SELECT c.cov_pix * 256 + k.range FROM (SELECT DISTINCT pix >> 8 AS cov_pix FROM bb) c, range(256) k WHERE c.cov_pix * 256 + k.range NOT IN (SELECT pix FROM bb)) OR pix >> 8 NOT IN (SELECT pix >> 8 FROM bb)", lambda x, y: x & ~y)


# n-ary --------------------------------------------------------------------------------------------------------------
def _stacked(agg: str, maps: str, having: str = "") -> str:
    every = " UNION ALL ".join(f"SELECT pix, v FROM {m}" for m in maps)
    return with_relations(f"SELECT pix, {agg} AS v FROM ({every}) GROUP BY 1 {having}", *maps)


def _many(name: str, agg: str, maps: str) -> None:
    """Both forms of an operation: over pixels valid in any map, and in all."""
    for kind, having in (("union", ""), ("intersection", f"HAVING count(*) = {len(maps)}")):
        def call(t: Tables, f: str = f"{name}_{kind}") -> DataFrame:
            return getattr(algebra, f)([getattr(t, m)() for m in maps]).df

        nonzero = f"{'AND' if having else 'HAVING'} {agg} <> 0" if name in ("or", "and", "xor") else ""
        query(f"{name}_{kind}", _stacked(agg, maps, f"{having} {nonzero}"))(call)


_many("sum", "sum(v)", "abc")
_many("max", "greatest(0, max(v))", "abc")
_many("min", "min(v)", "abc")
_many("product", "product(v)", "qb")
_many("or", "bit_or(v)", "mn")
_many("and", "bit_and(v)", "mn")
_many("xor", "bit_xor(v)", "mn")


@query("sum_union_int", with_relations("SELECT pix, CAST(sum(v) AS BIGINT) AS v FROM (SELECT pix, v FROM i UNION ALL SELECT pix, v FROM j) GROUP BY 1", "i", "j"))
def _sum_int(t: Tables) -> DataFrame:
    return algebra.sum_union([t.i(), t.j()]).df


@query("product_union_int", with_relations("SELECT pix, CAST(product(v) AS BIGINT) AS v FROM (SELECT pix, v FROM i UNION ALL SELECT pix, v FROM j) GROUP BY 1", "i", "j"))
def _product_int(t: Tables) -> DataFrame:
    return algebra.product_union([t.i(), t.j()]).df


@query("or_union_wide", with_relations("SELECT pix, bit_or(w0) AS w0, bit_or(w1) AS w1 FROM (SELECT pix, w0, w1 FROM w UNION ALL SELECT pix, 1, 1 FROM b) GROUP BY 1", "w", "b"))
def _or_wide(t: Tables) -> DataFrame:
    other = SkyMap.make_empty_like(t.w()).set_bits_pix(t.b().df, [0, 64])
    return algebra.or_union([t.w(), other]).df


@query("or_union_bool", with_relations("SELECT pix, CAST(1 AS BIGINT) AS v FROM ba UNION SELECT pix, 1 FROM bb", "ba", "bb"))
def _or_bool(t: Tables) -> DataFrame:
    """Boolean maps give an integer map of ones."""
    return algebra.or_union([t.ba(), t.bb()]).df


@query("divide_intersection", with_relations("SELECT a.pix, a.v / b.v AS v FROM a JOIN b ON a.pix = b.pix", "a", "b"))
def _divide(t: Tables) -> DataFrame:
    return algebra.divide_intersection([t.a(), t.b()]).df


@query("floor_divide_intersection", with_relations("SELECT i.pix, CASE WHEN j.v = 0 THEN 0 ELSE CAST(floor(CAST(i.v AS DOUBLE) / j.v) AS BIGINT) END AS v FROM i JOIN j ON i.pix = j.pix", "i", "j"))
def _floor_divide(t: Tables) -> DataFrame:
    return algebra.floor_divide_intersection([t.i(), t.j()]).df


@query("ufunc_union", with_relations("SELECT coalesce(a.pix, b.pix) AS pix, CAST(10 AS DOUBLE) - coalesce(a.v, 0) - coalesce(b.v, 0) AS v FROM a FULL JOIN b ON a.pix = b.pix", "a", "b"))
def _ufunc_union(t: Tables) -> DataFrame:
    return algebra.ufunc_union([t.a(), t.b()], np.subtract, 10.0).df


@query("ufunc_intersection", with_relations("SELECT a.pix, least(least(CAST(5e6 AS DOUBLE), a.v), b.v) AS v FROM a JOIN b ON a.pix = b.pix", "a", "b"))
def _ufunc_intersection(t: Tables) -> DataFrame:
    return algebra.ufunc_intersection([t.a(), t.b()], np.minimum, 5e6).df


@query("ufunc_python", with_relations("SELECT a.pix, CAST(1e9 AS DOUBLE) % a.v % b.v AS v FROM a JOIN b ON a.pix = b.pix", "a", "b"))
def _ufunc_python(t: Tables) -> DataFrame:
    """A function without a column form runs vectorised in Python."""
    return algebra.ufunc_intersection([t.a(), t.b()], np.fmod, 1e9).df


@query("concatenate_last_wins", with_relations("SELECT coalesce(b.pix, a.pix) AS pix, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.pix = b.pix", "a", "b"))
def _concatenate(t: Tables) -> DataFrame:
    return algebra.concatenate([t.a(), t.b()]).df


@query("concatenate_or", with_relations("SELECT pix, bit_or(v) AS v FROM (SELECT pix, v FROM m UNION ALL SELECT pix, v FROM n) GROUP BY 1", "m", "n"))
def _concatenate_or(t: Tables) -> DataFrame:
    return algebra.concatenate([t.m(), t.n()], nside_coverage_out=2 * COVERAGE, or_overlap=True).df


@query("maps_equal", "SELECT true AS same, true AS differ")
def _equal(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(t.a() == t.a(), t.a() != t.ap())], "same boolean, differ boolean")


@query("cross_resolution_join", with_relations("SELECT a.pix, a.v, g.v AS coarse FROM a JOIN (SELECT pix >> 4 AS pix, max(v) AS v FROM b GROUP BY 1) g ON a.pix >> 4 = g.pix", "a", "b"))
def _cross(t: Tables) -> DataFrame:
    coarse = t.b().degrade(NSIDE // 4, "max").df.select(F.col("pix").alias("_up"), F.col("v").alias("coarse"))
    return t.a().df.withColumn("_up", F.shiftright("pix", 4)).join(coarse, "_up").select("pix", "v", "coarse")


@query("sum_union_wrap", with_relations(f"SELECT pix, {_modulo('sum(CAST(v AS HUGEINT))')} AS v FROM (SELECT * FROM big UNION ALL SELECT pix, v - pix FROM big UNION ALL SELECT * FROM j UNION ALL SELECT * FROM i) GROUP BY 1", "big", "i", "j"))
def _sum_wrap(t: Tables) -> DataFrame:
    big = t.big()
    less = SkyMap(big.df.select("pix", (F.col("v") - F.col("pix")).alias("v")), big.meta, big.cov)
    return algebra.sum_union([big, less, t.j(), t.i()]).df


@query("product_union_wrap", with_relations(f"SELECT coalesce(x.pix, j.pix) AS pix, {_modulo('coalesce(CAST(x.v AS HUGEINT), 1) * coalesce(j.v, 1)')} AS v FROM big x FULL JOIN j ON x.pix = j.pix", "big", "j"))
def _product_wrap(t: Tables) -> DataFrame:
    return algebra.product_union([t.big(), t.j()]).df


# bitmaps ------------------------------------------------------------------------------------------------------------
@query("bitmap_counts", with_relations("SELECT pix >> 15 AS bucket, count(*) AS n FROM ba GROUP BY 1", "ba"))
def _bitmap_counts(t: Tables) -> DataFrame:
    return packed.counts(packed.pack(t.ba(packed=True)))


@query("bitmap_union", with_relations("SELECT pix FROM ba UNION SELECT pix FROM bb", "ba", "bb"))
def _bitmap_union(t: Tables) -> DataFrame:
    return packed.unpack(packed.union([packed.pack(t.ba()), packed.pack(t.bb())]), t.ba()).df


@query("bitmap_intersection", with_relations("SELECT pix FROM ba INTERSECT SELECT pix FROM bb", "ba", "bb"))
def _bitmap_intersection(t: Tables) -> DataFrame:
    return packed.unpack(packed.intersection([packed.pack(t.ba()), packed.pack(t.bb())]), t.ba()).df


@query("bitmap_lookup", with_relations("SELECT event_id, p.pix, ba.pix IS NOT NULL AS valid FROM pts p LEFT JOIN ba ON p.pix = ba.pix", "pts", "ba"))
def _bitmap_lookup(t: Tables) -> DataFrame:
    return packed.contains(packed.pack(t.ba()), t.pts())


@query("bitmap_xor", with_relations("SELECT pix FROM (SELECT pix FROM ba UNION ALL SELECT pix FROM bb) GROUP BY 1 HAVING count(*) = 1", "ba", "bb"))
def _bitmap_xor(t: Tables) -> DataFrame:
    return packed.pixels_of(packed.exclusive([packed.pack(t.ba()), packed.pack(t.bb())]))


@query("bitmap_invert", with_relations("SELECT c.cov_pix * 256 + k.range AS pix FROM (SELECT DISTINCT pix >> 8 AS cov_pix FROM ba) c, range(256) k EXCEPT SELECT pix FROM ba", "ba"))
def _bitmap_invert(t: Tables) -> DataFrame:
    return packed.pixels_of(packed.inverted(packed.pack(t.ba()), t.ba()))


@query("bitmap_set", with_relations("SELECT pix FROM ba UNION SELECT pix FROM pts", "ba", "pts"))
def _bitmap_set(t: Tables) -> DataFrame:
    return packed.pixels_of(packed.with_bits(packed.pack(t.ba()), t.pts()))


@query("bitmap_clear", with_relations("SELECT pix FROM ba EXCEPT SELECT pix FROM bb", "ba", "bb"))
def _bitmap_clear(t: Tables) -> DataFrame:
    return packed.pixels_of(packed.without_bits(packed.pack(t.ba()), t.bb().df))


@query("bitmap_unpack", with_relations("SELECT pix FROM m", "m"))
def _bitmap_unpack(t: Tables) -> DataFrame:
    return packed.unpack(packed.pack(t.m()), t.m()).df
