"""Map algebra: constants, comparisons, boolean maps, and n-ary unions and intersections.

Operations whose order does not matter stack the maps and group by pixel once: one shuffle with partial aggregation
before it, whatever the number of maps. Those whose order does matter join pixel by pixel, in the order of the list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dtypes import SPARK, added, is_float, is_integer, multiplied, total, wrapped
from ..functions.pixelization import UNSEEN
from .skymap import Meta, SkyMap, all_pixels, is_constant, words_of

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b,
}
BITWISE: dict[str, Callable[[Column, Column], Column]] = {"and": lambda a, b: a.bitwiseAND(b), "or": lambda a, b: a.bitwiseOR(b), "xor": lambda a, b: a.bitwiseXOR(b)}


def divided(a: Column, b: Column) -> Column:
    """Division as floating-point units do it: by zero it gives an infinity, and zero by zero NaN."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def floor_divided(a: Column, b: Column) -> Column:
    """Integer division rounding down; by zero it gives 0."""
    safe = F.when(b == 0, F.lit(1)).otherwise(b)
    rest = F.pmod(a, F.abs(safe))
    down = F.call_function("div", a - rest, F.abs(safe))
    return F.when(b == 0, F.lit(0).cast("bigint")).when(b > 0, down).otherwise(F.when(rest == 0, -down).otherwise(-down - 1))


def apply(m: SkyMap, name: str, other: Any) -> SkyMap:
    from .geometry import Shape

    meta = m.meta
    if isinstance(other, Shape):
        if name not in ("and", "or", "add"):
            raise NotImplementedError("shapes are added to a map or combined by and, or")
        return other.onto(m, name)
    if meta.kind == "bool":
        return _boolean(m, name, other)
    if meta.kind == "record":
        raise NotImplementedError("records have no arithmetic; take a column")
    if meta.kind == "wide":
        if name not in BITWISE or not isinstance(other, (list, tuple)):
            raise NotImplementedError("a wide mask is combined with a list of bits")
        words = words_of(other, meta.maxbits)
        return m._new(m.df.select("pix", *[BITWISE[name](F.col(c), F.lit(w).cast("bigint")).alias(c) for c, w in zip(meta.values, words, strict=True)]), m.cov)
    if not is_constant(other):
        raise NotImplementedError("maps meet maps in unions and intersections")
    v, integer = F.col("v"), is_integer(meta.dtype)
    if name in COMPARE:
        out = Meta(meta.nside_coverage, meta.nside_sparse, "bool", "bool", False)
        return SkyMap(m.df.filter(COMPARE[name](v, F.lit(other))).select("pix"), out, m.cov)
    if name in BITWISE:
        if not integer or int(other) != other:
            raise NotImplementedError("bits are of integers")
        return _with(m, wrapped(BITWISE[name](v.cast("bigint"), F.lit(int(other)).cast("bigint")), meta.dtype))
    if integer and (name == "truediv" or not isinstance(other, int)):
        raise TypeError("an integer map stays integer: cast it first")
    c = F.lit(other)
    if integer:
        big = v.cast("bigint")
        if name == "pow":
            if other < 0:
                raise ValueError("integers have no negative powers")
            done = F.aggregate(F.array_repeat(big, int(other)), F.lit(1).cast("bigint"), multiplied)
        else:
            c = F.lit((int(other) + (1 << 63)) % (1 << 64) - (1 << 63)).cast("bigint")
            done = multiplied(big, c) if name == "mul" else added(big, c, 1 if name == "add" else -1)
        return _with(m, wrapped(done, meta.dtype))
    done = {"add": v + c, "sub": v - c, "mul": v * c, "pow": F.pow(v, c), "truediv": divided(v.cast("double"), c.cast("double"))}[name]
    return _with(m, done.cast(SPARK[meta.dtype]))


def _with(m: SkyMap, v: Column) -> SkyMap:
    return m._new(m.df.select("pix", v.alias("v")), m.cov)


def _boolean(m: SkyMap, name: str, other: Any) -> SkyMap:
    if name not in BITWISE:
        raise NotImplementedError("boolean maps know and, or, xor and invert")
    if isinstance(other, bool):
        if name == "and":
            return m if other else SkyMap(m.df.filter(F.lit(False)), m.meta, m.cov)
        if not other:
            return m
        return SkyMap(all_pixels(m.cov, m.meta.bits), m.meta, m.cov) if name == "or" else invert(m)
    if not isinstance(other, SkyMap) or other.meta.kind != "bool":
        raise NotImplementedError("a boolean map is combined with a boolean constant or map")
    if (m.nside_sparse, m.nside_coverage) != (other.nside_sparse, other.nside_coverage):
        raise ValueError("both maps need the same resolutions")
    cov = m.cov.union(other.cov).distinct()
    if name == "and":  # what lies outside the other's coverage is kept
        inside = m.df.join(other.df, "pix", "left_semi")
        beyond = m.df.withColumn("cov_pix", F.shiftright("pix", m.meta.bits)).join(other.cov, "cov_pix", "left_anti").select("pix")
        return SkyMap(inside.union(beyond), m.meta, cov)
    both = m.df.union(other.df)
    df = both.distinct() if name == "or" else both.groupBy("pix").count().filter("count = 1").select("pix")
    return SkyMap(df, m.meta, cov)


def invert(m: SkyMap) -> SkyMap:
    if m.meta.kind != "bool":
        raise NotImplementedError("only boolean maps are inverted")
    return SkyMap(all_pixels(m.cov, m.meta.bits).join(m.df, "pix", "left_anti"), m.meta, m.cov)


# n-ary --------------------------------------------------------------------------------------------------------------
def _checked(maps: Sequence[SkyMap], integers: bool = False) -> Meta:
    if len(maps) < 2:
        raise RuntimeError("at least two maps are combined")
    first = maps[0].meta
    for m in maps:
        if m.meta.kind == "record":
            raise NotImplementedError("records are not combined")
        if integers and not m.is_integer_map:
            raise ValueError("these maps must be integers")
        if (m.nside_sparse, m.nside_coverage) != (first.nside_sparse, first.nside_coverage):
            raise ValueError("all maps need the same resolutions")
        if (m.meta.kind == "wide") != (first.kind == "wide") or m.meta.kind == "wide" and m.meta.maxbits != first.maxbits:
            raise ValueError("wide masks are combined with ones as wide")
    # a boolean input counts as 0 and 1
    return replace(first, kind="scalar", dtype="int64", sentinel=0, packed=False) if first.kind == "bool" else first


def _coverage(maps: Sequence[SkyMap], union: bool) -> DataFrame:
    stacked = reduce(lambda a, b: a.unionAll(b), [m.cov.select("cov_pix").distinct() for m in maps])
    return stacked.distinct() if union else stacked.groupBy("cov_pix").count().filter(F.col("count") == len(maps)).select("cov_pix")


def _values(m: SkyMap, meta: Meta) -> DataFrame:
    return m.df.select("pix", F.lit(1).cast("bigint").alias("v")) if m.meta.kind == "bool" else m.df.select("pix", *meta.values)


def _grouped(maps: Sequence[SkyMap], union: bool, agg: Callable[[str], Column], integers: bool = False, clamp: Callable[[Column], Column] = lambda c: c) -> SkyMap:
    meta = _checked(maps, integers)
    rows = reduce(lambda a, b: a.unionByName(b), [_values(m, meta) for m in maps])
    by = rows.groupBy("pix").agg(F.count("*").alias("_n"), *[agg(c).alias(c) for c in meta.values])
    if not union:
        by = by.filter(F.col("_n") == len(maps))

    def typed(c: str) -> Column:
        if meta.kind == "wide":
            return clamp(F.col(c)).cast("bigint")
        return wrapped(clamp(F.col(c)), meta.dtype) if is_integer(meta.dtype) else clamp(F.col(c)).cast(SPARK[meta.dtype])

    out = by.select("pix", *[typed(c).alias(c) for c in meta.values])
    return SkyMap(out.filter(meta.valid()), replace(meta, metadata=None), _coverage(maps, union))


def _joined(maps: Sequence[SkyMap], union: bool, fold: Callable[[list[Column]], Column], meta: Meta) -> SkyMap:
    df = None
    for k, m in enumerate(maps):
        one = _values(m, replace(meta, kind="scalar")).withColumnRenamed("v", f"_{k}")
        df = one if df is None else df.join(one, "pix", "full_outer" if union else "inner")
    out = df.select("pix", fold([F.col(f"_{k}") for k in range(len(maps))]).cast(SPARK[meta.dtype]).alias("v"))
    return SkyMap(out.filter(meta.valid()), replace(meta, metadata=None), _coverage(maps, union))


def _sum(maps: Sequence[SkyMap]) -> Callable[[str], Column]:
    return (lambda c: total(F.col(c))) if maps and maps[0].is_integer_map else F.sum


def sum_union(maps: Sequence[SkyMap]) -> SkyMap:
    """Sum where any map is valid."""
    return _grouped(maps, True, _sum(maps))


def sum_intersection(maps: Sequence[SkyMap]) -> SkyMap:
    """Sum where all maps are valid."""
    return _grouped(maps, False, _sum(maps))


def _product(c: str) -> Column:
    return F.aggregate(F.collect_list(F.col(c).cast("bigint")), F.lit(1).cast("bigint"), multiplied)  # one value of each map at most


def product_union(maps: Sequence[SkyMap]) -> SkyMap:
    return _grouped(maps, True, _product if maps and maps[0].is_integer_map else F.product)


def product_intersection(maps: Sequence[SkyMap]) -> SkyMap:
    return _grouped(maps, False, _product if maps and maps[0].is_integer_map else F.product)


def or_union(maps: Sequence[SkyMap]) -> SkyMap:
    return _grouped(maps, True, F.bit_or, True)


def or_intersection(maps: Sequence[SkyMap]) -> SkyMap:
    return _grouped(maps, False, F.bit_or, True)


def and_union(maps: Sequence[SkyMap]) -> SkyMap:
    """Bits set in all maps that are valid at the pixel."""
    return _grouped(maps, True, F.bit_and, True)


def and_intersection(maps: Sequence[SkyMap]) -> SkyMap:
    return _grouped(maps, False, F.bit_and, True)


def xor_union(maps: Sequence[SkyMap]) -> SkyMap:
    return _grouped(maps, True, F.bit_xor, True)


def xor_intersection(maps: Sequence[SkyMap]) -> SkyMap:
    return _grouped(maps, False, F.bit_xor, True)


def _no_nan(how: Callable[[Column], Column]) -> Callable[[str], Column]:
    """NaN gives way to numbers."""
    return lambda c: F.coalesce(how(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))), how(F.col(c)))


def max_union(maps: Sequence[SkyMap]) -> SkyMap:
    """Largest value, and 0 where all are below: the fold starts from 0."""
    return _grouped(maps, True, _no_nan(F.max), clamp=lambda c: F.greatest(c, F.lit(0)))


def max_intersection(maps: Sequence[SkyMap]) -> SkyMap:
    return _grouped(maps, False, _no_nan(F.max), clamp=lambda c: F.greatest(c, F.lit(0)))


def _floats(maps: Sequence[SkyMap]) -> None:
    if maps and maps[0].is_integer_map:
        raise ValueError("the smallest of integers has no start value within their type")


def min_union(maps: Sequence[SkyMap]) -> SkyMap:
    _floats(maps)
    return _grouped(maps, True, _no_nan(F.min), clamp=lambda c: F.least(c, F.lit(-UNSEEN)))


def min_intersection(maps: Sequence[SkyMap]) -> SkyMap:
    _floats(maps)
    return _grouped(maps, False, _no_nan(F.min), clamp=lambda c: F.least(c, F.lit(-UNSEEN)))


def divide_intersection(maps: Sequence[SkyMap], dtype_out: str = "float64") -> SkyMap:
    """v0 / v1 / v2 ... where all are valid."""
    meta = _checked(maps)
    if meta.kind != "scalar" or not is_float(meta.dtype):
        raise ValueError("the first map must be of floats")
    return _joined(maps, False, lambda v: reduce(divided, [x.cast("double") for x in v]), replace(meta, dtype=dtype_out))


def floor_divide_intersection(maps: Sequence[SkyMap]) -> SkyMap:
    meta = _checked(maps, True)
    return _joined(maps, False, lambda v: reduce(floor_divided, [x.cast("bigint") for x in v]), meta)


#: Binary functions by name or by NumPy's name; others run as vectorised Python over columns.
FUNCTIONS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": divided, "true_divide": divided, "power": F.pow, "maximum": F.greatest, "minimum": F.least,
    "fmax": F.greatest, "fmin": F.least, "hypot": F.hypot, "arctan2": F.atan2, **{f"bitwise_{k}": f for k, f in BITWISE.items()}, "floor_divide": floor_divided,
}


def _function(func: Any) -> Callable[[Column, Column], Column]:
    name = func if isinstance(func, str) else getattr(func, "__name__", "")
    if name in FUNCTIONS:
        return FUNCTIONS[name]

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(func(a.to_numpy(), b.to_numpy()))

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


def ufunc_union(maps: Sequence[SkyMap], func: Any, filler_value: float = 0) -> SkyMap:
    """Fold of a binary function in the order of the list, from `filler_value`; maps that are not valid at a pixel are skipped."""
    meta, f = _checked(maps), _function(func)

    def fold(values: list[Column]) -> Column:
        kind = SPARK[meta.dtype]
        return reduce(lambda acc, v: F.when(v.isNull(), acc).otherwise(f(acc, F.coalesce(v, F.lit(filler_value).cast(kind)))), values, F.lit(filler_value).cast(kind))

    return _joined(maps, True, fold, meta)


def ufunc_intersection(maps: Sequence[SkyMap], func: Any, filler_value: float = 0) -> SkyMap:
    meta, f = _checked(maps), _function(func)
    return _joined(maps, False, lambda v: reduce(f, v, F.lit(filler_value).cast(SPARK[meta.dtype])), meta)


def concatenate(maps: Sequence[SkyMap], nside_coverage_out: int | None = None, check_overlap: bool = False, or_overlap: bool = False) -> SkyMap:
    """Union of maps of one kind: where they overlap the later one wins, or overlap raises, or integers are OR-ed. Coverage may be of several resolutions."""
    first = maps[0].meta
    for m in maps:
        if (m.nside_sparse, m.meta.kind, m.meta.dtype, m.meta.maxbits) != (first.nside_sparse, first.kind, first.dtype, first.maxbits):
            raise RuntimeError("maps to be concatenated are of one resolution and type")
    meta = replace(first, nside_coverage=nside_coverage_out or first.nside_coverage, metadata=None)
    rows = reduce(lambda a, b: a.unionByName(b), [m.df.withColumn("_k", F.lit(k)) for k, m in enumerate(maps)])
    if or_overlap:
        if first.kind not in ("wide", "bool") and not (first.kind == "scalar" and is_integer(first.dtype)):
            raise ValueError("only integers are OR-ed")
        df = rows.groupBy("pix").agg(*[F.bit_or(c).alias(c) for c in meta.values]) if meta.values else rows.select("pix").distinct()
    else:
        if check_overlap and rows.groupBy("pix").count().filter("count > 1").take(1):
            raise RuntimeError("maps overlap")
        if meta.values:
            last = F.max_by(F.struct(*meta.values), "_k")
            df = rows.groupBy("pix").agg(last.alias("_v")).select("pix", "_v.*")
        else:
            df = rows.select("pix").distinct()
    return SkyMap(df.select("pix", *meta.values), meta, None)

