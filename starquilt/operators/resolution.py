"""Changing resolution, and interpolation between pixels."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixelization as px
from ..functions.dtypes import SPARK, check_sentinel, is_float, is_integer
from .skymap import Meta, SkyMap, all_pixels, blocks

REDUCTIONS = ("mean", "median", "std", "max", "min", "sum", "prod", "and", "or", "wmean")


def reduced(reduction: str, v: Column, w: Column | None = None) -> Column:
    """The aggregate of a reduction over valid values."""
    if reduction == "wmean":
        return F.sum(v * w) / F.sum(w)
    return {"mean": F.avg, "median": F.median, "std": F.stddev_pop, "max": F.max, "min": F.min, "sum": F.sum, "prod": F.product}[reduction](v)


def degrade(m: SkyMap, nside_out: int, reduction: str = "mean", weights: SkyMap | None = None, empty_groups: str = "value") -> SkyMap:
    """The map at a coarser resolution.

    Sums and products of coarse pixels without a valid one are 0 and 1 inside covered blocks; `empty_groups="null"`
    leaves them out. And/or of integers work on all pixels of a group, where what is not valid counts as the sentinel.
    """
    meta = m.meta
    if reduction not in REDUCTIONS:
        raise ValueError(f"no such reduction: {reduction}")
    if nside_out > m.nside_sparse:
        raise ValueError("a map is not degraded to a finer resolution")
    if nside_out == m.nside_sparse:
        return m
    if weights is not None and reduction != "wmean":
        warnings.warn("weights are for the weighted mean only", UserWarning, stacklevel=3)
        weights = None
    if reduction == "wmean" and weights is None:
        raise ValueError("a weighted mean needs weights")
    if meta.packed and (weights is not None or nside_out < m.nside_coverage):
        raise NotImplementedError("a bit-packed map is degraded without weights, and not beyond its coverage")
    k = px.shift_between(m.nside_sparse, nside_out)
    nc = m.nside_coverage
    if nside_out < nc:
        warnings.warn("the result is coarser than the coverage, which is made as coarse", ResourceWarning, stacklevel=3)
        nc = nside_out
    cov = m.cov if nc == m.nside_coverage else blocks(m.df, px.shift_between(m.nside_sparse, nc))  # made anew from the valid pixels
    up = F.shiftright("pix", k).alias("pix")
    full = 1 << k

    if meta.kind == "wide":
        if reduction not in ("and", "or"):
            raise NotImplementedError("wide masks are degraded by and, or")
        out = replace(meta, nside_coverage=nc, nside_sparse=nside_out)
        if reduction == "or":
            df = m.df.groupBy(up).agg(*[F.bit_or(c).alias(c) for c in meta.values])
        else:
            df = m.df.groupBy(up).agg(F.count("*").alias("_n"), *[F.bit_and(c).alias(c) for c in meta.values]).filter(F.col("_n") == full).drop("_n")
        return SkyMap(df.filter(out.valid()), out, cov)
    if reduction in ("and", "or"):
        if meta.kind == "bool":
            df = m.df.groupBy(up).count()
            df = (df if reduction == "or" else df.filter(F.col("count") == full)).select("pix")
            return SkyMap(df, replace(meta, nside_coverage=nc, nside_sparse=nside_out), cov)
        if meta.kind != "scalar" or not is_integer(meta.dtype):
            raise ValueError("and, or are for integers")
        out = replace(meta, nside_coverage=nc, nside_sparse=nside_out)
        how, mix = (F.bit_and, lambda a, b: a.bitwiseAND(b)) if reduction == "and" else (F.bit_or, lambda a, b: a.bitwiseOR(b))
        v, s = F.col("v").cast("bigint"), F.lit(int(meta.sentinel)).cast("bigint")
        df = m.df.groupBy(up).agg(F.count("*").alias("_n"), how(v).alias("_v"))
        df = df.select("pix", F.when(F.col("_n") == full, F.col("_v")).otherwise(mix(F.col("_v"), s)).cast(SPARK[meta.dtype]).alias("v"))
        return SkyMap(df.filter(out.valid()), out, cov)

    columns = {"v": "float64"} if meta.kind == "bool" else {"v": meta.dtype} if meta.kind == "scalar" else meta.dtype
    kinds = {c: t if is_float(t) else "float64" for c, t in columns.items()}
    rows = m.df.select("pix", F.lit(1.0).alias("v")) if meta.kind == "bool" else m.df
    w = None
    if weights is not None:
        if weights.meta.kind != "scalar" or not is_float(weights.meta.dtype):
            raise ValueError("weights are floats")
        if (weights.nside_sparse, weights.nside_coverage) != (m.nside_sparse, m.nside_coverage):
            raise ValueError("weights need the map's resolutions")
        other = weights.df.select("pix", F.col("v").alias("_w"))
        seen = rows.select("pix", F.lit(1).alias("_n")).unionAll(other.select("pix", F.lit(2).alias("_n")))
        if seen.groupBy("pix").agg(F.sum("_n").alias("_n")).filter("_n <> 3").take(1):  # one shuffle with partial sums, and nothing to keep
            raise ValueError("weights need the map's valid pixels")
        rows, w = rows.join(other, "pix"), F.col("_w")
    # NaN is a value of a map, but reductions pass over it; a column of a record also over its own sentinel's rows
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in kinds}
    df = rows.groupBy(up).agg(*[reduced(reduction, clean[c], None if w is None else F.when(clean[c].isNotNull(), w)).cast(SPARK[t]).alias(c) for c, t in kinds.items()])
    if reduction in ("sum", "prod") and empty_groups == "value":
        every = all_pixels(cov, px.shift_between(nside_out, nc))
        df = every.join(df, "pix", "left").select("pix", *[F.coalesce(c, F.lit(0.0 if reduction == "sum" else 1.0).cast(SPARK[t])).alias(c) for c, t in kinds.items()])
    if meta.kind == "record":
        out = Meta(nc, nside_out, "record", kinds, check_sentinel(kinds[meta.primary]), meta.primary, metadata=meta.metadata)
        df = df.select("pix", *[F.coalesce(c, F.lit(px.UNSEEN).cast(SPARK[t])).alias(c) for c, t in kinds.items()])
    else:
        out = Meta(nc, nside_out, "scalar", kinds["v"], px.UNSEEN, metadata=meta.metadata)
    return SkyMap(df.filter(out.valid()), out, cov)


def degrade_report(m: SkyMap, nside_out: int, reduction: str = "mean") -> DataFrame:
    """(pix, v, n, fraction): a degraded map of numbers beside the count and share of valid pixels, from one shuffle."""
    if m.meta.kind != "scalar":
        raise NotImplementedError("only maps of numbers are reported on")
    k = px.shift_between(m.nside_sparse, nside_out)
    v = F.when(~F.isnan(F.col("v").cast("double")), F.col("v").cast("double"))
    rows = m.df.groupBy(F.shiftright("pix", k).alias("pix")).agg(reduced(reduction, v).alias("v"), F.count("*").alias("n"))
    return rows.withColumn("fraction", F.col("n") / F.lit(float(1 << k)))


def upgrade(m: SkyMap, nside_out: int) -> SkyMap:
    """Each value repeated in the finer pixels below its pixel."""
    if m.meta.kind == "wide" or m.meta.packed:
        raise NotImplementedError("this kind of map is not upgraded")
    if nside_out <= m.nside_sparse:
        raise ValueError("a map is upgraded to a finer resolution")
    k = px.shift_between(nside_out, m.nside_sparse)
    fine = F.explode(F.sequence(F.shiftleft("pix", k), F.shiftleft(F.col("pix") + 1, k) - 1)).alias("pix")
    return SkyMap(m.df.select(fine, *m.meta.values), replace(m.meta, nside_sparse=nside_out), m.cov)


def rollup(m: SkyMap, nsides: list[int], reduction: str = "mean") -> DataFrame:
    """(nside, pix, v) of several resolutions from one pass: levels are exploded and aggregated in one shuffle."""
    levels = F.array(*[F.struct(F.lit(n).alias("nside"), F.shiftright("pix", px.shift_between(m.nside_sparse, n)).alias("pix")) for n in nsides])
    rows = m.df.select(F.explode(levels).alias("_l"), "v").select("_l.nside", "_l.pix", "v")
    return rows.groupBy("nside", "pix").agg(reduced(reduction, F.col("v").cast("double")).alias("v"))


def interpolate_pos(m: SkyMap, points: DataFrame, a: str = "ra", b: str = "dec", lonlat: bool = True, allow_partial: bool = False) -> DataFrame:
    """`points` with `v` interpolated from the four pixels around; UNSEEN where one of them (with `allow_partial`, each) is not valid."""
    if m.meta.kind != "scalar":
        raise NotImplementedError("only maps of numbers are interpolated")
    rows = points.withColumn("_row", F.monotonically_increasing_id())
    near = px.explode_neighbours(rows, m.nside_sparse, a, b, ("_p", "_w"), lonlat)
    met = near.join(m.df.select(F.col("pix").alias("_pix"), F.col("v").cast("double").alias("_v")), F.col("_p") == F.col("_pix"), "left")
    seen = F.col("_v").isNotNull()
    by = met.groupBy("_row", *points.columns).agg(F.sum(F.when(seen, F.col("_v") * F.col("_w"))).alias("_s"), F.sum(F.when(seen, F.col("_w"))).alias("_t"), F.count("_v").alias("_n"))
    good = (F.col("_n") == 4) if not allow_partial else (F.col("_t") > 0)
    return by.select(*points.columns, F.when(good, F.col("_s") / F.col("_t")).otherwise(F.lit(px.UNSEEN)).alias("v"))


