"""Uniform random positions within the valid pixels of a map."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixelization as px
from ..functions.ranking import first_rows, frozen, numbered_rows
from .skymap import SkyMap


def make_uniform_randoms_fast(m: SkyMap, n: int, nside_randoms: int = 1 << 23, seed: int = 0) -> DataFrame:
    """n positions (id, ra, dec): a valid pixel drawn with replacement, then a pixel of `nside_randoms` below it.

    Pixels are numbered where they lie, by counts of their partitions, without a shuffle, so
    the positions of a seed are the same only while the map is partitioned alike.
    """
    count = m.n_valid
    if not count:
        raise ValueError("the map has no valid pixels")
    k = px.shift_between(nside_randoms, m.nside_sparse)
    numbered = numbered_rows(m.valid_pixels.sortWithinPartitions("pix"), "_n")
    drawn = m.df.sparkSession.range(n).select("id", F.least(F.floor(F.rand(seed) * count), F.lit(count - 1)).cast("bigint").alias("_n"), F.floor(F.rand(seed + 1) * (1 << k)).cast("bigint").alias("_s"))
    at = drawn.join(numbered, "_n").select("id", F.shiftleft("pix", k).bitwiseOR(F.col("_s")).alias("_p"))
    return px.with_angles(at, nside_randoms, "_p", ("ra", "dec")).drop("_p")


def _longitudes(m: SkyMap, pad: float) -> tuple[float, float]:
    """First longitude and width, in degrees, of the shortest arc of whole degrees that holds all pixels, grown by `pad` on both sides."""
    seen = {int(r[0]) % 360 for r in px.with_z_lon(m.valid_pixels, m.nside_sparse).select(F.floor("lon")).distinct().collect()}  # 360 at most
    bins = sorted(seen)
    gaps = [((b - a) % 360 or 360, b) for a, b in zip(bins, bins[1:] + bins[:1], strict=True)]
    gap, first = max(gaps)
    width = 361.0 - gap + 2 * pad
    return (0.0, 360.0) if width >= 360 else (first - pad, width)


def make_uniform_randoms(m: SkyMap, n: int, seed: int = 0) -> DataFrame:
    """n positions (ra, dec), uniform on the sphere's area: drawn in the band of latitudes and the arc of longitudes that the map spans, and kept where the map is valid. Drawing goes on until there are n."""
    spark = m.df.sparkSession
    edge = px.with_z_lon(m.valid_pixels, m.nside_sparse).agg(F.min("z"), F.max("z")).first()
    if edge[0] is None:
        raise ValueError("the map has no valid pixels")
    pad = 2 * px.largest_radius(m.nside_sparse)
    lo, hi = (math.sin(max(-math.pi / 2, min(math.pi / 2, math.asin(z) + s * pad))) for z, s in zip(edge, (-1, 1), strict=True))
    narrow = math.sqrt(max(0.0, 1 - max(abs(lo), abs(hi)) ** 2))
    first, width = _longitudes(m, math.degrees(pad) / narrow) if narrow > pad else (0.0, 360.0)
    share = m.n_valid / px.n_pixels(m.nside_sparse) * 2.0 / (hi - lo) * 360.0 / width
    out, have, k = None, 0, 0
    while have < n:
        size = int((n - have) / max(share, 1e-9) * 1.1) + 1000
        draw = spark.range(size).select((F.lit(lo) + F.rand(seed + 2 * k) * (hi - lo)).alias("_z"), F.pmod(F.lit(first) + F.rand(seed + 2 * k + 1) * width, F.lit(360.0)).alias("ra"))
        got = px.with_pixel_of_z(draw, m.nside_sparse, "_z", "ra", "_p").join(m.valid_pixels.withColumnRenamed("pix", "_p"), "_p", "left_semi")
        got = frozen(got.select("ra", F.degrees(F.asin("_z")).alias("dec")))
        out = got if out is None else out.union(got)
        have += got.count()
        k += 1
    return first_rows(out, n) if out is not None else spark.createDataFrame([], "ra double, dec double")
