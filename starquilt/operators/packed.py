"""Boolean maps as bitmaps: 32 768 pixels to a row of (bucket, bitmap), a bit each, the lowest first.

The compact form of a bit-packed map: an eighth of a byte for a pixel in storage and in shuffles, with unions,
intersections and counts that never leave the bitmaps. All of it is built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skymap import SkyMap, all_pixels

BITS, BYTES = 1 << 15, 1 << 12


def pack(m: SkyMap) -> DataFrame:
    """(bucket, bitmap) of the valid pixels of any map."""
    return _packed(m.df)


def unpack(packed: DataFrame, like: SkyMap) -> SkyMap:
    """The boolean map of bitmaps, with the coverage and resolution of another map."""
    base = like.as_bit_packed_map()
    return SkyMap(pixels_of(packed), base.meta, base.cov)


def union(packed: Sequence[DataFrame]) -> DataFrame:
    return _stacked(packed).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def intersection(packed: Sequence[DataFrame]) -> DataFrame:
    both = _stacked(packed).groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("_n")).filter(F.col("_n") == len(packed)).drop("_n")
    return both.filter(F.bitmap_count("bitmap") > 0)


def pixels_of(packed: DataFrame) -> DataFrame:
    """(pix) of the bits that are set."""
    bytes_ = packed.select("bucket", F.hex("bitmap").alias("_h")).select("bucket", "_h", F.explode(F.sequence(F.lit(0), F.lit(BYTES - 1))).alias("_k"))
    value = F.conv(F.substring(F.col("_h"), 2 * F.col("_k") + 1, F.lit(2)), 16, 10).cast("int")
    some = bytes_.select("bucket", "_k", value.alias("_b")).filter("_b <> 0")
    bits = some.select((F.shiftleft("bucket", 15) + 8 * F.col("_k")).alias("_base"), "_b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_i"))
    return bits.filter(F.call_function("bit_get", "_b", "_i") == 1).select((F.col("_base") + F.col("_i")).alias("pix"))


def _packed(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(F.shiftright("pix", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("pix").bitwiseAND(F.lit(BITS - 1))).alias("bitmap"))


def exclusive(packed: Sequence[DataFrame]) -> DataFrame:
    """Bits set in an odd number of the bitmaps."""
    every = reduce(lambda a, b: a.union(b), map(pixels_of, packed))
    return _packed(every.groupBy("pix").count().filter("count % 2 = 1"))


def inverted(packed: DataFrame, like: SkyMap) -> DataFrame:
    """Bits of the covered blocks of `like` that are not set."""
    return _packed(all_pixels(like.cov, like.meta.bits).join(pixels_of(packed), "pix", "left_anti"))


def with_bits(packed: DataFrame, pixels: DataFrame) -> DataFrame:
    """The bits of (pix) set as well."""
    return union([packed, _packed(pixels.select("pix"))])


def without_bits(packed: DataFrame, pixels: DataFrame) -> DataFrame:
    """The bits of (pix) cleared; buckets that become empty go."""
    return _packed(pixels_of(packed).join(pixels.select("pix"), "pix", "left_anti"))


def _stacked(packed: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select("bucket", "bitmap") for p in packed])


def counts(packed: DataFrame) -> DataFrame:
    """(bucket, n): pixels set in each bucket."""
    return packed.select("bucket", F.bitmap_count("bitmap").alias("n"))


def contains(packed: DataFrame, points: DataFrame) -> DataFrame:
    """`points` with `valid`: whether the bit of their `pix` is set. The shuffle is by bucket, a row for 32 768 pixels."""
    at = F.col("pix").bitwiseAND(F.lit(BITS - 1))
    looked = points.withColumn("_bucket", F.shiftright("pix", 15)).join(packed.select(F.col("bucket").alias("_bucket"), "bitmap"), "_bucket", "left")
    byte = F.conv(F.hex(F.call_function("substring", F.col("bitmap"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return looked.select(*[points[c] for c in points.columns], F.coalesce(F.call_function("bit_get", byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("valid"))
