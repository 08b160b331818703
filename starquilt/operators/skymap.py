"""Sparse sky maps: a relation of valid pixels, a small relation of covered blocks, and a few scalars.

A map's rows are its valid pixels only, one each: `pix` (nested number at the fine resolution) with `v`, the named
columns of a record, the 64-bit words `w0..` of a wide mask, or nothing more for a boolean map, whose rows are its
True pixels. Coverage, the coarse pixels that are allocated, is a relation of its own, since it may reach beyond the
valid pixels and some operations act on all pixels of covered blocks. Maps are never changed in place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixelization as px
from ..functions.dtypes import SPARK, added, check_sentinel, is_float, is_integer, limits, total, wrapped

MAX_COVERAGE = 128


@dataclass(frozen=True)
class Meta:
    """What a map is, apart from its rows. kind: scalar, record, wide or bool; dtype: a name, or names by column for a record."""

    nside_coverage: int
    nside_sparse: int
    kind: str
    dtype: Any
    sentinel: Any
    primary: str | None = None
    maxbits: int = 0
    packed: bool = False
    metadata: dict | None = field(default=None, compare=False)

    @property
    def bits(self) -> int:
        return px.shift_between(self.nside_sparse, self.nside_coverage)

    @property
    def values(self) -> list[str]:
        if self.kind == "record":
            return list(self.dtype)
        if self.kind == "wide":
            return [f"w{k}" for k in range(max(1, -(-self.maxbits // 64)))]
        return ["v"] if self.kind == "scalar" else []

    def schema(self) -> str:
        if self.kind == "record":
            return "pix bigint, " + ", ".join(f"`{c}` {SPARK[t]}" for c, t in self.dtype.items())
        kind = "bigint" if self.kind == "wide" else SPARK.get(self.dtype, "")
        return ", ".join(["pix bigint", *(f"{c} {kind}" for c in self.values)])

    def valid(self) -> Column:
        """A row's value is no sentinel; NaN counts as a value."""
        if self.kind == "bool":
            return F.lit(True)
        if self.kind == "wide":
            return reduce(lambda a, b: a | b, [F.col(c) != 0 for c in self.values])
        c = F.col(self.primary or "v")
        return c.isNotNull() & (c != F.lit(self.sentinel).cast(SPARK[self.dtype[self.primary] if self.kind == "record" else self.dtype]))


def words_of(bits: Sequence[int], maxbits: int) -> list[int]:
    """Signed 64-bit words with the given bits set."""
    words = [0] * max(1, -(-maxbits // 64))
    for b in bits:
        if isinstance(b, bool) or int(b) != b:
            raise NotImplementedError("bits are integers")
        if not 0 <= b < maxbits:
            raise ValueError(f"bit {b} is not below {maxbits}")
        words[b // 64] |= 1 << (b % 64)
    return [w - (1 << 64) if w >> 63 else w for w in words]


def pixels_frame(spark: SparkSession, pixels: DataFrame | Sequence[int]) -> DataFrame:
    """A relation (pix) of pixels given as one or as a local sequence."""
    if isinstance(pixels, DataFrame):
        return pixels
    return spark.createDataFrame([(int(p),) for p in pixels], "pix bigint")


#: Bits by which one step writes out pixels below others: 4096 for each row at most.
STEP_BITS = 12


def expand_ranges(ranges: DataFrame, bits: int) -> DataFrame:
    """Pixels of half-open ranges (start, end). Ranges are cut at block borders, and the parts at finer borders, each time dealt out before they are written out, so a long one is no single task's and no row holds a long array."""
    rest = [c for c in ranges.columns if c not in ("start", "end")]
    df = ranges.filter(F.col("end") > F.col("start"))
    # from the borders of blocks, or coarser ones for very long ranges, down to those of STEP_BITS
    for k in range(max(bits, STEP_BITS) + STEP_BITS * 2, 0, -STEP_BITS):
        df = df.select(*rest, "start", "end", F.explode(F.sequence(F.shiftright("start", k), F.shiftright(F.col("end") - 1, k))).alias("_b"))
        df = df.select(*rest, F.greatest("start", F.shiftleft("_b", k)).alias("start"), F.least("end", F.shiftleft(F.col("_b") + 1, k)).alias("end"))
        if k <= max(bits, STEP_BITS):
            df = df.repartition("start")
    return df.select(*rest, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pix"))


def expand_pixels(df: DataFrame, bits: Column | int, most: int) -> DataFrame:
    """All pixels `bits` (at most `most`) below each `pix`, in steps that are dealt out."""
    rest = [c for c in df.columns if c != "pix"]
    df = df.withColumn("_bits", F.lit(bits) if isinstance(bits, int) else bits)
    for _ in range(-(-most // STEP_BITS)):
        now = F.least("_bits", F.lit(STEP_BITS))
        base = F.call_function("shiftleft", F.col("pix"), now)
        count = F.call_function("shiftleft", F.lit(1).cast("bigint"), now)
        df = df.repartition("pix").select(*rest, (F.col("_bits") - now).alias("_bits"), F.explode(F.sequence(base, base + count - 1)).alias("pix"))
    return df.drop("_bits")


class SkyCoverage:
    """Covered coarse pixels."""

    def __init__(self, nside_coverage: int, nside_sparse: int, df: DataFrame):
        self.nside_coverage, self.nside_sparse, self.df = nside_coverage, nside_sparse, df

    @classmethod
    def make_empty(cls, spark: SparkSession, nside_coverage: int, nside_sparse: int) -> SkyCoverage:
        return cls.make_from_pixels(spark, nside_coverage, nside_sparse, [])

    @classmethod
    def make_from_pixels(cls, spark: SparkSession, nside_coverage: int, nside_sparse: int, cov_pixels: Sequence[int]) -> SkyCoverage:
        px.shift_between(nside_sparse, nside_coverage)
        return cls(nside_coverage, nside_sparse, spark.createDataFrame([(int(c),) for c in sorted(set(cov_pixels))], "cov_pix bigint"))

    @staticmethod
    def read(spark: SparkSession, path: str) -> SkyCoverage:
        from ..sources import read_coverage

        return read_coverage(spark, path)

    def append_pixels(self, cov_pixels: Sequence[int] | DataFrame) -> SkyCoverage:
        more = cov_pixels if isinstance(cov_pixels, DataFrame) else self.df.sparkSession.createDataFrame([(int(c),) for c in cov_pixels], "cov_pix bigint")
        return SkyCoverage(self.nside_coverage, self.nside_sparse, self.df.union(more.select("cov_pix")).distinct())

    initialize_pixels = append_pixels

    @property
    def bit_shift(self) -> int:
        return px.shift_between(self.nside_sparse, self.nside_coverage)

    @property
    def nfine_per_cov(self) -> int:
        return 1 << self.bit_shift

    def cov_pixels(self, pix: Column) -> Column:
        return F.shiftright(pix, self.bit_shift)

    def coverage_mask(self) -> DataFrame:
        """(cov_pix, covered) of every coarse pixel."""
        every = self.df.sparkSession.range(px.n_pixels(self.nside_coverage)).withColumnRenamed("id", "cov_pix")
        return every.join(self.df.select("cov_pix", F.lit(True).alias("_in")), "cov_pix", "left").select("cov_pix", F.coalesce("_in", F.lit(False)).alias("covered"))

    def copy(self) -> SkyCoverage:
        return self

    def __contains__(self, cov_pix: int) -> bool:
        return bool(self.df.filter(F.col("cov_pix") == int(cov_pix)).take(1))

    def __repr__(self) -> str:
        return f"SkyCoverage(nside_coverage={self.nside_coverage}, nside_sparse={self.nside_sparse})"


class SkyMap:
    """A sparse map; see the module's text for its rows."""

    def __init__(self, df: DataFrame, meta: Meta, cov: DataFrame | None = None):
        self.df, self.meta, self._cov = df, meta, cov

    # making ---------------------------------------------------------------------------------------------------------
    @classmethod
    def make_empty(cls, spark: SparkSession, nside_coverage: int, nside_sparse: int, dtype: Any = "float64", primary: str | None = None, sentinel: Any = None, wide_mask_maxbits: int = 0, metadata: dict | None = None, cov_pixels: Sequence[int] = (), bit_packed: bool = False) -> SkyMap:
        """A map without valid pixels; `cov_pixels` are covered all the same."""
        meta = describe(nside_coverage, nside_sparse, dtype, primary, sentinel, wide_mask_maxbits, metadata, bit_packed)
        cov = spark.createDataFrame([(int(c),) for c in sorted(set(cov_pixels))], "cov_pix bigint")
        return cls(spark.createDataFrame([], meta.schema()), meta, cov)

    @classmethod
    def make_empty_like(cls, other: SkyMap, **changes: Any) -> SkyMap:
        m = other.meta
        base = {"nside_coverage": m.nside_coverage, "nside_sparse": m.nside_sparse, "dtype": m.dtype, "primary": m.primary, "sentinel": None if m.kind in ("wide", "bool") else m.sentinel, "wide_mask_maxbits": m.maxbits, "metadata": m.metadata, "bit_packed": m.packed}
        return cls.make_empty(other.df.sparkSession, **(base | changes))

    @classmethod
    def from_frame(cls, df: DataFrame, nside_coverage: int, nside_sparse: int, dtype: Any = "float64", cov: DataFrame | None = None, **how: Any) -> SkyMap:
        """A map of the rows of `df`, which has `pix` once each and the value columns; rows with the sentinel are left out but stay covered."""
        meta = describe(nside_coverage, nside_sparse, dtype, how.get("primary"), how.get("sentinel"), how.get("wide_mask_maxbits", 0), how.get("metadata"), how.get("bit_packed", False))
        if meta.kind == "bool" and "v" in df.columns:
            cov = cov if cov is not None else blocks(df, meta.bits)
            return cls(df.filter("v").select(F.col("pix").cast("bigint").alias("pix")), meta, cov)
        kinds = dict(x.split(" ") for x in meta.schema().replace("`", "").split(", "))
        rows = df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ["pix", *meta.values]])
        return cls(rows.filter(meta.valid()), meta, cov)

    @classmethod
    def convert_healpix_map(cls, df: DataFrame, nside_coverage: int, nside_sparse: int, nest: bool = True, sentinel: float | None = None) -> SkyMap:
        """From a full-sky relation (pix, v): values above UNSEEN are kept, so NaN is not."""
        if not nest:
            df = px.with_nest(df.withColumnRenamed("pix", "_ring_in"), nside_sparse, "_ring_in").select("pix", "v")
        return cls.from_frame(df.filter((F.col("v") > F.lit(px.UNSEEN)) & ~F.isnan("v")), nside_coverage, nside_sparse, "float64", sentinel=sentinel)

    def _new(self, df: DataFrame, cov: DataFrame | None, **changes: Any) -> SkyMap:
        meta = replace(self.meta, **changes) if changes else self.meta
        return SkyMap(df.filter(meta.valid()) if meta.kind != "bool" else df, meta, cov)

    def copy(self) -> SkyMap:
        return SkyMap(self.df, replace(self.meta, metadata=None), self._cov)

    __copy__ = copy

    # coverage -------------------------------------------------------------------------------------------------------
    @property
    def cov(self) -> DataFrame:
        """(cov_pix) of the covered blocks."""
        return self._cov if self._cov is not None else blocks(self.df, self.meta.bits)

    @property
    def coverage(self) -> SkyCoverage:
        return SkyCoverage(self.nside_coverage, self.nside_sparse, self.cov)

    @property
    def coverage_mask(self) -> DataFrame:
        return self.coverage.coverage_mask()

    @property
    def coverage_map(self) -> DataFrame:
        """(cov_pix, fraction) of every coarse pixel: the share of its pixels that is valid."""
        got = self.df.groupBy(F.shiftright("pix", self.meta.bits).alias("cov_pix")).count()
        every = self.df.sparkSession.range(px.n_pixels(self.nside_coverage)).withColumnRenamed("id", "cov_pix")
        return every.join(got, "cov_pix", "left").select("cov_pix", (F.coalesce("count", F.lit(0)) / F.lit(float(1 << self.meta.bits))).alias("fraction"))

    # accessors ------------------------------------------------------------------------------------------------------
    nside_coverage = property(lambda self: self.meta.nside_coverage)
    nside_sparse = property(lambda self: self.meta.nside_sparse)
    dtype = property(lambda self: self.meta.dtype)
    sentinel = property(lambda self: self.meta.sentinel)
    primary = property(lambda self: self.meta.primary)
    is_rec_array = property(lambda self: self.meta.kind == "record")
    is_wide_mask_map = property(lambda self: self.meta.kind == "wide")
    is_bit_packed_map = property(lambda self: self.meta.packed)
    is_integer_map = property(lambda self: self.meta.kind in ("bool", "wide") or self.meta.kind == "scalar" and is_integer(self.meta.dtype))
    is_unsigned_map = property(lambda self: self.meta.kind == "wide" or self.meta.kind == "scalar" and self.meta.dtype.startswith("uint"))
    wide_mask_maxbits = property(lambda self: self.meta.maxbits)
    wide_mask_width = property(lambda self: self.meta.maxbits // 8)
    metadata = property(lambda self: self.meta.metadata)

    def with_metadata(self, metadata: dict | None) -> SkyMap:
        return SkyMap(self.df, replace(self.meta, metadata=checked_metadata(metadata)), self._cov)

    @property
    def valid_pixels(self) -> DataFrame:
        return self.df.select("pix")

    def valid_pixels_pos(self, lonlat: bool = True, return_pixels: bool = False) -> DataFrame:
        out = px.with_angles(self.valid_pixels, self.nside_sparse, "pix", ("ra", "dec") if lonlat else ("theta", "phi"), lonlat)
        return out if return_pixels else out.drop("pix")

    def valid_pixels_single_covpix(self, cov_pix: int) -> DataFrame:
        """A range of pixel ids, which reaches the scan as min/max filters."""
        return self._block(cov_pix).select("pix")

    def iter_valid_pixels_by_covpix(self) -> Iterator[DataFrame]:
        return (self.valid_pixels_single_covpix(r[0]) for r in self.cov.orderBy("cov_pix").toLocalIterator())

    @property
    def n_valid(self) -> int:
        return self.df.count()

    def get_valid_area(self, degrees: bool = True) -> float:
        return self.n_valid * px.pixel_area(self.nside_sparse, degrees)

    def fracdet_map(self, nside: int) -> SkyMap:
        """The share of valid pixels in each pixel of `nside`."""
        if not self.nside_coverage <= nside <= self.nside_sparse:
            raise ValueError("nside of a fraction map lies between the map's two resolutions")
        k = px.shift_between(self.nside_sparse, nside)
        df = self.df.groupBy(F.shiftright("pix", k).alias("pix")).agg((F.count("*") / F.lit(float(1 << k))).alias("v"))
        return SkyMap(df, Meta(self.nside_coverage, nside, "scalar", "float64", 0.0), self._cov)

    def _block(self, cov_pix: int) -> DataFrame:
        lo = int(cov_pix) << self.meta.bits
        return self.df.filter((F.col("pix") >= lo) & (F.col("pix") < lo + (1 << self.meta.bits)))

    def get_single_covpix_map(self, covpix: int) -> SkyMap:
        return SkyMap(self._block(covpix), self.meta, self.cov.filter(F.col("cov_pix") == int(covpix)))

    def get_covpix_maps(self) -> Iterator[SkyMap]:
        return (self.get_single_covpix_map(r[0]) for r in self.cov.orderBy("cov_pix").toLocalIterator())

    def get_single(self, key: str, sentinel: Any = None) -> SkyMap:
        """One column of a record as a map. With a sentinel of its own the primary column decides what is valid, else the column does."""
        if self.meta.kind != "record":
            raise TypeError("only records have columns")
        meta = Meta(self.nside_coverage, self.nside_sparse, "scalar", self.meta.dtype[key], check_sentinel(self.meta.dtype[key], sentinel))
        out = SkyMap(self.df.select("pix", F.col(key).alias("v")), meta, self.cov)
        return out if sentinel is not None else SkyMap(out.df.filter(meta.valid()), meta, self.cov)

    def as_bit_packed_map(self) -> SkyMap:
        return SkyMap(self.df.select("pix"), Meta(self.nside_coverage, self.nside_sparse, "bool", "bool", False, packed=True), self.cov)

    def astype(self, dtype: str, sentinel: Any = None) -> SkyMap:
        if self.meta.kind in ("record", "wide") or self.meta.packed and dtype != "bool":
            raise ValueError("this kind of map cannot be cast")
        meta = describe(self.nside_coverage, self.nside_sparse, dtype, None, sentinel, 0, self.metadata, False)
        v = F.lit(1) if self.meta.kind == "bool" else F.col("v")
        if meta.kind == "bool":
            return SkyMap(self.df.filter(v != 0).select("pix"), meta, self.cov)
        v = wrapped(v.cast("double").cast("bigint") if self.meta.kind == "scalar" and is_float(self.meta.dtype) else v, dtype) if is_integer(dtype) else v.cast(SPARK[dtype])
        return SkyMap(self.df.select("pix", v.alias("v")).filter(meta.valid()), meta, self.cov)

    # lookups --------------------------------------------------------------------------------------------------------
    def get_values_pix(self, points: DataFrame | Sequence[int], nest: bool = True, valid_mask: bool = False, nside: int | None = None) -> DataFrame:
        """`points` with the map's values at their `pix` (the sentinel where there is none), or with `valid`."""
        points = pixels_frame(self.df.sparkSession, points)
        at = nside or self.nside_sparse
        if at < self.nside_sparse:
            raise ValueError("pixels coarser than the map have no single value")
        key = "_at"
        looked = px.with_nest(points, at, "pix", key) if not nest else points.withColumn(key, F.col("pix"))
        looked = looked.withColumn(key, F.shiftright(key, px.shift_between(at, self.nside_sparse)))
        return self._gather(looked, key, valid_mask)

    def get_values_pos(self, points: DataFrame, a: str = "ra", b: str = "dec", lonlat: bool = True, valid_mask: bool = False, sine: bool = False) -> DataFrame:
        """The same for positions; with `sine`, `b` is the sine of the latitude."""
        return self._gather(px.with_pixel(points, self.nside_sparse, a, b, "_at", lonlat, sine), "_at", valid_mask)

    def _gather(self, points: DataFrame, key: str, valid_mask: bool) -> DataFrame:
        keep = [c for c in points.columns if c != key]
        here = self.df.select(F.col("pix").alias("_pix"), *[F.col(c).alias(f"_v_{c}") for c in self.meta.values])
        met = points.join(here, points[key] == here["_pix"], "left")
        found = F.col("_pix").isNotNull()
        if valid_mask:
            return met.select(*[points[c] for c in keep], found.alias("valid"))
        if self.meta.kind == "bool":
            return met.select(*[points[c] for c in keep], found.alias("v"))
        return met.select(*[points[c] for c in keep], *[F.coalesce(f"_v_{c}", F.lit(self._missing(c)).cast(kind)).alias(c) for c, kind in self._kinds().items()])

    def _kinds(self) -> dict[str, str]:
        m = self.meta
        return {c: "bigint" if m.kind == "wide" else SPARK[m.dtype[c] if m.kind == "record" else m.dtype] for c in m.values}

    def _missing(self, column: str) -> Any:
        m = self.meta
        if m.kind == "wide":
            return 0
        return m.sentinel if m.kind != "record" or column == m.primary else check_sentinel(m.dtype[column])

    def check_bits_pix(self, points: DataFrame | Sequence[int], bits: Sequence[int], nest: bool = True) -> DataFrame:
        """`points` with `set`: whether any of the bits is."""
        return self._any_bit(self.get_values_pix(points, nest), bits)

    def check_bits_pos(self, points: DataFrame, bits: Sequence[int], a: str = "ra", b: str = "dec", lonlat: bool = True, sine: bool = False) -> DataFrame:
        return self._any_bit(self.get_values_pos(points, a, b, lonlat, sine=sine), bits)

    def _any_bit(self, looked: DataFrame, bits: Sequence[int]) -> DataFrame:
        if self.meta.kind != "wide":
            raise NotImplementedError("only wide masks have bits")
        return looked.withColumn("set", self.bit_test(bits)).drop(*self.meta.values)

    def bit_test(self, bits: Sequence[int]) -> Column:
        return reduce(lambda a, b: a | b, [F.col(f"w{k}").bitwiseAND(F.lit(w).cast("bigint")) != 0 for k, w in enumerate(words_of(bits, self.meta.maxbits)) if w] or [F.lit(False)])

    def __getitem__(self, key: Any) -> Any:
        """A column of a record, the value of one pixel, or a relation of the values of a slice or a list of pixels."""
        if isinstance(key, str):
            return self.get_single(key)
        if isinstance(key, slice):
            start, stop, step = key.start or 0, px.n_pixels(self.nside_sparse) if key.stop is None else key.stop, key.step or 1
            return self.get_values_pix(self.df.sparkSession.range(start, stop, step).withColumnRenamed("id", "pix"))
        if isinstance(key, bool) or not (hasattr(key, "__index__") or isinstance(key, (list, tuple)) or hasattr(key, "tolist")):
            raise IndexError("pixels are integers, slices or lists of integers")
        if hasattr(key, "__index__") and not hasattr(key, "__len__"):
            row = self.get_values_pix([int(key)]).drop("pix").first()
            return row[0] if len(row) == 1 else row
        pixels = key.tolist() if hasattr(key, "tolist") else list(key)
        if any(isinstance(p, bool) or not hasattr(p, "__index__") for p in pixels):
            raise IndexError("pixels are integers")
        return self.get_values_pix(pixels)

    # updates --------------------------------------------------------------------------------------------------------
    def with_items(self, key: Any, value: Any) -> SkyMap:
        """What `m[key] = value` does elsewhere: one pixel, a slice, or a list of pixels replaced; None takes them out."""
        if isinstance(key, slice):
            start, stop, step = key.start or 0, px.n_pixels(self.nside_sparse) if key.stop is None else key.stop, key.step or 1
            if isinstance(value, (list, tuple)) and self.meta.kind not in ("wide", "record"):
                return self.update_values_pix(list(range(start, stop, step)), value)
            if step == 1:
                return self.update_values_pix([(start, stop)], value)
            return self.update_values_pix(self.df.sparkSession.range(start, stop, step).withColumnRenamed("id", "pix"), value)
        if isinstance(key, (str, bool, float)):
            raise IndexError("pixels are integers, slices or lists of integers")
        pixels = key.tolist() if hasattr(key, "tolist") else key
        pixels = [pixels] if hasattr(pixels, "__index__") else list(pixels)
        if any(isinstance(p, bool) or not hasattr(p, "__index__") for p in pixels):
            raise IndexError("pixels are integers")
        return self.update_values_pix(pixels, value)

    def update_values_pix(self, pixels: DataFrame | Sequence[int], values: Any = None, nest: bool = True, operation: str = "replace", check_unique: bool = True, order: str | None = None) -> SkyMap:
        """A map with the given pixels replaced, added to, or combined bit by bit.

        Without `check_unique`, the last of several values for a pixel replaces the others: the last of the list, or of the
        relation in the order of its column `order` (its order of rows, if none is named).

        `pixels` is a relation of `pix`, or of half-open ranges `start`, `end`, with value columns of its own or the one
        value `values`; or a local list, with one value or a list of them. None takes pixels out.
        """
        m, spark = self.meta, self.df.sparkSession
        if operation not in ("replace", "add", "or", "and"):
            raise ValueError(f"no such operation: {operation}")
        if operation == "add" and m.kind == "bool":
            raise NotImplementedError("booleans are not added")
        if operation in ("or", "and") and not (m.kind in ("bool", "wide") or m.kind == "scalar" and is_integer(m.dtype) and m.sentinel == 0):
            raise ValueError("bits are combined in integer maps with sentinel 0 and in boolean maps")
        if operation != "replace" and m.kind == "record" or operation == "add" and m.kind == "wide":
            raise ValueError(f"{operation} is not for this kind of map")
        if not isinstance(pixels, DataFrame):
            pixels = list(pixels)
            if pixels and isinstance(pixels[0], (tuple, list)):
                pixels = spark.createDataFrame([(int(a), int(b)) for a, b in pixels], "start bigint, end bigint")
            elif isinstance(values, (list, tuple)) and m.kind != "wide":
                if len(values) != len(pixels):
                    raise ValueError("as many values as pixels are needed")
                kinds = ", ".join(f"`{c}` {k}" for c, k in self._kinds().items()) or "v boolean"
                pixels, values = spark.createDataFrame([(int(p), *(v if isinstance(v, (tuple, list)) else (v,))) for p, v in zip(pixels, values, strict=True)], f"pix bigint, {kinds}"), ...
            else:
                pixels = pixels_frame(spark, pixels)
        ordered = operation == "replace" and not check_unique and bool({"v", *m.values} & {*pixels.columns})
        if ordered:
            pixels = pixels.withColumn("_place", F.col(order) if order else F.monotonically_increasing_id())
        if "start" in pixels.columns:
            if not nest:
                raise ValueError("ranges are of nested pixels")
            pixels = expand_ranges(pixels, m.bits)
            check_unique = check_unique and bool({"v", *m.values} & {*pixels.columns})  # ranges of one value may overlap
        if not nest:
            pixels = px.with_nest(pixels.withColumnRenamed("pix", "_ring_in"), self.nside_sparse, "_ring_in").drop("_ring_in")
        own = [c for c in (m.values or ["v"]) if c in pixels.columns]
        if values is None and not own:
            return SkyMap(self.df.join(pixels.select("pix").distinct(), "pix", "left_anti"), m, self.cov)
        if not own:
            pixels = pixels.select("pix", *self._constants(values))
        if ordered:
            pixels = pixels.groupBy("pix").agg(F.max_by(F.struct(*own), "_place").alias("_v")).select("pix", "_v.*")
        if operation == "replace" and check_unique and pixels.groupBy("pix").count().filter("count > 1").take(1):
            raise ValueError("pixels must be unique to be replaced")
        cov = self.cov.union(blocks(pixels, m.bits)).distinct()
        return self._new(self._merged(pixels, operation), cov)

    def _constants(self, value: Any) -> list[Column]:
        m = self.meta
        if m.kind == "wide":
            words = words_of(value if isinstance(value, (list, tuple)) else [value], m.maxbits)
            return [F.lit(w).cast("bigint").alias(c) for c, w in zip(m.values, words, strict=True)]
        if m.kind == "bool":
            if not isinstance(value, bool):
                raise ValueError("a boolean map takes booleans")
            return [F.lit(value).alias("v")]
        if m.kind == "record":
            return [F.lit(v).cast(k).alias(c) for (c, k), v in zip(self._kinds().items(), value, strict=True)]
        if is_integer(m.dtype) and (isinstance(value, bool) or int(value) != value or not limits(m.dtype)[0] <= value <= limits(m.dtype)[1]):
            raise ValueError(f"{value} is no {m.dtype}")
        return [F.lit(value).cast(SPARK[m.dtype]).alias("v")]

    def _merged(self, new: DataFrame, operation: str) -> DataFrame:
        m = self.meta
        if m.kind == "bool":
            if operation == "and":  # duplicates: all must be True
                out = new.groupBy("pix").agg(F.bool_and("v").alias("v")).filter("not v").select("pix")
                return self.df.join(out, "pix", "left_anti")
            on = new.filter("v").select("pix").distinct()
            kept = self.df.join(new.filter("not v").select("pix"), "pix", "left_anti") if operation == "replace" else self.df
            return kept.union(on).distinct()
        if operation == "replace":
            new = new.select("pix", *[F.col(c).cast(k).alias(c) for c, k in self._kinds().items()])
            new = new.dropDuplicates(["pix"])
            return self.df.join(new.select("pix"), "pix", "left_anti").select("pix", *m.values).unionByName(new)
        how = {"add": F.sum if m.kind != "scalar" or not is_integer(m.dtype) else lambda c: total(F.col(c)), "or": F.bit_or, "and": F.bit_and}[operation]
        got = new.groupBy("pix").agg(*[how(c).alias(f"_{c}") for c in m.values])  # combined before they meet the map
        if operation == "and":
            out = self.df.join(got, "pix").select("pix", *[F.col(c).bitwiseAND(F.col(f"_{c}")).cast(k).alias(c) for c, k in self._kinds().items()])
            return out.unionByName(self.df.join(got.select("pix"), "pix", "left_anti").select("pix", *m.values))
        both = self.df.join(got, "pix", "full_outer")

        def joined(c: str, k: str) -> Column:
            a, b = F.coalesce(c, F.lit(0)), F.coalesce(f"_{c}", F.lit(0))
            if operation == "or":
                return a.cast("bigint").bitwiseOR(b.cast("bigint")).cast(k)
            return wrapped(added(a, b), m.dtype) if is_integer(m.dtype) else (a + b).cast(k)

        return both.select("pix", *[joined(c, k).alias(c) for c, k in self._kinds().items()])

    def update_values_pos(self, points: DataFrame, values: Any = None, a: str = "ra", b: str = "dec", lonlat: bool = True, operation: str = "replace", check_unique: bool = True, order: str | None = None, sine: bool = False) -> SkyMap:
        """The same for positions; with `sine`, `b` is the sine of the latitude."""
        at = px.with_pixel(points, self.nside_sparse, a, b, "pix", lonlat, sine)
        keep = [c for c in (*(self.meta.values or ["v"]), *([order] if order else [])) if c in points.columns]
        return self.update_values_pix(at.select("pix", *dict.fromkeys(keep)), values, operation=operation, check_unique=check_unique, order=order)

    def set_bits_pix(self, pixels: DataFrame | Sequence[int], bits: Sequence[int], nest: bool = True) -> SkyMap:
        if self.meta.kind != "wide":
            raise NotImplementedError("only wide masks have bits")
        return self.update_values_pix(pixels, list(bits), nest, "or")

    def clear_bits_pix(self, pixels: DataFrame | Sequence[int], bits: Sequence[int], nest: bool = True) -> SkyMap:
        if self.meta.kind != "wide":
            raise NotImplementedError("only wide masks have bits")
        kept = [F.lit(~w).cast("bigint").alias(c) for c, w in zip(self.meta.values, words_of(bits, self.meta.maxbits), strict=True)]
        return self.update_values_pix(pixels_frame(self.df.sparkSession, pixels).select("pix", *kept), None, nest, "and")

    def apply_mask(self, mask: SkyMap, mask_bits: int | None = None, mask_bit_arr: Sequence[int] | None = None) -> SkyMap:
        """The map without the pixels that the mask marks: above 0, with some of `mask_bits`, or of a wide mask any or the listed bits."""
        if not mask.is_integer_map:
            raise NotImplementedError("a mask is an integer map")
        if mask.nside_sparse != self.nside_sparse:
            raise ValueError("map and mask need the same resolution")
        if mask.meta.kind == "wide":
            if mask_bits is not None:
                raise NotImplementedError("a wide mask takes a list of bits")
            bad = mask.df if mask_bit_arr is None else mask.df.filter(mask.bit_test(mask_bit_arr))
        elif mask.meta.kind == "bool":
            bad = mask.df
        else:
            bad = mask.df.filter(F.col("v") > 0 if mask_bits is None else F.col("v").cast("bigint").bitwiseAND(F.lit(int(mask_bits))) > 0)
        return SkyMap(self.df.join(bad.select("pix"), "pix", "left_anti"), self.meta, self.cov)

    def generate_healpix_map(self, nside: int | None = None, reduction: str = "mean", key: str | None = None, nest: bool = True) -> DataFrame:
        """(pix, v) of the full sky, UNSEEN where nothing is valid; numbers that are no floats become doubles."""
        if self.meta.kind == "wide":
            raise NotImplementedError("a wide mask has no single value")
        one = self.get_single(key, check_sentinel(self.meta.dtype[key])) if self.meta.kind == "record" and key else self
        if one.meta.kind == "record":
            raise ValueError("a record needs the name of a column")
        if nside and nside > self.nside_sparse:
            raise ValueError("a map is not exported finer than it is")
        if nside and nside < self.nside_sparse:
            one = one.degrade(nside, reduction)
        v = F.lit(1.0) if one.meta.kind == "bool" else F.col("v").cast("double") if one.meta.dtype != "float32" else F.col("v")
        every = self.df.sparkSession.range(px.n_pixels(one.nside_sparse)).withColumnRenamed("id", "pix")
        out = every.join(one.df.select("pix", v.alias("v")), "pix", "left").select("pix", F.coalesce("v", F.lit(px.UNSEEN)).alias("v"))
        return out if nest else px.with_ring(out, one.nside_sparse, "pix", "_ring").select(F.col("_ring").alias("pix"), "v")

    # what other modules add -----------------------------------------------------------------------------------------
    @staticmethod
    def read(spark: SparkSession, path: str, **how: Any) -> Any:
        """A map from a file or folder; see `starquilt.sources.read_map`."""
        from ..sources import read_map

        return read_map(spark, path, **how)

    def write(self, path: str, format: str = "fits", **how: Any) -> None:  # noqa: A002
        from ..sources import write_map

        write_map(self, path, format, **how)

    def write_moc(self, path: str, clobber: bool = False) -> None:
        self.write(path, "moc", clobber=clobber)

    def degrade(self, nside_out: int, reduction: str = "mean", weights: SkyMap | None = None, empty_groups: str = "value") -> SkyMap:
        from .resolution import degrade

        return degrade(self, nside_out, reduction, weights, empty_groups)

    def upgrade(self, nside_out: int) -> SkyMap:
        from .resolution import upgrade

        return upgrade(self, nside_out)

    def interpolate_pos(self, points: DataFrame, a: str = "ra", b: str = "dec", lonlat: bool = True, allow_partial: bool = False) -> DataFrame:
        from .resolution import interpolate_pos

        return interpolate_pos(self, points, a, b, lonlat, allow_partial)

    def _op(self, name: str, other: Any) -> SkyMap:
        from .algebra import apply

        return apply(self, name, other)

    __add__ = __iadd__ = lambda self, o: self._op("add", o)
    __sub__ = __isub__ = lambda self, o: self._op("sub", o)
    __mul__ = __imul__ = lambda self, o: self._op("mul", o)
    __truediv__ = __itruediv__ = lambda self, o: self._op("truediv", o)
    __pow__ = __ipow__ = lambda self, o: self._op("pow", o)
    __and__ = __iand__ = lambda self, o: self._op("and", o)
    __or__ = __ior__ = lambda self, o: self._op("or", o)
    __xor__ = __ixor__ = lambda self, o: self._op("xor", o)
    __lt__ = lambda self, o: self._op("lt", o)
    __le__ = lambda self, o: self._op("le", o)
    __gt__ = lambda self, o: self._op("gt", o)
    __ge__ = lambda self, o: self._op("ge", o)
    __hash__ = object.__hash__

    def __eq__(self, o: Any) -> Any:
        """A constant gives the map of equal pixels; a map gives whether both are the same."""
        if not isinstance(o, SkyMap):
            return self._op("eq", o)
        if self.meta != o.meta or self.df.schema.simpleString() != o.df.schema.simpleString():
            return False
        pairs = ((self.df, o.df), (self.cov, o.cov))
        return not any(x.exceptAll(y).take(1) or y.exceptAll(x).take(1) for x, y in pairs)

    def __ne__(self, o: Any) -> Any:
        return not self == o if isinstance(o, SkyMap) else self._op("ne", o)

    def invert(self) -> SkyMap:
        from .algebra import invert

        return invert(self)

    __invert__ = invert

    def __repr__(self) -> str:
        m = self.meta
        what = {"wide": f"wide mask, {m.maxbits} bits", "bool": "bool, bit-packed" if m.packed else "bool", "record": f"record {m.dtype}, primary {m.primary}"}.get(m.kind, str(m.dtype))
        return f"SkyMap(nside_coverage={m.nside_coverage}, nside_sparse={m.nside_sparse}, {what}, sentinel={m.sentinel})"


def checked_metadata(metadata: dict | None) -> dict | None:
    if metadata is None:
        return None
    out = dict(metadata)
    if any(not isinstance(k, str) or k != k.upper() for k in out):
        raise ValueError("the keys of metadata are upper-case strings")
    return out


def describe(nside_coverage: int, nside_sparse: int, dtype: Any, primary: str | None = None, sentinel: Any = None, maxbits: int = 0, metadata: dict | None = None, packed: bool = False) -> Meta:
    """Check a map's parameters."""
    if px.shift_between(nside_sparse, nside_coverage) < 0:
        raise ValueError("a map is at least as fine as its coverage")
    meta = checked_metadata(metadata)
    if maxbits:
        if sentinel not in (None, 0):
            raise ValueError("the sentinel of a wide mask is 0")
        return Meta(nside_coverage, nside_sparse, "wide", "uint8", 0, maxbits=-(-maxbits // 8) * 8, metadata=meta)
    if isinstance(dtype, dict):
        if primary not in dtype:
            raise ValueError("a record needs one of its columns as primary")
        for t in dtype.values():
            check_sentinel(t)
        return Meta(nside_coverage, nside_sparse, "record", dict(dtype), check_sentinel(dtype[primary], sentinel), primary, metadata=meta)
    if packed and (dtype != "bool" or px.shift_between(nside_sparse, nside_coverage) < 3):
        raise ValueError("bits are packed for booleans, with at least 8 pixels to a block")
    return Meta(nside_coverage, nside_sparse, "bool" if dtype == "bool" else "scalar", dtype, check_sentinel(dtype, sentinel), packed=packed, metadata=meta)


def blocks(df: DataFrame, bits: int) -> DataFrame:
    """(cov_pix) that the pixels of `df` lie in."""
    return df.select(F.shiftright("pix", bits).alias("cov_pix")).distinct()


def all_pixels(cov: DataFrame, bits: int) -> DataFrame:
    """Every pixel of the covered blocks."""
    return expand_pixels(cov.select(F.col("cov_pix").alias("pix")), bits, bits)


def is_constant(x: Any) -> bool:
    return isinstance(x, (int, float, bool)) or hasattr(x, "dtype") and getattr(x, "shape", None) == ()

