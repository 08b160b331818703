"""Shapes on the sphere, rendered by refining coarse pixels.

A shape starts from all pixels of a coarse level and goes down a few levels at a time: a pixel is kept while its centre
lies within the shape grown by the pixel's largest radius, and at the last level if the centre lies within the shape
itself. All tests are column expressions on the centre's unit vector, so large shapes are rendered in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pixelization as px
from ..functions.ranking import frozen, global_rank
from ..functions.dtypes import is_integer, limits
from .skymap import SkyMap, blocks

START, STEP = 16, 3


def _dot(v: tuple[Column, Column, Column], p: Sequence[float]) -> Column:
    return v[0] * p[0] + v[1] * p[1] + v[2] * p[2]


def _arc(v: tuple[Column, Column, Column], p: Sequence[float]) -> Column:
    """Angle to a point; the chord keeps small angles exact."""
    chord = F.sqrt((v[0] - p[0]) ** 2 + (v[1] - p[1]) ** 2 + (v[2] - p[2]) ** 2)
    return 2.0 * F.asin(F.least(F.lit(1.0), chord / 2.0))


class Shape:
    """A shape with a value, which may be a number, a boolean or a list of bits. `nside_render` renders at that resolution and upgrades."""

    def __init__(self, value: Any, nside_render: int | None = None):
        self._value, self.nside_render = value, nside_render

    @property
    def value(self) -> Any:
        return self._value

    @property
    def is_integer_value(self) -> bool:
        return isinstance(self._value, (int, list, tuple))

    def inside(self, v: tuple[Column, Column, Column], grow: float) -> Column:
        """Whether a unit vector lies in the shape grown by `grow` radians; exact for 0, and never too small."""
        raise NotImplementedError

    def get_pixels(self, spark: SparkSession, nside: int) -> DataFrame:
        """(pix) of the pixels whose centres lie within."""
        render = self.nside_render or nside
        if nside < render:
            raise ValueError("nside is below nside_render")
        at = min(START, render)
        df = self._kept(spark.range(px.n_pixels(at)).withColumnRenamed("id", "pix"), at, at == render)
        while at < render:
            step = min(STEP, px.order_of(render) - px.order_of(at))
            at <<= step
            df = df.repartition("pix").select(F.explode(F.sequence(F.shiftleft("pix", 2 * step), F.shiftleft(F.col("pix") + 1, 2 * step) - 1)).alias("pix"))
            df = self._kept(df, at, at == render)
        if nside > render:
            k = px.shift_between(nside, render)
            df = df.select(F.explode(F.sequence(F.shiftleft("pix", k), F.shiftleft(F.col("pix") + 1, k) - 1)).alias("pix"))
        return df

    def _kept(self, df: DataFrame, nside: int, last: bool) -> DataFrame:
        seen = px.with_vector(df, nside, "pix", ("_x", "_y", "_z"))
        v = F.col("_x"), F.col("_y"), F.col("_z")
        return seen.filter(self.inside(v, 0.0 if last else px.largest_radius(nside))).select("pix")

    def get_pixel_ranges(self, spark: SparkSession, nside: int) -> DataFrame:
        """The same pixels as half-open ranges (start, end), as long as they can be.

        Runs are found within pixels of nside / 64; those that touch at a border are then joined: starts that are no
        range's end and ends that are no range's start, each numbered in order, belong together.
        """
        order = Window.partitionBy("_b").orderBy("pix")
        df = self.get_pixels(spark, nside).withColumn("_b", F.shiftright("pix", min(12, 2 * px.order_of(nside))))
        runs = df.withColumn("_r", F.col("pix") - F.row_number().over(order))
        runs = frozen(runs.groupBy("_b", "_r").agg(F.min("pix").alias("start"), (F.max("pix") + 1).alias("end")).select("start", "end"))
        starts = runs.select("start").join(runs.select(F.col("end").alias("start")), "start", "left_anti")
        ends = runs.select("end").join(runs.select(F.col("start").alias("end")), "end", "left_anti")
        return global_rank(starts, ["start"], "_n").join(global_rank(ends, ["end"], "_n"), "_n").select("start", "end")

    def get_map(self, spark: SparkSession, nside_coverage: int, nside_sparse: int, dtype: str, wide_mask_maxbits: int = 0) -> SkyMap:
        """A new map of the shape; its sentinel is 0 for integers."""
        bits = wide_mask_maxbits or (max(self._value) + 1 if isinstance(self._value, (list, tuple)) else 0)
        sentinel = 0 if not bits and is_integer(dtype) else None
        return self.get_map_like(SkyMap.make_empty(spark, nside_coverage, nside_sparse, dtype, sentinel=sentinel, wide_mask_maxbits=bits))

    def get_map_like(self, other: SkyMap) -> SkyMap:
        if other.is_rec_array:
            raise NotImplementedError("shapes have one value, records several")
        empty = SkyMap.make_empty_like(other)
        pixels = self.get_pixels(other.df.sparkSession, other.nside_sparse)
        return empty.update_values_pix(pixels, self._value, check_unique=False)

    def onto(self, m: SkyMap, operation: str) -> SkyMap:
        """A map with the shape's value added or combined bit by bit at its pixels."""
        if isinstance(self._value, (list, tuple)) != m.is_wide_mask_map:
            raise ValueError("lists of bits are for wide masks")
        return m.update_values_pix(self.get_pixels(m.df.sparkSession, m.nside_sparse), self._value, operation=operation, check_unique=False)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v}' for k, v in vars(self).items() if not k.startswith('_'))}, value={self._value})"


class Circle(Shape):
    def __init__(self, ra: float, dec: float, radius: float, value: Any, nside_render: int | None = None):
        if any(hasattr(x, "__len__") for x in (ra, dec, radius)):
            raise ValueError("a circle takes single numbers")
        super().__init__(value, nside_render)
        self.ra, self.dec, self.radius = ra, dec, radius

    def inside(self, v: tuple[Column, Column, Column], grow: float) -> Column:
        return _arc(v, px.angle_to_vector(self.ra, self.dec)) <= math.radians(self.radius) + grow


class Polygon(Shape):
    """Convex, with great-circle edges, in either winding."""

    def __init__(self, ra: Sequence[float], dec: Sequence[float], value: Any, nside_render: int | None = None):
        if len(ra) != len(dec) or len(ra) < 3:
            raise ValueError("a polygon has at least three corners")
        super().__init__(value, nside_render)
        self.ra, self.dec = list(ra), list(dec)

    @property
    def vertices(self) -> list[tuple[float, float, float]]:
        return [px.angle_to_vector(a, b) for a, b in zip(self.ra, self.dec, strict=True)]

    def inside(self, v: tuple[Column, Column, Column], grow: float) -> Column:
        p = self.vertices
        normals = []
        for a, b in zip(p, [*p[1:], p[0]], strict=True):
            n = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
            size = math.sqrt(sum(x * x for x in n))
            if size > 1e-15:
                normals.append(tuple(x / size for x in n))
        middle = tuple(sum(x) for x in zip(*p, strict=True))
        turn = 1.0 if sum(sum(x * y for x, y in zip(n, middle, strict=True)) for n in normals) >= 0 else -1.0
        out = F.lit(True)
        for n in normals:
            out = out & (_dot(v, n) * turn >= -math.sin(min(grow, math.pi / 2)) - (1e-15 if not grow else 0.0))
        return out


class Ellipse(Shape):
    """Points whose distances to two foci sum to at most the long axis; `alpha` turns it counter-clockwise from north."""

    def __init__(self, ra: float, dec: float, semi_major: float, semi_minor: float, alpha: float, value: Any, nside_render: int | None = None):
        super().__init__(value, nside_render)
        self.ra, self.dec, self.semi_major, self.semi_minor, self.alpha = ra, dec, semi_major, semi_minor, alpha

    def foci(self) -> list[tuple[float, float, float]]:
        a, b = math.radians(self.semi_major), math.radians(self.semi_minor)
        c = math.acos(min(1.0, math.cos(a) / math.cos(b)))
        lon, lat, turn = math.radians(self.ra), math.radians(self.dec), math.radians(self.alpha)
        p = px.angle_to_vector(self.ra, self.dec)
        north = (-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat))
        east = (-math.sin(lon), math.cos(lon), 0.0)
        way = [math.cos(turn) * n + math.sin(turn) * e for n, e in zip(north, east, strict=True)]
        return [tuple(math.cos(c) * x + s * math.sin(c) * w for x, w in zip(p, way, strict=True)) for s in (1, -1)]

    def inside(self, v: tuple[Column, Column, Column], grow: float) -> Column:
        f, g = self.foci()
        return _arc(v, f) + _arc(v, g) <= 2 * math.radians(self.semi_major) + 2 * grow


class Box(Shape):
    """Between two longitudes (from ra1 eastward to ra2) and two latitudes."""

    def __init__(self, ra1: float, ra2: float, dec1: float, dec2: float, value: Any, nside_render: int | None = None):
        super().__init__(value, nside_render)
        self.ra1, self.ra2, self.dec1, self.dec2 = ra1, ra2, dec1, dec2

    def inside(self, v: tuple[Column, Column, Column], grow: float) -> Column:
        lat = F.atan2(v[2], F.sqrt(v[0] * v[0] + v[1] * v[1]))
        lo, hi = math.radians(self.dec1) - grow, math.radians(self.dec2) + grow
        out = (lat >= lo - 1e-15) & (lat <= hi + 1e-15)
        width = self.ra2 - self.ra1 if self.ra2 - self.ra1 in (0.0, 360.0) else (self.ra2 - self.ra1) % 360.0
        if width == 360.0 or max(abs(lo), abs(hi)) >= math.pi / 2 and grow:
            return out
        more = math.degrees(math.asin(min(1.0, math.sin(grow) / math.cos(max(abs(lo), abs(hi)))))) if grow else 0.0
        if width + 2 * more >= 360.0:
            return out
        east = F.pmod(F.degrees(F.atan2(v[1], v[0])) - F.lit(self.ra1 - more) + F.lit(1e-12), F.lit(360.0))
        return out & (east <= width + 2 * more + 2e-12)


def realize_geom(shapes: Shape | Sequence[Shape], m: SkyMap, operation: str = "or") -> SkyMap:
    """A map with the values of all shapes OR-ed in, in one update."""
    shapes = [shapes] if isinstance(shapes, Shape) else list(shapes)
    if operation != "or":
        raise ValueError("shapes are realised by or")
    if not m.is_integer_map:
        raise ValueError("shapes are OR-ed into integer maps")
    for s in shapes:
        if isinstance(s.value, (list, tuple)) != m.is_wide_mask_map:
            raise ValueError("lists of bits are for wide masks")
        if m.meta.kind == "scalar" and not (isinstance(s.value, int) and limits(m.dtype)[0] <= s.value <= limits(m.dtype)[1]):
            raise ValueError(f"{s.value} is no {m.dtype}")
    if not shapes:
        return m
    rows = [s.get_pixels(m.df.sparkSession, m.nside_sparse).select("pix", *m._constants(s.value)) for s in shapes]
    stacked = rows[0]
    for r in rows[1:]:
        stacked = stacked.unionByName(r)
    return m.update_values_pix(stacked, operation="or", check_unique=False)


def covered_by(shape: Shape, m: SkyMap) -> DataFrame:
    """(cov_pix) of the map's blocks that a shape meets."""
    return blocks(shape.get_pixels(m.df.sparkSession, m.nside_sparse), m.meta.bits)


