"""Equal-area sphere pixels as Column expressions (nested numbering unless a name says ring).

All of it is arithmetic on columns, so it runs inside generated code, prunes and folds with the rest of a query and
needs no Python worker. The formulas are those of the HEALPix paper (Gorski et al. 2005). An expression that is used
several times is bound to a column of its own by `Let`; without that the trees would grow as a power of their depth.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSEEN = -1.6375e30
_JR = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
_JP = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


# scalars ------------------------------------------------------------------------------------------------------------
def order_of(nside: int) -> int:
    if nside < 1 or nside & (nside - 1) or nside > 1 << 29:
        raise ValueError(f"nside {nside} is not a power of two from 1 to 2**29")
    return nside.bit_length() - 1


def n_pixels(nside: int) -> int:
    order_of(nside)
    return 12 * nside * nside


def nside_of(npix: int) -> int:
    nside = math.isqrt(npix // 12)
    if npix < 12 or n_pixels(nside) != npix:
        raise ValueError(f"{npix} is no number of pixels")
    return nside


def pixel_area(nside: int, degrees: bool = True) -> float:
    area = 4.0 * math.pi / n_pixels(nside)
    return area * math.degrees(1.0) ** 2 if degrees else area


def resolution(nside: int) -> float:
    """Square root of the pixel area, in degrees."""
    return math.sqrt(pixel_area(nside))


def shift_between(fine: int, coarse: int) -> int:
    """Bits between a pixel and its ancestor."""
    return 2 * (order_of(fine) - order_of(coarse))


def largest_radius(nside: int) -> float:
    """Radians from a pixel's centre to its farthest corner, at most."""
    za, pa = 2.0 / 3.0, math.pi / (4 * nside)
    zb = 1.0 - (1.0 - 1.0 / nside) ** 2 / 3.0
    sa, sb = math.sqrt(1 - za * za), math.sqrt(1 - zb * zb)
    a, b = (sa * math.cos(pa), sa * math.sin(pa), za), (sb, 0.0, zb)
    return math.acos(min(1.0, sum(x * y for x, y in zip(a, b, strict=True))))


class Let:
    """A DataFrame to which expressions are bound one after another; `done` drops what was bound on the way.

    The results leave through a one-element explode. Filters on them stay above it, where the optimizer would else push
    them down and write out every binding at each of its uses; filters on other columns still pass.
    """

    def __init__(self, df: DataFrame):
        self.df, self.names = df, []

    def __call__(self, *exprs: Column) -> Column | tuple[Column, ...]:
        names = [f"_{uuid.uuid4().hex[:12]}" for _ in exprs]
        self.names += names
        self.df = self.df.withColumns(dict(zip(names, exprs, strict=True)))
        cols = tuple(F.col(n) for n in names)
        return cols if len(cols) > 1 else cols[0]

    def done(self, **named: Column) -> DataFrame:
        out = f"_{uuid.uuid4().hex[:12]}"
        df = self.df.withColumn(out, F.explode(F.array(F.struct(*[v.alias(k) for k, v in named.items()]))))
        return df.withColumns({k: F.col(out)[k] for k in named}).drop(out, *self.names)


# bits ---------------------------------------------------------------------------------------------------------------
def _long(x: Column) -> Column:
    return x.cast("long")


def _spread(x: Column) -> Column:
    for s, m in _MASKS:
        x = x.bitwiseOR(F.shiftleft(x, s)).bitwiseAND(F.lit(m))
    return x


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(_MASKS[-1][1]))
    for (s, _), m in zip(reversed(_MASKS), [m for _, m in reversed(_MASKS[:-1])] + [0x00000000FFFFFFFF], strict=True):
        x = x.bitwiseOR(F.shiftright(x, s)).bitwiseAND(F.lit(m))
    return x


def _of_face(values: tuple[int, ...], face: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (face + 1).cast("int"))


def parent(pix: Column, fine: int, coarse: int) -> Column:
    return F.shiftright(pix, shift_between(fine, coarse))


# positions to pixels ------------------------------------------------------------------------------------------------
def _z_to_pixel(let: Let, nside: int, z: Column, lon: Column, cap: Column) -> Column:
    """Pixel of height z on the unit sphere and longitude in degrees; `cap` is sqrt(3 (1 - |z|)), as exactly as it is known."""
    k = order_of(nside)
    tt = let(F.pmod(lon, F.lit(360.0)) / 90.0)
    tt, t = let(F.when(tt >= 4.0, 0.0).otherwise(tt), nside * cap)
    low = F.lit(nside - 1).cast("long")
    ntt = F.least(F.lit(3).cast("long"), _long(F.floor(tt)))
    # belt, then caps
    jp, jm, ntt = let(_long(F.floor(nside * (0.5 + tt) - nside * 0.75 * z)), _long(F.floor(nside * (0.5 + tt) + nside * 0.75 * z)), ntt)
    fp, fm, tp = let(F.shiftright(jp, k), F.shiftright(jm, k), tt - ntt)
    cp, cm = let(F.least(_long(F.floor(tp * t)), low), F.least(_long(F.floor((1.0 - tp) * t)), low))
    belt_face = F.when(fp == fm, fp.bitwiseAND(F.lit(3)) + 4).when(fp < fm, fp.bitwiseAND(F.lit(3))).otherwise(fm.bitwiseAND(F.lit(3)) + 8)
    belt, north = F.abs(z) <= 2.0 / 3.0, z >= 0
    face, x, y = let(
        F.when(belt, belt_face).when(north, ntt).otherwise(ntt + 8),
        F.when(belt, jm.bitwiseAND(low)).when(north, low - cm).otherwise(cp),
        F.when(belt, low - jp.bitwiseAND(low)).when(north, low - cp).otherwise(cm),
    )
    return F.shiftleft(face, 2 * k).bitwiseOR(_spread(x)).bitwiseOR(F.shiftleft(_spread(y), 1))


def lonlat(a: Column, b: Column, is_lonlat: bool) -> tuple[Column, Column]:
    """Degrees of longitude and latitude of (lon, lat) in degrees or (co-latitude, longitude) in radians."""
    return (a, b) if is_lonlat else (F.degrees(b), 90.0 - F.degrees(a))


def with_pixel(df: DataFrame, nside: int, a: str, b: str, name: str = "pix", is_lonlat: bool = True, sine: bool = False) -> DataFrame:
    """Add the pixel of each position; null where a coordinate is null.

    With `sine`, `b` is the sine of the latitude beside a longitude in degrees. What is known by its sine is best given
    so: an angle and back loses a digit, which can move a position that lies on a pixel's border.
    """
    if sine:
        return with_pixel_of_z(df, nside, b, a, name)
    let = Let(df)
    lon, lat = let(*lonlat(F.col(a).cast("double"), F.col(b).cast("double"), is_lonlat))
    r = let(F.radians(lat))
    z, lon = let(F.sin(r), lon)
    # near the poles 1 - |z| loses its digits; cos**2 / (1 + |z|) keeps them
    cap = let(F.when(F.abs(z) > 0.99, F.cos(r) / F.sqrt((1.0 + F.abs(z)) / 3.0)).otherwise(F.sqrt(3.0 * (1.0 - F.abs(z)))))
    return let.done(**{name: _z_to_pixel(let, nside, z, lon, cap)})


def with_pixel_of_z(df: DataFrame, nside: int, z: str, lon: str, name: str = "pix") -> DataFrame:
    """The same for the sine of the latitude and the longitude in degrees."""
    let = Let(df)
    return let.done(**{name: _z_to_pixel(let, nside, F.col(z), F.col(lon), F.sqrt(3.0 * (1.0 - F.abs(F.col(z)))))})


# pixels to positions ------------------------------------------------------------------------------------------------
def _ring_place(let: Let, nside: int, pix: Column) -> tuple[Column, Column, Column]:
    """Ring from 1 at the north, pixels in a quarter of it, and eighths of place along it."""
    k = 2 * order_of(nside)
    inner = F.lit((1 << k) - 1)
    even, odd, face = let(pix.bitwiseAND(inner), F.shiftright(pix.bitwiseAND(inner), 1), F.shiftright(pix, k))
    x, y = let(_gather(even), _gather(odd))
    jr = let(_of_face(_JR, face) * nside - x - y - 1)
    nr = let(F.when(jr < nside, jr).when(jr > 3 * nside, 4 * nside - jr).otherwise(F.lit(nside).cast("long")))
    return jr, nr, let(F.pmod(_of_face(_JP, face) * nr + x - y, 8 * nr))


def _z_lon(let: Let, nside: int, pix: Column) -> tuple[Column, Column, Column]:
    """(z, sine of co-latitude, longitude in degrees) of pixel centres."""
    jr, nr, jp = _ring_place(let, nside, pix)
    t = let(nr.cast("double") * nr / (3.0 * nside * nside))
    belt = (jr >= nside) & (jr <= 3 * nside)
    z = let(F.when(belt, (2 * nside - jr) * (2.0 / (3.0 * nside))).when(jr < nside, 1.0 - t).otherwise(t - 1.0))
    return z, F.when(belt, F.sqrt((1.0 - z) * (1.0 + z))).otherwise(F.sqrt(t * (2.0 - t))), 45.0 * jp / nr


def with_z_lon(df: DataFrame, nside: int, pix: str = "pix", names: tuple[str, str] = ("z", "lon")) -> DataFrame:
    let = Let(df)
    z, _, lon = _z_lon(let, nside, F.col(pix))
    return let.done(**{names[0]: z, names[1]: lon})


def with_angles(df: DataFrame, nside: int, pix: str = "pix", names: tuple[str, str] = ("lon", "lat"), is_lonlat: bool = True) -> DataFrame:
    """Add the position of each pixel's centre: (lon, lat) in degrees or (co-latitude, longitude) in radians."""
    let = Let(df)
    z, sine, lon = _z_lon(let, nside, F.col(pix))
    a, b = (lon, F.degrees(F.atan2(z, sine))) if is_lonlat else (F.atan2(sine, z), F.radians(lon))
    return let.done(**{names[0]: a, names[1]: b})


def with_vector(df: DataFrame, nside: int, pix: str = "pix", names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Add the unit vector to each pixel's centre."""
    let = Let(df)
    z, sine, lon = _z_lon(let, nside, F.col(pix))
    sine, lon = let(sine, F.radians(lon))
    return let.done(**dict(zip(names, (sine * F.cos(lon), sine * F.sin(lon), z), strict=True)))


def angle_to_vector(lon: float, lat: float) -> tuple[float, float, float]:
    a, b = math.radians(lon), math.radians(lat)
    return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)


# ring numbering -----------------------------------------------------------------------------------------------------
def with_ring(df: DataFrame, nside: int, pix: str = "pix", name: str = "ring") -> DataFrame:
    """Add the ring number of each nested pixel."""
    let = Let(df)
    jr, nr, jp = _ring_place(let, nside, F.col(pix))
    cap = (jr < nside) | (jr > 3 * nside)
    before = F.when(jr < nside, 2 * nr * (nr - 1)).when(jr > 3 * nside, 12 * nside * nside - 2 * nr * (nr + 1)).otherwise(2 * nside * (nside - 1) + 4 * nside * (jr - nside))
    return let.done(**{name: before + F.pmod(F.when(cap, F.shiftright(jp - 1, 1)).otherwise(F.shiftright(jp, 1)), 4 * nr)})


def _ring(let: Let, nside: int, ring: Column) -> tuple[Column, Column, Column, Column]:
    """(first pixel, pixels, co-latitude, 0.5 if centres are shifted by half a pixel else 0) of ring 1 to 4 nside - 1."""
    north = let(F.least(ring, 4 * nside - ring))
    cap, south = north < nside, ring != north
    nr, t = let(F.when(cap, 4 * north).otherwise(F.lit(4 * nside).cast("long")), north.cast("double") * north / (3.0 * nside * nside))
    theta, first = let(
        F.when(cap, F.atan2(F.sqrt(t * (2.0 - t)), 1.0 - t)).otherwise(F.acos((2 * nside - north) * (2.0 / (3.0 * nside)))),
        F.when(cap, 2 * north * (north - 1)).otherwise(2 * nside * (nside - 1) + 4 * nside * (north - nside)),
    )
    shift = F.when(cap | ((north - nside).bitwiseAND(F.lit(1)) == 0), 0.5).otherwise(0.0)
    first, theta, shift = let(F.when(south, 12 * nside * nside - first - nr).otherwise(first), F.when(south, math.pi - theta).otherwise(theta), shift)
    return first, nr, theta, shift


def with_nest(df: DataFrame, nside: int, ring_pix: str, name: str = "pix") -> DataFrame:
    """Add the nested number of each ring number, through the pixel's centre, which lies well inside the pixel."""
    cap, total = 2 * nside * (nside - 1), 12 * nside * nside
    let = Let(df)
    pix = F.col(ring_pix)
    low, flipped = let(F.least(pix, total - 1 - pix), pix > total - 1 - pix)
    ring = let(_long(F.floor((1.0 + F.sqrt(1.0 + 2.0 * low.cast("double"))) / 2.0)))
    ring = let(F.when(2 * ring * (ring - 1) > low, ring - 1).when(2 * ring * (ring + 1) <= low, ring + 1).otherwise(ring))
    ring = F.when(low >= cap, nside + _long(F.floor((pix - cap) / F.lit(4.0 * nside)))).when(flipped, 4 * nside - ring).otherwise(ring)
    ring = let(ring.cast("long"))
    first, nr, _, shift = _ring(let, nside, ring)
    north = let(F.least(ring, 4 * nside - ring))
    t = let(north.cast("double") * north / (3.0 * nside * nside))
    z = let(F.when(north < nside, 1.0 - t).otherwise((2 * nside - north) * (2.0 / (3.0 * nside))))
    lon, z, root = let((pix - first + shift) * 360.0 / nr, F.when(ring != north, -z).otherwise(z), F.when(north < nside, north / F.lit(float(nside))).otherwise(F.sqrt(3.0 * (1.0 - z))))
    return let.done(**{name: _z_to_pixel(let, nside, z, lon, root)})


def explode_neighbours(df: DataFrame, nside: int, a: str, b: str, names: tuple[str, str] = ("pix", "w"), is_lonlat: bool = True) -> DataFrame:
    """Four rows for each position: a neighbouring pixel and its weight, two on the ring above and two on the ring below."""
    let = Let(df)
    lon, lat = lonlat(F.col(a), F.col(b), is_lonlat)
    theta, phi = let(F.radians(90.0 - lat), F.radians(F.pmod(lon, F.lit(360.0))))
    z = let(F.cos(theta))
    capped = let(_long(F.floor(nside * F.sqrt(3.0 * (1.0 - F.abs(z))))))
    above = let(F.when(F.abs(z) <= 2.0 / 3.0, _long(F.floor(nside * (2.0 - 1.5 * z)))).when(z > 0, capped).otherwise(4 * nside - capped - 1))
    below = let(above + 1)

    def on_ring(ring: Column) -> tuple[Column, Column, Column, Column]:
        safe = let(F.greatest(F.lit(1).cast("long"), F.least(F.lit(4 * nside - 1).cast("long"), ring)))
        first, nr, t, shift = _ring(let, nside, safe)
        at = let(phi * nr / (2.0 * math.pi) - shift)
        i = let(_long(F.floor(at)))
        p, q, w = let(first + F.pmod(i, nr), first + F.pmod(i + 1, nr), at - i)
        return p, q, w, t

    p0, p1, wa, ta = on_ring(above)
    p2, p3, wb, tb = on_ring(below)
    top, bottom = above <= 0, below >= 4 * nside
    v = let(F.when(top, theta / tb).when(bottom, (theta - ta) / (math.pi - ta)).otherwise((theta - ta) / F.when(tb == ta, 1.0).otherwise(tb - ta)))
    quarter = let(F.when(top, (1.0 - v) * 0.25).when(bottom, v * 0.25).otherwise(0.0))
    w = (
        F.when(top, quarter).otherwise((1.0 - wa) * (1.0 - v) + quarter), F.when(top, quarter).otherwise(wa * (1.0 - v) + quarter),
        F.when(bottom, quarter).otherwise((1.0 - wb) * v + quarter), F.when(bottom, quarter).otherwise(wb * v + quarter),
    )
    last = 12 * nside * nside - 4
    p = (
        F.when(top, (p2 + 2).bitwiseAND(F.lit(3))).otherwise(p0), F.when(top, (p3 + 2).bitwiseAND(F.lit(3))).otherwise(p1),
        F.when(bottom, (p0 - last + 2).bitwiseAND(F.lit(3)) + last).otherwise(p2), F.when(bottom, (p1 - last + 2).bitwiseAND(F.lit(3)) + last).otherwise(p3),
    )
    each = let(F.explode(F.array(*[F.struct(_long(x).alias("p"), y.alias("w")) for x, y in zip(p, w, strict=True)])))
    ring, weight = let(each["p"], each["w"])
    out = let.done(**{"_ring": ring, names[1]: weight})
    return with_nest(out, nside, "_ring", names[0]).drop("_ring")
