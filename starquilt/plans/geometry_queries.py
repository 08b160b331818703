"""Queries of shapes, interpolation, random positions and multi-order coverage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixelization as px
from ..operators import moc, sampling
from ..operators.geometry import Box, Circle, Ellipse, Polygon, realize_geom
from ..operators.skymap import SkyMap
from .base import COVERAGE, NSIDE, Tables, every_pixel, query, sql_place, with_relations

CIRCLE = (200.0, 10.0, 12.5)
BOX = (340.0, 25.0, -30.5, 12.0)
ELLIPSE = (100.0, -40.0, 15.0, 6.0, 30.0)
POLYGON = ([200.0, 230.0, 235.0, 195.0], [-10.0, -15.0, 20.0, 25.0])

_EVERY = f"every AS ({every_pixel()}),{sql_place('every', NSIDE)}, vec AS (SELECT pix, lon, degrees(atan2(z, s)) AS lat, s * cos(radians(lon)) AS x, s * sin(radians(lon)) AS y, z FROM placed)"


def _arc(p: tuple[float, float, float]) -> str:
    chord = " + ".join(f"({c} - ({v!r})) * ({c} - ({v!r}))" for c, v in zip("xyz", p, strict=True))
    return f"2 * asin(least(1.0, sqrt({chord}) / 2))"


def _polygon() -> str:
    p = [px.angle_to_vector(a, b) for a, b in zip(*POLYGON, strict=True)]
    sides = []
    for a, b in zip(p, [*p[1:], p[0]], strict=True):
        n = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        sides.append(" + ".join(f"{c} * ({v!r})" for c, v in zip("xyz", n, strict=True)) + " >= 0")
    return " AND ".join(sides)


IN_CIRCLE = f"{_arc(px.angle_to_vector(*CIRCLE[:2]))} <= {math.radians(CIRCLE[2])!r}"
IN_BOX = f"lat BETWEEN {BOX[2]} AND {BOX[3]} AND (lon >= {BOX[0]} OR lon <= {BOX[1]})"
IN_ELLIPSE = f"{' + '.join(_arc(f) for f in Ellipse(*ELLIPSE, 1).foci())} <= {2 * math.radians(ELLIPSE[2])!r}"


def _sql(body: str, *names: str) -> str:
    return with_relations(body, *names, more=_EVERY) if names else f"WITH {_EVERY}\n{body}"


@query("circle", _sql(f"SELECT pix, 16 AS v FROM vec WHERE {IN_CIRCLE}"))
def _circle(t: Tables) -> DataFrame:
    return Circle(*CIRCLE, value=16).get_map(t.spark, COVERAGE, NSIDE, "int32").df


@query("polygon", _sql(f"SELECT pix, CAST(1.5 AS DOUBLE) AS v FROM vec WHERE {_polygon()}"))
def _polygon_map(t: Tables) -> DataFrame:
    return Polygon(*POLYGON, value=1.5).get_map(t.spark, COVERAGE, NSIDE, "float64").df


@query("ellipse", _sql(f"SELECT pix FROM vec WHERE {IN_ELLIPSE}"))
def _ellipse(t: Tables) -> DataFrame:
    return Ellipse(*ELLIPSE, value=True).get_map(t.spark, COVERAGE, NSIDE, "bool").df


@query("box", _sql(f"SELECT pix, CAST(1 << 5 AS BIGINT) AS w0 FROM vec WHERE {IN_BOX}"))
def _box(t: Tables) -> DataFrame:
    return Box(*BOX, value=[5]).get_map(t.spark, COVERAGE, NSIDE, "uint8", wide_mask_maxbits=20).df


@query("pixel_ranges", _sql(f"SELECT pix FROM vec WHERE {IN_BOX}"))
def _ranges(t: Tables) -> DataFrame:
    """A shape as half-open ranges, written out again."""
    ranges = Box(*BOX, value=True).get_pixel_ranges(t.spark, NSIDE)
    return ranges.select(F.explode(F.sequence("start", F.col("end") - 1)).alias("pix"))


@query("nside_render", "WITH e AS (SELECT range AS pix FROM range(12288))," + sql_place("e", NSIDE // 4) + f", vec AS (SELECT pix, s * cos(radians(lon)) AS x, s * sin(radians(lon)) AS y, z FROM placed)\nSELECT pix * 16 + k.range AS pix FROM vec, range(16) k WHERE {IN_CIRCLE}")
def _render(t: Tables) -> DataFrame:
    """Rendered coarse, then upgraded."""
    return Circle(*CIRCLE, value=1, nside_render=NSIDE // 4).get_pixels(t.spark, NSIDE)


@query("realize_geom", _sql(f"SELECT pix, bit_or(v) AS v FROM (SELECT pix, v FROM m UNION ALL SELECT pix, 4096 FROM vec WHERE {IN_CIRCLE} UNION ALL SELECT pix, 8192 FROM vec WHERE {IN_BOX}) GROUP BY 1", "m"))
def _realize(t: Tables) -> DataFrame:
    return realize_geom([Circle(*CIRCLE, value=4096), Box(*BOX, value=8192)], t.m()).df


@query("geom_or", _sql(f"SELECT pix, bit_or(v) AS v FROM (SELECT pix, v FROM m UNION ALL SELECT pix, 4096 FROM vec WHERE {IN_CIRCLE}) GROUP BY 1", "m"))
def _geom_or(t: Tables) -> DataFrame:
    return (t.m() | Circle(*CIRCLE, value=4096)).df


@query("geom_and", _sql(f"SELECT pix, v FROM (SELECT m.pix, CASE WHEN i.pix IS NULL THEN v ELSE v & 3 END AS v FROM m LEFT JOIN (SELECT pix FROM vec WHERE {IN_CIRCLE}) i ON m.pix = i.pix) WHERE v <> 0", "m"))
def _geom_and(t: Tables) -> DataFrame:
    return (t.m() & Circle(*CIRCLE, value=3)).df


@query("geom_add", _sql(f"SELECT pix, sum(v) AS v FROM (SELECT pix, v FROM b UNION ALL SELECT pix, CAST(2 AS DOUBLE) FROM vec WHERE {IN_ELLIPSE}) GROUP BY 1", "b"))
def _geom_add(t: Tables) -> DataFrame:
    return (t.b() + Ellipse(*ELLIPSE, value=2.0)).df


@query("mask_by_polygon", _sql(f"SELECT pix, v FROM a WHERE pix NOT IN (SELECT pix FROM vec WHERE {_polygon()})", "a"))
def _mask(t: Tables) -> DataFrame:
    return t.a().apply_mask(Polygon(*POLYGON, value=True).get_map(t.spark, COVERAGE, NSIDE, "bool")).df


# interpolation ------------------------------------------------------------------------------------------------------
def _neighbours(ns: int) -> str:
    """CTEs from spots to near: event_id, ring number and weight of the four pixels around each position."""
    belt, total = 2 * ns * (ns - 1), 12 * ns * ns

    def ring(r: str, k: int) -> str:
        north = f"least({r}, {4 * ns} - {r})"
        return f"""
g{k}_1 AS (SELECT *, {north} AS north, {r} <> {north} AS south FROM {'spot' if k == 1 else 'h1'}),
g{k}_2 AS (SELECT *, CASE WHEN north < {ns} THEN 4 * north ELSE {4 * ns} END AS nr, CAST(north AS DOUBLE) * north / {3.0 * ns * ns} AS t, CASE WHEN north < {ns} OR (north - {ns}) & 1 = 0 THEN 0.5 ELSE 0.0 END AS shift FROM g{k}_1),
g{k}_3 AS (SELECT *, CASE WHEN north < {ns} THEN atan2(sqrt(t * (2.0 - t)), 1.0 - t) ELSE acos(({2 * ns} - north) * (CAST(2 AS DOUBLE) / {3 * ns})) END AS th, CASE WHEN north < {ns} THEN 2 * north * (north - 1) ELSE {belt} + {4 * ns} * (north - {ns}) END AS f, phi * nr / (2 * pi()) - shift AS place FROM g{k}_2),
h{k} AS (SELECT * EXCLUDE (north, south, nr, t, shift, th, f, place), CASE WHEN south THEN pi() - th ELSE th END AS th{k}, CASE WHEN south THEN {total} - f - nr ELSE f END + ((CAST(floor(place) AS BIGINT) % nr) + nr) % nr AS p{k}, CASE WHEN south THEN {total} - f - nr ELSE f END + ((CAST(floor(place) AS BIGINT) + 1) % nr + nr) % nr AS q{k}, place - floor(place) AS f{k} FROM g{k}_3)"""

    return f"""
spot0 AS (SELECT event_id, z, acos(z) AS theta, radians(ra) AS phi, CAST(floor({ns} * sqrt(3.0 * (1.0 - abs(z)))) AS BIGINT) AS capped FROM spots),
spot AS (SELECT *, greatest(1, least({4 * ns - 1}, above)) AS ra_, greatest(1, least({4 * ns - 1}, above + 1)) AS rb_ FROM (SELECT *, CASE WHEN abs(z) <= CAST(2 AS DOUBLE) / 3 THEN CAST(floor({ns} * (2.0 - CAST(1.5 AS DOUBLE) * z)) AS BIGINT) WHEN z > 0 THEN capped ELSE {4 * ns} - capped - 1 END AS above FROM spot0)),
{ring('ra_', 1).strip()},
{ring('rb_', 2).strip()},
u AS (SELECT *, above <= 0 AS top, above + 1 >= {4 * ns} AS bottom, CASE WHEN above <= 0 THEN theta / th2 WHEN above + 1 >= {4 * ns} THEN (theta - th1) / (pi() - th1) ELSE (theta - th1) / (th2 - th1) END AS d FROM h2),
near AS (
  SELECT event_id, CASE WHEN top THEN (p2 + 2) & 3 ELSE p1 END AS ring, CASE WHEN top THEN (1 - d) / 4 ELSE (1 - f1) * (1 - d) + CASE WHEN bottom THEN d / 4 ELSE 0 END END AS weight FROM u
  UNION ALL SELECT event_id, CASE WHEN top THEN (q2 + 2) & 3 ELSE q1 END, CASE WHEN top THEN (1 - d) / 4 ELSE f1 * (1 - d) + CASE WHEN bottom THEN d / 4 ELSE 0 END END FROM u
  UNION ALL SELECT event_id, CASE WHEN bottom THEN ((p1 - {total - 4} + 2) & 3) + {total - 4} ELSE p2 END, CASE WHEN bottom THEN d / 4 ELSE (1 - f2) * d + CASE WHEN top THEN (1 - d) / 4 ELSE 0 END END FROM u
  UNION ALL SELECT event_id, CASE WHEN bottom THEN ((q1 - {total - 4} + 2) & 3) + {total - 4} ELSE q2 END, CASE WHEN bottom THEN d / 4 ELSE f2 * d + CASE WHEN top THEN (1 - d) / 4 ELSE 0 END END FROM u)"""


def _interpolated(good: str) -> str:
    more = f"{_neighbours(NSIDE)},{sql_place('a', NSIDE)}, by_ring AS (SELECT ring, v FROM placed)"
    return with_relations(
        f"SELECT event_id, CASE WHEN {good} THEN round(sum(v * weight) / sum(CASE WHEN v IS NOT NULL THEN weight END), 0) ELSE CAST(-1.6375e30 AS DOUBLE) END AS v FROM near LEFT JOIN by_ring ON near.ring = by_ring.ring GROUP BY 1", "spots", "a", more=more
    )


def _at(t: Tables, partial: bool) -> DataFrame:
    points = t.spots().select("event_id", "ra", F.degrees(F.asin("z")).alias("dec"))
    out = t.a().interpolate_pos(points, allow_partial=partial)
    return out.select("event_id", F.when(F.col("v") > F.lit(px.UNSEEN), F.round("v", 0)).otherwise(F.col("v")).alias("v"))


@query("interpolate_pos", _interpolated("count(v) = 4"))
def _interpolate(t: Tables) -> DataFrame:
    return _at(t, False)


@query("interpolate_pos_partial", _interpolated("sum(CASE WHEN v IS NOT NULL THEN weight END) > 0"))
def _interpolate_partial(t: Tables) -> DataFrame:
    return _at(t, True)


# random positions ---------------------------------------------------------------------------------------------------
def _judged(m: SkyMap, points: DataFrame) -> DataFrame:
    looked = m.get_values_pos(points, valid_mask=True)
    return looked.agg(F.count("*").alias("n"), F.count(F.when(F.col("valid"), 1)).alias("inside"))


@query("make_uniform_randoms_fast", "SELECT CAST(5000 AS BIGINT) AS n, CAST(5000 AS BIGINT) AS inside")
def _fast(t: Tables) -> DataFrame:
    """How many of 5000 positions lie within the map: all."""
    return _judged(t.ap(), sampling.make_uniform_randoms_fast(t.ap(), 5000, seed=3))


@query("make_uniform_randoms", "SELECT CAST(5000 AS BIGINT) AS n, CAST(5000 AS BIGINT) AS inside")
def _slow(t: Tables) -> DataFrame:
    return _judged(t.ap(), sampling.make_uniform_randoms(t.ap(), 5000, seed=3))


# multi-order coverage -----------------------------------------------------------------------------------------------
_BLOCKY = "blocky AS (SELECT pix FROM ba UNION SELECT range FROM range(1000, 9000))"


def _moc_levels() -> str:
    parts, chain, now = [], [_BLOCKY], "blocky"
    for order in range(7, 3, -1):
        chain.append(f"up{order} AS (SELECT pix >> 2 AS pix FROM {now} GROUP BY 1 HAVING count(*) = 4)")
        parts.append(f"SELECT pix + {4 * 4**order} AS uniq FROM {now} WHERE pix >> 2 NOT IN (SELECT pix FROM up{order})")
        now = f"up{order}"
    parts.append(f"SELECT pix + {4 * 4**3} FROM {now}")
    return with_relations(" UNION ALL ".join(parts), "ba", more=", ".join(chain))


def _blocky(t: Tables) -> SkyMap:
    return t.ba().update_values_pix([(1000, 9000)], True, operation="or")


@query("write_moc", _moc_levels())
def _to_moc(t: Tables) -> DataFrame:
    return moc.to_moc(_blocky(t))


@query("read_moc", with_relations("SELECT pix FROM blocky", "ba", more=_BLOCKY))
def _from_moc(t: Tables) -> DataFrame:
    return moc.from_moc(moc.to_moc(_blocky(t)), COVERAGE, NSIDE).df


@query("read_moc_mixed_orders", with_relations("SELECT DISTINCT c.pix * 4096 + k.range AS pix FROM (SELECT DISTINCT pix % 3 AS pix FROM ba) c, range(4096) k UNION SELECT pix FROM ba UNION SELECT (pix >> 4) * 16 + k.range FROM ba, range(16) k", "ba"))
def _mixed(t: Tables) -> DataFrame:
    """Cells of orders 1, 5 and 7 that overlap."""
    ba = t.ba().df
    cells = ba.select((F.col("pix") % 3 + 16).alias("uniq")).union(ba.select(F.col("pix") + 4 * 4**7)).union(ba.select(F.shiftright("pix", 4) + 4 * 4**5))
    return moc.from_moc(cells.distinct(), COVERAGE).df
