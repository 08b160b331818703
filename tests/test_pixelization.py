"""Invariants of the pixelization: golden values, round trips, bijections, equal area."""

import math

import pytest
from pyspark.sql import functions as F

from starquilt.functions import pixelization as p


def test_golden(spark):
    df = spark.createDataFrame([(45.0, 0.1)], "lon double, lat double")
    assert p.with_pixel(df, 4096, "lon", "lat").first().pix == 51
    got = p.with_angles(spark.createDataFrame([(0,), (1999,)], "pix long"), 4096).collect()
    assert [(round(r.lon, 8), round(r.lat, 8)) for r in got] == [(45.0, 0.00932548), (45.3515625, 0.81134431)]


@pytest.mark.parametrize("nside", [1, 2, 64, 1 << 17, 1 << 29])
def test_round_trips(spark, nside):
    n = p.n_pixels(nside)
    df = (spark.range(n) if nside <= 64 else spark.range(20000).select((F.rand(5) * (n - 1)).cast("long").alias("id"))).withColumnRenamed("id", "pix")
    for lonlat in (True, False):
        back = p.with_pixel(p.with_angles(df, nside, "pix", ("a", "b"), lonlat), nside, "a", "b", "back", lonlat)
        assert back.filter("back <> pix").count() == 0
    if nside <= 1 << 23:
        assert p.with_nest(p.with_ring(df, nside), nside, "ring", "back").filter("back <> pix").count() == 0
    if nside <= 64:
        ring = p.with_z_lon(p.with_ring(df, nside), nside).orderBy("ring").collect()
        assert [r.ring for r in ring] == list(range(n))
        assert all(a.z > b.z - 1e-12 for a, b in zip(ring, ring[1:]))
        assert all(a.lon < b.lon for a, b in zip(ring, ring[1:]) if abs(a.z - b.z) < 1e-12)


def test_equal_area_and_parents(spark):
    df = spark.range(120_000).select((F.rand(1) * 360).alias("lon"), F.degrees(F.asin(2 * F.rand(2) - 1)).alias("lat"))
    df = p.with_pixel(p.with_pixel(df, 64, "lon", "lat"), 4, "lon", "lat", "four")
    counts = [r["count"] for r in df.groupBy(p.parent(F.col("pix"), 64, 1)).count().collect()]
    assert len(counts) == 12 and min(counts) > 9400 and max(counts) < 10600
    assert df.filter(p.parent(F.col("pix"), 64, 4) != F.col("four")).count() == 0


def test_weights(spark):
    nside = 16
    df = spark.range(3000).select("id", (F.rand(1) * 360).alias("lon"), F.degrees(F.asin(2 * F.rand(2) - 1)).alias("lat"))
    near = p.with_z_lon(p.explode_neighbours(df, nside, "lon", "lat"), nside, "pix", ("z", "l"))
    rows = near.groupBy("id", "lat").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min("w").alias("least"), F.sum(F.col("w") * F.col("z")).alias("z")).collect()
    assert len(rows) == 3000
    for r in rows:
        assert r.n == 4 and r.w == pytest.approx(1.0) and r.least > -1e-9
        assert abs(r.z - math.sin(math.radians(r.lat))) < 0.01  # a smooth function is reproduced
    own = p.explode_neighbours(p.with_angles(spark.range(p.n_pixels(nside)), nside, "id"), nside, "lon", "lat")
    assert own.filter("pix = id and w > 0.999").count() == p.n_pixels(nside)


def test_scalars():
    assert p.nside_of(p.n_pixels(256)) == 256 and p.shift_between(256, 32) == 6
    assert p.pixel_area(1) == pytest.approx(41252.96125 / 12) and p.resolution(1) ** 2 == pytest.approx(p.pixel_area(1))
    for bad in (0, 3, 1 << 30):
        with pytest.raises(ValueError):
            p.order_of(bad)
    with pytest.raises(ValueError):
        p.nside_of(100)
