"""Queries that write a map, read it back, and return what came; and streams that build one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import new_path
from ..operators.skymap import SkyMap
from ..sources import concatenate_files, read_coverage, read_map, write_map
from ..streaming import accumulate, snapshot, windowed_counts
from .base import COVERAGE, NSIDE, Tables, query, sql_pixel, with_relations


def _there_and_back(t: Tables, m: SkyMap, form: str, **how: object) -> SkyMap:
    path = new_path(t.spark, f"map-{form}")
    write_map(m, path, form)
    return read_map(t.spark, path, **how)


def _round_trip(name: str, source: str, form: str, sql: str, **how: object) -> None:
    @query(name, with_relations(sql, source))
    def run(t: Tables) -> DataFrame:
        return _there_and_back(t, getattr(t, source)(), form, **how).df


_round_trip("io_fits", "b", "fits", "SELECT pix, v FROM b")
_round_trip("io_fits_int", "m", "fits", "SELECT pix, v FROM m")
_round_trip("io_fits_wide", "w", "fits", "SELECT pix, w0, w1 FROM w")
_round_trip("io_fits_record", "r", "fits", "SELECT pix, price, line FROM r")
_round_trip("io_fits_bool", "ba", "fits", "SELECT pix FROM ba")
_round_trip("io_fits_pixels", "b", "fits", "SELECT pix, v FROM b WHERE pix >> 8 IN (3, 700)", pixels=[3, 700])
_round_trip("io_parquet", "a", "parquet", "SELECT pix, v FROM a")
_round_trip("io_parquet_pixels", "a", "parquet", "SELECT pix, v FROM a WHERE pix >> 8 IN (3, 4, 700)", pixels=[3, 4, 700])
_round_trip("io_parquet_degrade", "a", "parquet", "SELECT pix >> 4 AS pix, max(v) AS v FROM a GROUP BY 1", degrade_nside=NSIDE // 4, reduction="max")
_round_trip("io_dense_parquet", "b", "dense", "SELECT pix, v FROM b")
_round_trip("io_dense_parquet_wide", "w", "dense", "SELECT pix, w0, w1 FROM w")
_round_trip("io_healpix_explicit", "b", "healpix", "SELECT pix, v FROM b", nside_coverage=COVERAGE)
_round_trip("io_moc", "ba", "moc", "SELECT pix FROM ba", nside_coverage=COVERAGE)


@query("io_fits_degrade", with_relations("SELECT b.pix >> 4 AS pix, sum(b.v * (b.pix % 7 + 1)) / sum(b.pix % 7 + 1) AS v FROM b GROUP BY 1", "b"))
def _weighted(t: Tables) -> DataFrame:
    """Degraded with weights while reading."""
    m = t.b()
    weights = SkyMap(m.df.select("pix", (F.col("pix") % 7 + 1).cast("double").alias("v")), m.meta, m.cov)
    path = new_path(t.spark, "weights")
    write_map(weights, path)
    return _there_and_back(t, m, "fits", degrade_nside=NSIDE // 4, reduction="wmean", weightfile=path).df


@query("io_coverage", with_relations("SELECT DISTINCT pix >> 8 AS cov_pix FROM ba", "ba"))
def _coverage(t: Tables) -> DataFrame:
    path = new_path(t.spark, "map")
    write_map(t.ba(), path)
    return read_coverage(t.spark, path).df


@query("concatenate_files", with_relations("SELECT coalesce(b.pix, a.pix) AS pix, coalesce(b.v, a.v) AS v FROM ap a FULL JOIN b ON a.pix = b.pix", "ap", "b"))
def _concatenate(t: Tables) -> DataFrame:
    paths = [new_path(t.spark, "part") for _ in range(2)]
    write_map(t.ap(), paths[0])
    write_map(t.b(), paths[1])
    out = new_path(t.spark, "joined")
    concatenate_files(t.spark, paths, out)
    return read_map(t.spark, out).df


def _stream(t: Tables) -> DataFrame:
    events = t.table("events")
    got = t.spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    # a time without a zone counts as UTC whatever the session's zone is
    ts = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)))").alias("ts")
    z = (F.col("event_id") * 7919 % 100000) / F.lit(50000.0) - 1
    return got.select(ts, (((F.col("event_id") * 137508) % 360000) / F.lit(1000.0)).alias("ra"), z.alias("z"), F.degrees(F.asin(z)).alias("dec"))


@query("stream_accumulate", with_relations("SELECT pix, CAST(count(*) AS DOUBLE) AS v FROM pixelled GROUP BY 1", "spots", more=sql_pixel("spots", NSIDE)))
def _accumulate(t: Tables) -> DataFrame:
    """A stream of positions, summed into a map batch by batch."""
    path = new_path(t.spark, "stream")
    empty = SkyMap.make_empty(t.spark, COVERAGE, NSIDE)
    accumulate(_stream(t).withColumn("v", F.lit(1.0)), empty.meta, path, dec="z", available_now=True, sine=True).awaitTermination()
    return snapshot(t.spark, empty.meta, path).df


@query("stream_windows", "WITH spots AS (SELECT ts, ((event_id * 137508) % 360000) / CAST(1000 AS DOUBLE) AS ra, ((event_id * 7919) % 100000) / CAST(50000 AS DOUBLE) - 1 AS z FROM events)," + sql_pixel("spots", COVERAGE) + "\nSELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, pix, count(*) AS n FROM pixelled GROUP BY 1, 2")
def _windows(t: Tables) -> DataFrame:
    """Positions counted by pixel and day of event time."""
    out, spark = new_path(t.spark, "windows"), t.spark
    counted = windowed_counts(_stream(t), COVERAGE, "ts", "1 day", watermark="2 days")

    def keep(batch: DataFrame, _: int) -> None:
        batch.select(F.unix_timestamp("start").alias("start"), "pix", "n").write.mode("overwrite").parquet(out)

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
