"""Streams into maps: batches, repeats, compaction, windows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from starquilt import SkyMap
from starquilt.streaming import accumulate, compact, snapshot, windowed_counts

NC, NS = 8, 64


def stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def values(m):
    return {r[0]: r[1] for r in m.df.collect()}


def test_batches_repeats_and_compaction(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    meta = SkyMap.make_empty(spark, NC, NS).meta
    assert snapshot(spark, meta, out).n_valid == 0
    kind = "pix bigint, v double"
    for rows in ([(1, 1.0), (1, 2.0), (5, 1.0)], [(1, 3.0)], [(1, 1.0), (9, 1.0)]):
        accumulate(stream(spark, source, rows, kind), meta, out, state=state, available_now=True).awaitTermination()
    assert values(snapshot(spark, meta, out)) == {1: 7.0, 5: 1.0, 9: 1.0}
    # nothing new: nothing counts twice
    accumulate(spark.readStream.schema(kind).parquet(source), meta, out, state=state, available_now=True).awaitTermination()
    compact(spark, meta, out)
    assert len([x for x in os.listdir(out) if x.startswith("batch=")]) == 2
    assert values(snapshot(spark, meta, out)) == {1: 7.0, 5: 1.0, 9: 1.0}
    accumulate(stream(spark, source, [(9, 2.0)], kind), meta, out, state=state, available_now=True).awaitTermination()
    assert values(snapshot(spark, meta, out)) == {1: 7.0, 5: 1.0, 9: 3.0}


def test_bits_by_position(spark, tmp_path):
    meta = SkyMap.make_empty(spark, NC, NS, "int32", sentinel=0).meta
    got = stream(spark, str(tmp_path / "in"), [(45.0, 0.1, 1), (45.0, 0.1, 6)], "ra double, dec double, v int")
    accumulate(got, meta, str(tmp_path / "out"), "or", available_now=True).awaitTermination()
    assert list(values(snapshot(spark, meta, str(tmp_path / "out"), "or")).values()) == [7]
    for bad, op in ((SkyMap.make_empty(spark, NC, NS, "bool").meta, "or"), (meta, "max")):
        with pytest.raises(ValueError):
            accumulate(got, bad, "x", op)


def test_sliding_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 0, 10, tzinfo=dt.UTC)
    rows = [(t, 45.0, 0.1), (t + dt.timedelta(minutes=30), 45.0, 0.1)]
    got = stream(spark, str(tmp_path / "in"), rows, "ts timestamp, ra double, dec double")
    counted = windowed_counts(got, NC, "ts", "1 hour", "30 minutes")
    out = str(tmp_path / "out")
    counted.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.withColumn("start", F.unix_timestamp("start")).write.mode("overwrite").parquet(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 1, 2]


def test_positions_by_sine(spark, tmp_path):
    """A position on the border of two pixels of nside 128, whose sine comes back otherwise from degrees."""
    rows = stream(spark, str(tmp_path / "in"), [(67.5, 0.5625, 1.0)], "ra double, z double, v double")
    meta, out = SkyMap.make_empty(spark, 8, 128).meta, str(tmp_path / "out")
    accumulate(rows, meta, out, dec="z", state=str(tmp_path / "state"), available_now=True, sine=True).awaitTermination()
    assert values(snapshot(spark, meta, out)) == {4918: 1.0}
    timed = spark.createDataFrame([(dt.datetime(2024, 1, 1), 67.5, 0.5625)], "ts timestamp, ra double, z double")
    assert [(r.pix, r.n) for r in windowed_counts(timed, 128, "ts", "1 hour", dec="z", sine=True).collect()] == [(4918, 1)]
