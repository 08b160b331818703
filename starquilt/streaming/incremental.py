"""Streams of positions or pixels merged into maps.

A batch of a stream is aggregated by pixel and written as a folder of its own, `batch=<number>`; sums and bits commute,
so a map is the aggregate of all folders. A batch that is run again after a failure overwrites its own folder, so every
row counts once, and no batch rewrites what the ones before it wrote. `compact` folds older folders into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import pixelization as px
from ..functions.ranking import new_path
from ..operators.skymap import Meta, SkyMap
from ..sources.files import at, exists, remove

OPERATIONS: dict[str, Callable[[str], Column]] = {"add": F.sum, "or": F.bit_or, "and": F.bit_and}


def _combined(rows: DataFrame, meta: Meta, operation: str) -> DataFrame:
    kinds = dict(f.split(" ", 1) for f in meta.schema().replace("`", "").split(", "))
    return rows.groupBy("pix").agg(*[OPERATIONS[operation](c).cast(kinds[c]).alias(c) for c in meta.values])


def _pixelled(rows: DataFrame, nside: int, ra: str, dec: str, sine: bool) -> DataFrame:
    return rows if "pix" in rows.columns else px.with_pixel(rows, nside, ra, dec, sine=sine)


def accumulate(stream: DataFrame, meta: Meta, path: str, operation: str = "add", ra: str = "ra", dec: str = "dec", state: str | None = None, available_now: bool = False, every: str = "1 minute", sine: bool = False) -> StreamingQuery:
    """Start a query that merges a stream of (pix or ra, dec; value columns) into the folder `path`; `state` is its checkpoint.

    With `sine`, `dec` names a column of sines of latitudes.
    """
    if operation not in OPERATIONS or meta.kind not in ("scalar", "wide"):
        raise ValueError("streams are added or combined bit by bit into maps of numbers and wide masks")

    def merge(batch: DataFrame, number: int) -> None:
        _combined(_pixelled(batch, meta.nside_sparse, ra, dec, sine).select("pix", *meta.values), meta, operation).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", state or new_path(stream.sparkSession, "state"))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def snapshot(spark: SparkSession, meta: Meta, path: str, operation: str = "add") -> SkyMap:
    """The map as of the batches written so far."""
    if not exists(path):
        return SkyMap(spark.createDataFrame([], meta.schema()), meta)
    rows = spark.read.schema(meta.schema()).option("basePath", path).parquet(path)
    return SkyMap(_combined(rows, meta, operation).filter(meta.valid()), meta)


def compact(spark: SparkSession, meta: Meta, path: str, operation: str = "add") -> None:
    """Fold all batch folders but the newest, which a restarted query may write again, into one; to be run while no query writes.

    The new folder, `<path>.compact`, is whole before it takes the old one's place.
    """
    system, target = at(path)
    numbers = sorted(int(i.base_name[6:]) for i in system.get_file_info(FileSelector(target)) if i.base_name.startswith("batch="))
    if len(numbers) < 3:
        return
    new = f"{path.rstrip('/')}.compact"
    if exists(new):
        remove(new)
    old, last = numbers[:-1], numbers[-1]
    rows = spark.read.schema(meta.schema()).parquet(*[f"{path}/batch={n}" for n in old])
    _combined(rows, meta, operation).repartitionByRange("pix").sortWithinPartitions("pix").write.parquet(f"{new}/batch={old[-1]}")
    spark.read.schema(meta.schema()).parquet(f"{path}/batch={last}").write.parquet(f"{new}/batch={last}")
    remove(path)
    system.move(at(new)[1], target)


def windowed_counts(stream: DataFrame, nside: int, time: str, width: str, slide: str | None = None, watermark: str = "1 hour", ra: str = "ra", dec: str = "dec", sine: bool = False) -> DataFrame:
    """(start, end, pix, n): positions of each pixel in tumbling or sliding windows of event time; rows later than the watermark are dropped."""
    rows = _pixelled(stream.withWatermark(time, watermark), nside, ra, dec, sine)
    by = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(by.alias("_w"), "pix").agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "pix", "n")
