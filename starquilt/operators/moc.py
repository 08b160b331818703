"""Multi-order coverage: sets of pixels of several resolutions, each coded as 4 * 4**order + pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixelization as px
from .skymap import Meta, SkyMap, expand_pixels


def to_moc(m: SkyMap) -> DataFrame:
    """(uniq) of the valid pixels: complete pixels of each order, never coarser than the coverage, that lie in no coarser complete one.

    All orders are counted in one shuffle, before which each task adds up its own counts; a second one, over complete
    pixels alone, finds those whose parent is complete.
    """
    finest, coarsest = px.order_of(m.nside_sparse), px.order_of(m.nside_coverage)
    levels = F.array(*[F.struct(F.lit(o).alias("order"), F.shiftright("pix", 2 * (finest - o)).alias("pix")) for o in range(coarsest, finest + 1)])
    counts = m.df.select(F.explode(levels).alias("_l")).groupBy("_l.order", "_l.pix").count()
    whole = counts.filter(F.col("count") == F.element_at(F.array(*[F.lit(4 ** (finest - o)) for o in range(finest + 1)]), F.col("order") + 1)).select("order", "pix")
    parents = whole.select((F.col("order") + 1).alias("order"), F.col("pix").alias("up"))
    left = whole.withColumn("up", F.shiftright("pix", 2)).join(parents, ["order", "up"], "left_anti")
    return left.select((F.col("pix") + _shifted(F.lit(4).cast("bigint"), 2 * F.col("order"))).alias("uniq"))


def _shifted(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits.cast("int"))


def from_moc(uniq: DataFrame, nside_coverage: int, nside_sparse: int | None = None) -> SkyMap:
    """A boolean map as fine as the finest pixel of (uniq), or as `nside_sparse` if that is finer.

    The set alone does not tell the resolution of the map it was made of: where all of it lies in complete coarser
    pixels, none of the finest is left.
    """
    # position of the highest bit: 2 + 2 * order
    order = F.floor((F.length(F.bin("uniq")) - 3) / 2).cast("int")
    rows = uniq.select(order.alias("order"), (F.col("uniq") - _shifted(F.lit(1).cast("bigint"), 2 + 2 * order)).alias("index"))
    finest = rows.agg(F.max("order")).first()[0]
    finest = max(px.order_of(nside_coverage), px.order_of(nside_sparse or 1), 0 if finest is None else finest)
    least = rows.agg(F.min("order")).first()[0]
    bits = (2 * (F.lit(finest) - F.col("order"))).cast("int")
    df = expand_pixels(rows.select(F.col("index").alias("pix"), "order"), bits, 2 * (finest - (finest if least is None else least))).select("pix").distinct()
    return SkyMap(df, Meta(nside_coverage, 1 << finest, "bool", "bool", False))
