"""Mixing sources to target weights by systematic sampling.

Sizes are words (maximal runs of anything but space and 0x09-0x0D); a null text has none. Sources in code-point order,
null last, weigh 3, 1, 2, repeating, and share `budget` (1.5) times all words; a source's target is at most `most` (2)
times its own words, the excess being shared again by weight until none is above. Within a source every document
expects `target / source_size` copies. Documents stand in the order of size and id, a prefix sum of the expected copies
runs over them (expected copies times rank), one offset per source drawn by a seeded hash is added, and a document is
taken once for each whole number that its step crosses. The order by size spreads the choice evenly over long and
short documents, so the words taken come near the target.

Defined cases: sources without words have target 0; documents with no words take none; repeated rows and equal ids are
numbered one after another; an empty table gives an empty result; the same input and seed give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import columns_of, frozen, global_rank, group_place, hashed_unit, join_groups, map_pieces, unused

WEIGHTS = (3, 1, 2)


def with_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the number of words; bytes.split() cuts at just the six ASCII white-space bytes."""
    at = df.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.fromiter((len(x.encode("utf-8", "surrogatepass").split()) if x else 0 for x in b.column(at).to_pylist()), np.int64, len(b))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], names=[*b.schema.names, name])

    return map_pieces(df, add, StructType([*df.schema.fields, StructField(name, LongType())]))


def targets(sizes: DataFrame, budget: float, most: float) -> DataFrame:
    """Of (_source, _size) rows: a row per source with _words, _docs and _target. Sources are aggregated first; only scalars reach the driver."""
    by = sizes.groupBy("_source").agg(F.sum("_size").alias("_words"), F.count("*").alias("_docs"))
    by = global_rank(by.withColumn("_last", F.col("_source").isNull()), ["_last", "_source"], "_k").drop("_last")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_k") % len(WEIGHTS) + 1).cast("int"))
    by = frozen(by.withColumn("_w", weight).withColumn("_cap", F.col("_words") * F.lit(float(most))))
    want = budget * float(by.agg(F.sum("_words")).first()[0] or 0)
    level = 0.0  # words for each unit of weight
    while True:
        full = F.col("_w") * F.lit(level) >= F.col("_cap")
        got = by.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        if not got[1]:
            break
        new = (want - (got[0] or 0.0)) / got[1]
        if new <= level * (1 + 1e-15):
            break
        level = new
    return by.withColumn("_target", F.least(F.col("_cap"), F.col("_w") * F.lit(level))).select("_source", "_words", "_docs", "_target")


def decided(df: DataFrame, id_col: str, text_col: str, source_col: str, budget: float, most: float, seed: int) -> DataFrame:
    """A row per document: _id, _source, _hash (of the text), _size, _words and _target of its source, _copies."""
    sizes = with_words(df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text")), "_text", "_size").withColumn("_hash", F.xxhash64("_text")).drop("_text")
    ranked = frozen(global_rank(sizes.withColumn("_none", F.col("_source").isNull()), ["_none", "_source", "_size", "_id", "_hash"], "_rank"))
    by = targets(ranked.select("_source", "_size"), budget, most)
    first = ranked.groupBy(F.col("_source").alias("_s")).agg(F.min("_rank").alias("_first"))
    by = by.join(first, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("_source", "_of")
    by = by.withColumn("_rate", F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(0.0)).withColumn("_offset", hashed_unit(seed, F.coalesce("_of", F.lit("")), F.col("_of").isNull()))
    rows = join_groups(ranked, by.withColumnRenamed("_of", "_source"), "_source", "_docs")
    at = F.col("_rank") - F.col("_first")
    crossed = F.floor(F.col("_rate") * (at + 1) + F.col("_offset")) - F.floor(F.col("_rate") * at + F.col("_offset"))
    return rows.select("_id", "_source", "_hash", "_size", "_words", "_target", F.least(crossed, F.ceil("_rate")).cast("long").alias("_copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies and taken (copies times size)."""
    copies = F.col("_copies")
    return decided(df, id_col, text_col, source_col, budget, most, seed).select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).alias("taken")
    )


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """The rows of `df`, each as often as the mix takes it.

    Decisions join by id, source and hash of the text, which tell documents apart. Rows alike in all three share the
    copies of their group evenly: they are numbered, and those numbered first take the ones that are left over.
    """
    key, of, text_hash, copies, n, i, place = unused(df, "_key", "_of", "_hash", "_copies", "_rows", "_i", "_place")
    each = decided(df, id_col, text_col, source_col, budget, most, seed).groupBy(F.col("_id").alias(key), F.col("_source").alias(of), F.col("_hash").alias(text_hash)).agg(F.sum("_copies").alias(copies), F.count("*").alias(n))
    each = frozen(each.filter(F.col(copies) > 0))
    same = F.col(id_col).eqNullSafe(F.col(key)) & F.col(source_col).eqNullSafe(F.col(of)) & (F.xxhash64(F.col(text_col)) == F.col(text_hash))
    rows = df.join(each.filter(F.col(n) == 1), same).select(*columns_of(df), F.col(copies))
    alike = each.filter(F.col(n) > 1)
    if alike.take(1):
        many = group_place(df.join(alike, same), [key, of, text_hash], place)
        share = F.floor(F.col(copies) / F.col(n)) + F.when(F.col(place) <= F.col(copies) % F.col(n), 1).otherwise(0)
        rows = rows.union(many.select(*columns_of(df), share.cast("long").alias(copies)).filter(F.col(copies) > 0))
    return rows.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*columns_of(df))
