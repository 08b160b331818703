"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.ranking import frozen, global_rank, new_path

__all__ = ["columns_of", "estimated_bytes", "frozen", "global_rank", "group_place", "hashed_unit", "join_groups", "map_pieces", "new_path", "parts_for", "pieces", "row_hash", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most, and bytes of the pieces in which functions over texts see a batch.
BATCH_ROWS, PIECE_BYTES = 1000, 4 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about PIECE_BYTES, so that what a function makes of a piece stays small."""
    for b in batches:
        step = max(1, len(b) * PIECE_BYTES // max(1, b.nbytes))
        for lo in range(0, len(b), step):
            yield b.slice(lo, step)


def map_pieces(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow over pieces of batches; the session's batches are limited to BATCH_ROWS rows and PIECE_BYTES bytes for it, of which a single long text may be more."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE_BYTES))
    if not any("." in c or "`" in c for c in df.columns):
        return df.mapInArrow(lambda batches: run(pieces(batches)), schema)
    # mapInArrow resolves names as paths: names with dots and ticks are set aside for it
    names, fields = df.columns, StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(pieces(x.rename_columns(names) for x in batches)):
            yield b.rename_columns([f"c{k}" for k in range(len(fields))])

    plain = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(renamed, plain).toDF(*[f.name for f in fields])


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row but for those that hold maps, which have no order."""
    return F.xxhash64(*[c for c, f in zip(columns_of(df), df.schema.fields, strict=True) if "map<" not in f.dataType.simpleString()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of `df` has it (in any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of `df`, which for a file scan comes from the file listing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Partitions that are asked for at most, however large the input: the driver keeps a few numbers for each.
MOST_PARTS = 100_000


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions so that each gets about `bytes_each` of the estimate; at least the session's shuffle partitions, at most MOST_PARTS."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = estimated_bytes(df)
    return least if known >= 1 << 60 else max(least, min(MOST_PARTS, known // bytes_each + 1))  # 2**63 - 1 stands for unknown


def group_place(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add a long `name`, counting the rows of each group of equal keys from 1, in some order that is fixed once computed.

    Rows are numbered within a group and partition, and moved up by what the partitions before hold of the group, so a
    group of any size is spread over as many tasks as the partitions it came from.
    """
    part, row, base, own, *other = unused(df, "_part", "_row", "_base", "_own", *[f"_k{k}" for k in range(len(keys))])
    rows = frozen(df.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()))
    held = rows.groupBy(part, *keys).agg(F.count("*").alias(own))  # a row for each group and partition
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col(part).alias(f"{part}_"), *[F.col(k).alias(o) for k, o in zip(keys, other, strict=True)], F.coalesce(F.sum(own).over(before), F.lit(0)).alias(base))
    placed = rows.withColumn(own, F.row_number().over(Window.partitionBy(part, *keys).orderBy(row)))
    same = F.col(part) == F.col(f"{part}_")
    for k, o in zip(keys, other, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(o))
    return placed.join(held, same).withColumn(name, (F.col(base) + F.col(own)).cast("long")).drop(part, f"{part}_", row, base, own, *other)


def hashed_unit(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of `rows` to `groups`, which has a row for each key and the number of rows it stands for in `size`.

    Groups of over a thousandth of all rows number under a thousand whatever the input, so they are broadcast and their
    rows stay where they are; what remains has no large key and joins by shuffle. Null keys match.
    """
    groups = frozen(groups.withColumnRenamed(key, "_key"))  # renamed: the names of both sides are then clear
    total = int(groups.agg(F.sum(size)).first()[0] or 0)
    hot = F.col(size) > F.lit(max(100, total // 1000))
    big = groups.filter(hot)
    same = F.col(key).eqNullSafe(F.col("_key"))
    near = rows.join(F.broadcast(big), same)
    far = rows.join(F.broadcast(big.select("_key")), same, "left_anti").join(groups.filter(~hot), same)
    return near.unionByName(far).drop("_key")
