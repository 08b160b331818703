"""Numbering the rows of a table without one task that sees them all, and keeping tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where it is unset a local one is made, in local mode alone (tests); on a cluster that raises."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="starquilt-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def frozen(df: DataFrame) -> DataFrame:
    """`df` computed once: later reads agree and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _counted(rows: DataFrame, at: str) -> DataFrame:
    """`rows`, whose `at` is their monotonically increasing id, with `_base`, the number of rows in the partitions before: a number for each partition is all that reaches the driver."""
    counts = sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright(at, 33)).count().collect())
    base, total = [], 0
    for part, n in counts:
        base.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(base or [(0, 0)], "_part bigint, _base bigint")
    return rows.withColumn("_part", F.shiftright(at, 33)).join(F.broadcast(offsets), "_part").drop("_part")  # a row for each range


def global_rank(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add a long `name`, counting rows from 0 in the order of `keys` over the whole table.

    A range partitioning sorts the rows; each partition counts its own, and prefix sums over the partitions make the
    counts global. Rows that are equal in all keys are numbered in some order, which is fixed once computed.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered_rows(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys), name)


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """Add a long `name`, counting rows from 0 in the order in which they lie, without a shuffle; fixed once computed."""
    rows = frozen(df.withColumn("_at", F.monotonically_increasing_id()))
    return _counted(rows, "_at").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_base", "_at")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """n rows of `df` without sending them through one task."""
    return numbered_rows(df, "_place").filter(F.col("_place") < n).drop("_place")
