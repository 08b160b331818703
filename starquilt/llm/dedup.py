"""Exact deduplication by two Bloom passes.

Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Pass one marks, for every
text's digest, `HASHES` slots of a filter that counts to two ("once" and "twice" bitmaps, merged by saturating
addition). Pass two probes: a digest with some slot not marked twice occurs once for certain and its row passes
straight through; the other rows, repeated ones and a few false alarms, shuffle by the whole digest and are
compared exactly.

The filter has `BITS` bits for each row, whatever their number, so about one unique row in 400 is a false alarm at any
size. It is cut into pages of at most `PAGE` bits; the slots of a digest lie in one page. Each page is merged by one
task, which writes its "twice" bitmap as a file of the shared folder; Spark's file distribution brings the files to the
executors, where workers memory-map them. No bitmap is held by the driver or in an executor's memory: what grows with
the rows is two bytes of each executor's disk for each of them, and what the driver sees is one path for each page.

Defined cases: rows with equal doc_id and text are one group of which a single row stays, the one whose other columns
have the least hash; a null doc_id is less than any other; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from .shared import columns_of, frozen, join_groups, map_pieces, new_path, row_hash, unused

HASHES, BITS = 4, 16
#: Bits of a page at most, and at least (but for the last rounding up to a power of two).
PAGE, LEAST_PAGE = 1 << 27, 1 << 18


class Filter(NamedTuple):
    """The files of the pages by number, for pages that have a slot marked twice, and the layout."""

    files: dict[int, str]
    pages: int
    page_bits: int


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased; bytes.lower() touches ASCII alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def layout(rows: int, bits: float, page: int, tasks: int) -> tuple[int, int]:
    """Number of pages and bits of each (a power of two): `bits` for each row in all, and work for `tasks` where there is enough."""
    every = max(1, int(bits * rows))
    pages = max(-(-every // page), min(tasks, every // min(page, LEAST_PAGE)), 1)
    return pages, min(page, 1 << max(6, (-(-every // pages) - 1).bit_length()))


def _places(digests: pa.Array, pages: int, page_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Page of each digest, and its slots there in ascending order: parts of the digest are independent hashes."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 4)
    return ((raw[:, 0] >> np.uint64(32)) % np.uint64(pages)).astype(np.int64), np.sort(raw[:, :HASHES] & np.uint64(page_bits - 1), axis=1).astype(np.uint32)


def _has(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _put(bitmap: np.ndarray, slots: np.ndarray) -> None:
    """Set bits; slots ascend."""
    if len(slots):
        byte = slots >> 3
        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        bitmap[byte[first]] |= np.bitwise_or.reduceat(np.left_shift(1, slots & 7).astype(np.uint8), first)


def _probe(digests: pa.Array, found: Filter, opened: dict[int, np.ndarray]) -> np.ndarray:
    """False only for digests that some slot shows to be no repeated ones; `opened` keeps a task's maps."""
    out = np.zeros(len(digests), bool)
    if not len(digests):
        return out
    page, slots = _places(digests, found.pages, found.page_bits)
    order = np.argsort(page, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(page[order])) + 1):
        p = int(page[at[0]])
        if p in found.files:
            if p not in opened:
                opened[p] = np.memmap(SparkFiles.get(found.files[p]), np.uint8, "r")
            out[at] = _has(opened[p], slots[at]).all(axis=1)
    return out


def with_digest(df: DataFrame, text: str, name: str, found: Filter | None = None, maybe: str = "") -> DataFrame:
    """Add a binary SHA-256 of the normalised text; given a filter, also whether it may be repeated, in the same pass."""
    at = df.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, np.ndarray] = {}
        for b in batches:
            d = pa.array([hashlib.sha256(normalised(x)).digest() for x in b.column(at).to_pylist()], pa.binary())
            more = [pa.array(_probe(d, found, opened), pa.bool_())] if found else []
            yield pa.RecordBatch.from_arrays([*b.columns, d, *more], names=[*b.schema.names, name, maybe][: len(b.schema) + 1 + len(more)])

    schema = StructType([*df.schema.fields, StructField(name, BinaryType())])
    return map_pieces(df, add, StructType([*schema.fields, StructField(maybe, BooleanType())]) if found else schema)


def repeated_filter(digests: DataFrame, column: str, rows: int, bits: float = BITS, page: int = PAGE) -> Filter:
    """The filter of slots marked at least twice, for `rows` digests, at hand for all tasks."""
    spark = digests.sparkSession
    pages, page_bits = layout(rows, bits, page, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = new_path(spark, "bloom")
    kind = "page long, once binary, twice binary"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each page and some hundred thousand digests: the slots they mark once and more often."""
        held: list[np.ndarray] = []
        count = 0

        def marked() -> Iterator[pa.RecordBatch]:
            every = np.sort(np.concatenate(held))
            fresh = np.r_[True, every[1:] != every[:-1]]
            once, twice = every[fresh], np.unique(every[~fresh])
            numbers = np.unique(once >> np.uint64(32))
            cut = [np.searchsorted(x, np.r_[numbers, numbers[-1:] + np.uint64(1)] << np.uint64(32)).tolist() for x in (once, twice)]
            for lo in range(0, len(numbers), 256):
                parts = [[x[c[k] : c[k + 1]].astype("<u4").tobytes() for k in range(lo, min(lo + 256, len(numbers)))] for x, c in zip((once, twice), cut, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(numbers[lo : lo + 256].astype(np.int64)), *(pa.array(x, pa.binary()) for x in parts)], names=["page", "once", "twice"])

        for b in batches:
            if len(b):
                at, slots = _places(b.column(0), pages, page_bits)
                own = np.ones(slots.shape, bool)  # slots of one digest that coincide count once
                own[:, 1:] = slots[:, 1:] != slots[:, :-1]
                held.append((at.astype(np.uint64)[:, None] << np.uint64(32) | slots)[own])
                count += len(b)
                if count >= 1 << 18:
                    yield from marked()
                    held, count = [], 0
        if held:
            yield from marked()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by page; the two bitmaps of one page are held at a time."""
        attempt = TaskContext.get().taskAttemptId()
        now, once, twice = -1, np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        new: list[np.ndarray] = []
        again: list[np.ndarray] = []

        def fold() -> None:
            every = np.sort(np.concatenate([np.zeros(0, np.uint32), *new]))
            fresh = np.r_[True, every[1:] != every[:-1]][: len(every)]
            first = every[fresh]
            _put(twice, np.unique(np.concatenate([every[~fresh], first[_has(once, first)], *again])))
            _put(once, first)
            new.clear()
            again.clear()

        def written() -> Iterator[pa.RecordBatch]:
            fold()
            if twice.any():
                fs, at = pafs.FileSystem.from_uri(f"{folder}-{now:06d}")
                with fs.open_output_stream(f"{at}.{attempt}") as f:
                    f.write(twice)
                fs.move(f"{at}.{attempt}", at)
                yield pa.RecordBatch.from_pydict({"page": [now], "path": [f"{folder}-{now:06d}"]})

        for b in batches:
            for p, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != now:
                    if now >= 0:
                        yield from written()
                    now, once, twice = p, np.zeros(page_bits // 8, np.uint8), np.zeros(page_bits // 8, np.uint8)
                new.append(np.frombuffer(x, "<u4"))
                again.append(np.frombuffer(y, "<u4"))
                if sum(map(len, new)) > 1 << 20:
                    fold()
        if now >= 0:
            yield from written()

    parts = digests.select(column).mapInArrow(mark, kind)
    made = parts.repartition(pages, "page").sortWithinPartitions("page").mapInArrow(merge, "page long, path string").collect()
    for r in made:
        spark.sparkContext.addFile(r["path"])
    return Filter({r["page"]: r["path"].rpartition("/")[2] for r in made}, pages, page_bits)


def with_maybe_repeated(df: DataFrame, digest: str, found: Filter, name: str) -> DataFrame:
    """Add a boolean that is false only for digests that occur once where the filter `found` was made."""
    at = df.columns.index(digest)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, np.ndarray] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_probe(b.column(at), found, opened), pa.bool_())], names=[*b.schema.names, name])

    return map_pieces(df, probe, StructType([*df.schema.fields, StructField(name, BooleanType())]))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: float = BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A group of any size costs one pre-aggregated row per task in the
    shuffle that finds its largest id; their rows then meet it without a shuffle if the
    group is large, and by a join on the digest if not.
    """
    slim = with_digest(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", "_sha").drop("_text")
    slim = frozen(slim.withColumn("_row", F.monotonically_increasing_id()))
    marked = with_maybe_repeated(slim, "_sha", repeated_filter(slim, "_sha", slim.count(), bits), "_maybe")
    alone = marked.filter(~F.col("_maybe")).select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )
    some = frozen(marked.filter("_maybe").select("_id", "_sha", "_row"))
    best = some.groupBy("_sha").agg(F.max(F.struct("_id", "_row")).alias("_best"), F.count("*").alias("group_size"))
    rest = join_groups(some, best, "_sha", "group_size").select(
        F.col("_id").alias(id_col), F.col("_best._id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )
    return alone.unionByName(rest)


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: float = BITS) -> DataFrame:
    """The rows of `df`, all columns, without those whose text an equal text with a larger id repeats.

    Whole rows shuffle only where the filter says that the text may be repeated; the first-row limit of the window is
    applied before that shuffle too, so a huge group sends one row per task.
    """
    slim = frozen(with_digest(df.select(F.col(text_col).alias("_text")), "_text", "_sha").select("_sha"))
    found = repeated_filter(slim, "_sha", slim.count(), bits)
    sha, maybe, place = unused(df, "_sha", "_maybe", "_n")
    marked = with_digest(df, text_col, sha, found, maybe)
    order = Window.partitionBy(sha).orderBy(F.col(id_col).desc_nulls_last(), row_hash(df))
    first = marked.filter(maybe).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return marked.filter(~F.col(maybe)).select(*columns_of(df)).unionByName(first.select(*columns_of(df)))


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
