"""Maps as Parquet: a layout of valid rows that Spark prunes by itself, and the dense one that other programs read.

Native: `iopix=<coarse pixel>/` folders of rows (pix, values), sorted by pixel in every file, so that a filter on pixels
prunes folders by `iopix` and row groups by their bounds. Rows are dealt by ranges of pixels, not by folder, so a full
folder is written by many tasks. Coverage lies beside the rows in `_coverage`, the description in `_map.json`.

Dense: `iopix=###/###.parquet` with a row group for each covered pixel, which holds all its fine pixels in order,
`_coverage.parquet` with each pixel's row group, and the description as key-value metadata.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixelization as px
from ..functions.dtypes import SPARK, is_float
from ..operators.skymap import Meta, SkyMap, describe
from .files import Whole, at, check_target, exists, read_json, write_json

ARROW = {
    "bool": pa.bool_(), "int8": pa.int8(), "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(), "uint8": pa.uint8(), "uint16": pa.uint16(), "uint32": pa.uint32(), "uint64": pa.uint64(),
    "float16": pa.float16(), "float32": pa.float32(), "float64": pa.float64(),
}
#: Before the colons of the dense layout's keys; any is read, and other programs may ask for one of their own.
PREFIX = "sparsemap"


def _io_bits(nside_io: int, nside_coverage: int) -> int:
    if not 0 < nside_io <= 16 or nside_io > nside_coverage:
        raise ValueError("nside_io lies from 1 to 16 and is no finer than the coverage")
    return px.shift_between(nside_coverage, nside_io)


# native -------------------------------------------------------------------------------------------------------------
def write_rows(m: SkyMap, path: str, clobber: bool = False, nside_io: int = 4) -> None:
    check_target(path, clobber)
    bits = m.meta.bits + _io_bits(nside_io, m.nside_coverage)
    rows = m.df.repartitionByRange("pix").withColumn("iopix", F.shiftright("pix", bits).cast("int"))
    rows.sortWithinPartitions("iopix", "pix").write.partitionBy("iopix").parquet(path)
    m.cov.select("cov_pix").coalesce(1).write.parquet(f"{path}/_coverage")
    meta = vars(m.meta) | {"nside_io": nside_io}
    write_json(f"{path}/_map.json", meta)


def read_rows(spark: SparkSession, path: str, pixels: list[int] | None = None) -> SkyMap:
    """A map, or some of its blocks: the filter names both folders and pixels, so both levels are pruned."""
    told = read_json(f"{path}/_map.json")
    nside_io = told.pop("nside_io")
    meta = Meta(**told)
    df = _filled(spark, path, f"{meta.schema()}, iopix int")
    cov = spark.read.schema("cov_pix bigint").parquet(f"{path}/_coverage")
    if pixels is not None:
        df = df.filter(pixel_filter(pixels, meta, nside_io))
        cov = cov.filter(F.col("cov_pix").isin([int(p) for p in pixels]))
    return SkyMap(df.select("pix", *meta.values), meta, cov)


def pixel_filter(pixels: list[int], meta: Meta, nside_io: int):  # noqa: ANN201
    """Rows of some blocks, stated by folder and by ranges of pixels."""
    io = px.shift_between(meta.nside_coverage, nside_io)
    spans: list[list[int]] = []
    for p in sorted({int(p) for p in pixels}):
        if spans and spans[-1][1] == p:
            spans[-1][1] = p + 1
        else:
            spans.append([p, p + 1])
    out = F.lit(False)
    for a, b in spans:
        out = out | ((F.col("pix") >= a << meta.bits) & (F.col("pix") < b << meta.bits))
    return F.col("iopix").isin(sorted({int(p) >> io for p in pixels})) & out


def _filled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder that may hold none."""
    system, p = at(path)
    some = any(i.base_name.startswith("iopix=") for i in system.get_file_info(FileSelector(p)))
    return spark.read.schema(schema).parquet(path) if some else spark.createDataFrame([], schema)


# dense --------------------------------------------------------------------------------------------------------------
def _described(m: SkyMap, nside_io: int, prefix: str) -> dict[str, str]:
    meta = m.meta
    told = {
        "version": "1", "nside_sparse": str(meta.nside_sparse), "nside_coverage": str(meta.nside_coverage), "nside_io": str(nside_io), "filetype": prefix, "primary": meta.primary or "",
        "sentinel": "UNSEEN" if isinstance(meta.sentinel, float) and np.isclose(meta.sentinel, px.UNSEEN) else str(meta.sentinel), "widemask": str(meta.kind == "wide"), "wwidth": str(max(1, meta.maxbits // 8)), "bitpacked": str(meta.packed),
    }
    out = {f"{prefix}::{k}": v for k, v in told.items()}
    if meta.metadata:
        out[f"{prefix}::header"] = "".join(f"{json.dumps([k, v])}\n" for k, v in meta.metadata.items())
    return out


def write_dense(m: SkyMap, path: str, clobber: bool = False, nside_io: int = 4, prefix: str = PREFIX) -> None:
    """Every covered pixel's row group is packed by itself; a task writes the files of its folders one row group after another."""
    from .fits import dense_blocks

    check_target(path, clobber)
    meta, n = m.meta, 1 << m.meta.bits
    io = _io_bits(nside_io, meta.nside_coverage)
    kinds = {c: ARROW[t] for c, t in meta.dtype.items()} if meta.kind == "record" else {"sparse": pa.uint8() if meta.kind == "wide" or meta.packed else ARROW[meta.dtype]}
    schema = pa.schema([("cov_pix", pa.int32()), *kinds.items()], metadata=_described(m, nside_io, prefix))

    def pack(dense: dict[str, np.ndarray]) -> bytes:
        if meta.kind == "wide":
            words = np.stack([dense[c] for c in meta.values], axis=1).astype("<i8")
            cols = [pa.array(np.ascontiguousarray(words.view(np.uint8).reshape(n, -1)[:, : meta.maxbits // 8]).reshape(-1))]
        elif meta.kind == "bool":
            cols = [pa.array(np.packbits(dense["v"], bitorder="little")) if meta.packed else pa.array(dense["v"].astype(bool))]
        else:
            cols = [_typed(dense[c], t) for c, t in (meta.dtype.items() if meta.kind == "record" else [("v", meta.dtype)])]
        sink = pa.BufferOutputStream()
        table = pa.table(cols, names=list(kinds))
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, writer, done = None, None, None, []

        def close() -> None:
            if writer is not None:
                writer.close()
                whole.__exit__(None)

        for b in batches:
            for iopix, cov, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if iopix != now:
                    close()
                    now, group = iopix, 0
                    whole = Whole(f"{path}/iopix={iopix:03d}/{iopix:03d}.parquet", str(TaskContext.get().taskAttemptId()))
                    writer = pq.ParquetWriter(whole.__enter__(), schema)
                table = pa.ipc.open_stream(data).read_all()
                table = pa.table([pa.array(np.full(len(table), cov, np.int32)), *table.columns], schema=schema)
                writer.write_table(table, row_group_size=len(table))
                done.append((cov, group))
                group += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int32())], names=["cov_pix", "row_group"])

    at(path)[0].create_dir(at(path)[1], recursive=True)
    blocks = dense_blocks(m, pack).select(F.shiftright("cov_pix", io).cast("int").alias("iopix"), "cov_pix", "data")
    blocks = blocks.repartition("iopix").sortWithinPartitions("iopix", "cov_pix")
    rows = sorted((r[0], r[1]) for r in blocks.mapInArrow(run, "cov_pix int, row_group int").collect())  # two numbers a block
    cov = pa.table({"cov_pix": pa.array([r[0] for r in rows], pa.int32()), "row_group": pa.array([r[1] for r in rows], pa.int32())})
    with Whole(f"{path}/_coverage.parquet") as out:
        pq.write_table(cov, out)
    for name in ("_common_metadata", "_metadata"):
        with Whole(f"{path}/{name}") as out:
            pq.write_metadata(schema, out)


def _typed(values: np.ndarray, dtype: str) -> pa.Array:
    if dtype == "uint64":
        return pa.array(values.astype(np.int64).view(np.uint64))
    with np.errstate(over="ignore"):  # 16-bit floats: UNSEEN is beyond them and becomes an infinity
        return pa.array(values.astype(np.dtype(dtype)))


def dense_description(path: str) -> tuple[dict[str, str], pa.Schema]:
    system, p = at(path)
    with system.open_input_file(f"{p}/_common_metadata") as f:
        schema = pq.read_schema(f)
    told = {k.decode().partition("::")[2]: v.decode() for k, v in (schema.metadata or {}).items() if b"::" in k}
    if "filetype" not in told:
        raise RuntimeError(f"{path} is no map")
    if not exists(f"{path}/_coverage.parquet"):
        raise RuntimeError(f"{path} has no coverage")
    return told, schema


def is_dense(path: str) -> bool:
    return exists(f"{path}/_common_metadata")


def is_native(path: str) -> bool:
    return exists(f"{path}/_map.json")


def _signed(x: Column, dtype: str) -> Column:
    """A column of the file in the map's storage type; unsigned 64-bit integers, decimals to Spark, keep their bits."""
    if dtype != "uint64":
        return x.cast(SPARK[dtype])
    d = x.cast("decimal(21,0)")
    return F.when(d >= F.lit(str(1 << 63)).cast("decimal(21,0)"), d - F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(d).cast("bigint")


def _with_half_floats(spark: SparkSession, path: str, schema: pa.Schema) -> DataFrame:
    """The rows of files that hold 16-bit floats, which Spark's reader turns away: read by file, one row group at a time."""
    system, p = at(path)
    files = [f.path for f in system.get_file_info(FileSelector(p, recursive=True)) if f.path.endswith(".parquet") and "/iopix=" in f.path]
    names = [n for n in schema.names if n != "iopix"]
    wide = {pa.float16(): pa.float32(), pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64()}
    kinds = [wide.get(schema.field(n).type, schema.field(n).type) for n in names]
    told = {pa.int8(): "tinyint", pa.int16(): "smallint", pa.int32(): "int", pa.int64(): "bigint", pa.float32(): "float", pa.float64(): "double", pa.bool_(): "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                io = int(name.rpartition("/iopix=")[2].partition("/")[0])
                with at(path)[0].open_input_file(name) as f:
                    whole, row = pq.ParquetFile(f), 0
                    for g in range(whole.num_row_groups):
                        t = whole.read_row_group(g, columns=names)
                        cols = [t[n].cast(k).combine_chunks() for n, k in zip(names, kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(t), io, np.int32)), pa.array(np.arange(row, row + len(t)))], names=[*names, "iopix", "_row_index"])
                        row += len(t)

    todo = spark.createDataFrame([(f,) for f in files] or [], "file string").repartition(max(1, len(files)))
    return todo.mapInArrow(run, ", ".join(f"`{n}` {told[k]}" for n, k in zip(names, kinds, strict=True)) + ", iopix int, _row_index bigint")


def _dense_coverage(spark: SparkSession, path: str) -> DataFrame:
    """Covered pixels, from a file that Spark's reader takes for a hidden one; at most one number for each coarse pixel."""
    system, p = at(path)
    with system.open_input_file(f"{p}/_coverage.parquet") as f:
        return spark.createDataFrame([(int(c),) for c in pq.read_table(f)["cov_pix"].to_pylist()], "cov_pix bigint")


def read_dense(spark: SparkSession, path: str, pixels: list[int] | None = None) -> tuple[SkyMap, dict]:
    """Pixel numbers follow from a row's place: all row groups before it in its file are whole blocks."""
    told, schema = dense_description(path)
    named = {str(v): k for k, v in ARROW.items()}
    nc, ns = int(told["nside_coverage"]), int(told["nside_sparse"])
    wide, packed, primary = told["widemask"] == "True", told["bitpacked"] == "True", told["primary"] or None
    columns = {f.name: named[str(f.type)] for f in schema if f.name not in ("cov_pix", "iopix")}
    dtype = columns if primary else "bool" if packed else columns["sparse"]
    text = told["sentinel"]
    kind = columns[primary] if primary else dtype
    sentinel = None if wide or kind == "bool" else px.UNSEEN if text == "UNSEEN" else float(text) if is_float(kind) else int(float(text)) if "." in text else int(text)
    header = dict(json.loads(line) for line in told.get("header", "").splitlines() if line.startswith("["))
    own = {k: v for k, v in header.items() if k == k.upper()} or None
    meta = describe(nc, ns, dtype, primary, sentinel, 8 * int(told["wwidth"]) if wide else 0, own, packed)
    cov = _dense_coverage(spark, path)
    half = "float16" in columns.values()
    rows = _with_half_floats(spark, path, schema) if half else spark.read.parquet(path)
    if pixels is not None:
        if len(set(pixels)) < len(pixels):
            raise RuntimeError("the pixels to read must be unique")
        cov = cov.filter(F.col("cov_pix").isin([int(p) for p in pixels]))
        if not cov.take(1):
            raise RuntimeError("none of the pixels is covered")
        io = px.shift_between(nc, int(told["nside_io"]))
        rows = rows.filter(F.col("iopix").isin(sorted({int(p) >> io for p in pixels})) & F.col("cov_pix").isin([int(p) for p in pixels]))
    n, width = 1 << meta.bits, meta.maxbits // 8 if wide else 1
    per = n // 8 if packed else n * width
    place = F.pmod(F.col("_row_index" if half else "_metadata.row_index"), F.lit(per))
    base = F.shiftleft(F.col("cov_pix").cast("bigint"), meta.bits)
    if packed:
        byte = rows.select((base + 8 * place).alias("_base"), F.col("sparse").cast("int").alias("_b")).filter("_b <> 0")
        df = byte.select("_base", "_b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_k")).filter(F.call_function("bit_get", "_b", "_k") == 1).select((F.col("_base") + F.col("_k")).alias("pix"))
    elif wide:
        at_byte = F.pmod(place, F.lit(width))
        bytes_ = rows.select((base + F.floor(place / F.lit(width)).cast("bigint")).alias("pix"), at_byte.alias("_k"), F.col("sparse").cast("bigint").alias("_b")).filter("_b <> 0")
        word = [F.bit_or(F.when(F.floor(F.col("_k") / 8) == i, F.call_function("shiftleft", F.col("_b"), (8 * F.pmod(F.col("_k"), F.lit(8))).cast("int"))).otherwise(F.lit(0).cast("bigint"))).alias(c) for i, c in enumerate(meta.values)]
        df = bytes_.groupBy("pix").agg(*word)
    elif meta.kind == "bool":
        df = rows.filter("sparse").select((base + place).alias("pix"))
    else:
        names = {c: c for c in meta.values} if primary else {"v": "sparse"}
        types = {c: meta.dtype[c] if primary else dtype for c in names}
        if half:  # where UNSEEN is stored as an infinity
            rows = rows.replace(float("-inf"), px.UNSEEN)
        df = rows.select((base + place).alias("pix"), *[_signed(F.col(f), types[c]).alias(c) for c, f in names.items()]).filter(meta.valid())
    return SkyMap(df, meta, cov), header


def read_coverage(spark: SparkSession, path: str) -> tuple[int, int, DataFrame]:
    """(coverage resolution, map resolution, covered pixels) without touching the rows."""
    if is_native(path):
        told = read_json(f"{path}/_map.json")
        return told["nside_coverage"], told["nside_sparse"], spark.read.schema("cov_pix bigint").parquet(f"{path}/_coverage")
    told, _ = dense_description(path)
    return int(told["nside_coverage"]), int(told["nside_sparse"]), _dense_coverage(spark, path)
