"""FITS files, read by ranges in tasks and written as a stream of blocks.

A map's file has two extensions: COV, an image of where each coarse pixel's block begins (less the coarse pixel's own
first pixel), and SPARSE, all blocks laid end to end after one block of sentinels: an image, a tile-compressed image or
a table of records. The driver reads headers and the coverage; tasks read the blocks, so a file is read in parallel and
only as far as blocks are asked for. Writing packs each block in a task; the driver copies one block after another.
"""

from __future__ import annotations

import gzip
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixelization as px
from ..functions.dtypes import SPARK, is_float
from ..operators.moc import from_moc, to_moc
from ..operators.skymap import Meta, SkyMap, describe
from .files import Whole, check_target, deal, open_input, stream_bytes

UNIT, CARD = 2880, 80
#: (BITPIX, BZERO) of each type.
IMAGE = {
    "uint8": (8, 0), "int8": (8, -128), "int16": (16, 0), "uint16": (16, 1 << 15), "int32": (32, 0), "uint32": (32, 1 << 31), "int64": (64, 0), "uint64": (64, 1 << 63), "float32": (-32, 0), "float64": (-64, 0),
}
#: (letter of TFORM, TZERO) of each type of a column.
COLUMN = {
    "bool": ("L", 0), "uint8": ("B", 0), "int8": ("B", -128), "int16": ("I", 0), "uint16": ("I", 1 << 15), "int32": ("J", 0), "uint32": ("J", 1 << 31), "int64": ("K", 0), "uint64": ("K", 1 << 63), "float32": ("E", 0), "float64": ("D", 0),
}
STORED = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
LETTER = {"L": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
#: What a file says of its own kind; a program that insists on another word gets it as a parameter.
PIXTYPE = "SPARSEMAP"
MOC_TOOL = "starquilt"


# headers ------------------------------------------------------------------------------------------------------------
def _value(text: str) -> Any:
    text = text.strip()
    if text.startswith("'"):
        end = 1
        while end < len(text) and (text[end] != "'" or text[end + 1 : end + 2] == "'"):
            end += 2 if text[end] == "'" else 1
        return text[1:end].replace("''", "'").rstrip()
    text = text.partition("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    if not text:
        return None
    try:
        return int(text)
    except ValueError:
        return float(text.replace("D", "E").replace("d", "e"))


def _card(key: str, value: Any) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int):
        text = f"{value:>20}"
    elif isinstance(value, float):
        text = f"{value!r:>20}".replace("e", "E")
    else:
        text = f"'{str(value).replace(chr(39), chr(39) * 2):<8}'"
    line = f"{key:<8}= {text}" if len(key) <= 8 else f"HIERARCH {key} = {text.strip() if not text.startswith(chr(39)) else text}"
    if len(line) > CARD:
        raise ValueError(f"the value of {key} is too long for a card")
    return f"{line:<80}".encode("ascii")


def header_bytes(cards: list[tuple[str, Any]]) -> bytes:
    raw = b"".join(_card(k, v) for k, v in cards) + f"{'END':<80}".encode()
    return raw + b" " * (-len(raw) % UNIT)


@dataclass
class Part:
    """One header and where its data lie."""

    header: dict[str, Any]
    offset: int
    size: int

    @property
    def compressed(self) -> bool:
        return bool(self.header.get("ZIMAGE"))

    @property
    def is_image(self) -> bool:
        return self.compressed or self.header.get("XTENSION", "IMAGE") == "IMAGE"

    def columns(self) -> dict[str, tuple[str, int, int, int]]:
        """Name to (letter, count, offset in a row, TZERO)."""
        out, at = {}, 0
        for k in range(1, self.header.get("TFIELDS", 0) + 1):
            form = self.header[f"TFORM{k}"].strip()
            digits = "".join(c for c in form[: len(form) - len(form.lstrip("0123456789"))])
            letter, count = form[len(digits)], int(digits or 1)
            out[self.header.get(f"TTYPE{k}", f"col{k}")] = (letter, count, at, int(self.header.get(f"TZERO{k}", 0)))
            at += count * {"P": 8, "Q": 16}.get(letter) if letter in "PQ" else count * (np.dtype(LETTER[letter]).itemsize if letter in LETTER else 1)
        return out

    def image_type(self) -> str:
        z = "Z" if self.compressed else ""
        return _named(self.header[f"{z}BITPIX"], int(self.header.get("BZERO", 0)))


def _named(bitpix: int, zero: int) -> str:
    return next(k for k, v in IMAGE.items() if v == (bitpix, zero))


def parts_of(path: str) -> list[Part]:
    """All headers of a file."""
    out: list[Part] = []
    with open_input(path) as f:
        size, at = f.size(), 0
        while at < size:
            header: dict[str, Any] = {}
            ended = False
            while not ended:
                block = f.read_at(UNIT, at).decode("ascii", "replace")
                at += UNIT
                if len(block) < UNIT:
                    raise OSError(f"{path} is no FITS file")
                for k in range(0, UNIT, CARD):
                    line = block[k : k + CARD]
                    key = line[:8].rstrip()
                    if key == "END":
                        ended = True
                        break
                    if key == "HIERARCH" and "=" in line:
                        key, _, rest = line[9:].partition("=")
                        header[key.strip()] = _value(rest)
                    elif line[8:10] == "= ":
                        header[key] = _value(line[10:])
                if not out and not header.get("SIMPLE"):
                    raise OSError(f"{path} is no FITS file")
            n = math.prod(header[f"NAXIS{k}"] for k in range(1, header["NAXIS"] + 1)) if header["NAXIS"] else 0
            data = abs(header["BITPIX"]) // 8 * header.get("GCOUNT", 1) * (header.get("PCOUNT", 0) + n) if n or header.get("PCOUNT") else 0
            out.append(Part(header, at, data))
            at += data + -data % UNIT
    return out


def is_fits(path: str) -> bool:
    with open_input(path) as f:
        return f.read_at(9, 0) == b"SIMPLE  ="


def extension(parts: list[Part], name: str) -> Part | None:
    return next((p for p in parts if str(p.header.get("EXTNAME", "")).strip().upper() == name), None)


# tiles --------------------------------------------------------------------------------------------------------------
def rice_decode(data: bytes, count: int, width: int, block: int = 32) -> np.ndarray:
    """Integers of a Rice-coded tile of `width` bytes each: differences, mapped to unsigned, split by a shift that each block states."""
    fs_bits, fs_max = {1: (3, 6), 2: (4, 14), 4: (5, 25)}[width]
    bits = 8 * width
    big = int.from_bytes(data, "big")
    left = 8 * len(data)
    left -= bits
    last = (big >> left) & ((1 << bits) - 1)
    out = np.empty(count, np.int64)
    i = 0
    text = None
    while i < count:
        n = min(block, count - i)
        if text is None:
            text = bin(big | (1 << (8 * len(data))))[3:]  # all bits as text: runs of zeros are found by index()
            at = bits
        shift = int(text[at : at + fs_bits], 2) - 1
        at += fs_bits
        if shift < 0:
            out[i : i + n] = last
        elif shift == fs_max:
            for k in range(n):
                d = int(text[at : at + bits], 2)
                at += bits
                last = (last + (~(d >> 1) if d & 1 else d >> 1)) & ((1 << bits) - 1)
                out[i + k] = last
        else:
            for k in range(n):
                one = text.index("1", at)
                d = (one - at) << shift
                at = one + 1
                if shift:
                    d |= int(text[at : at + shift], 2)
                    at += shift
                last = (last + (~(d >> 1) if d & 1 else d >> 1)) & ((1 << bits) - 1)
                out[i + k] = last
        i += n
    if width > 1:
        half = 1 << (bits - 1)
        out = np.where(out >= half, out - (1 << bits), out)
    return out


def tile_values(raw: bytes, how: str, bitpix: int, count: int, header: dict[str, Any]) -> np.ndarray:
    """Stored values of one tile."""
    kind = STORED[bitpix]
    if how == "RICE_1":
        params = {header.get(f"ZNAME{k}"): header.get(f"ZVAL{k}") for k in range(1, 4)}
        width = int(params.get("BYTEPIX") or abs(bitpix) // 8)
        return rice_decode(raw, count, width, int(params.get("BLOCKSIZE") or 32))
    if how not in ("GZIP_1", "GZIP_2"):
        raise NotImplementedError(f"tiles of {how}")
    plain = gzip.decompress(raw)
    width = len(plain) // count
    if width != np.dtype(kind).itemsize:
        kind = f">{'i' if bitpix > 0 else 'f'}{width}"
    if how == "GZIP_2":  # all first bytes, then all second ones
        plain = np.frombuffer(plain, np.uint8).reshape(width, count).T.tobytes()
    return np.frombuffer(plain, kind)


def tile_bytes(values: np.ndarray) -> bytes:
    """A tile in GZIP_2."""
    raw = np.frombuffer(values.tobytes(), np.uint8).reshape(len(values), -1)
    return gzip.compress(np.ascontiguousarray(raw.T).tobytes(), 6, mtime=0)


def _unzeroed(values: np.ndarray, zero: int) -> np.ndarray:
    """Stored values with their zero point added; 64-bit unsigned ones keep their bits in a signed integer."""
    if zero == 1 << 63:
        return (values.astype("<i8").view(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    return values.astype(np.int64) + zero if zero else values.astype(values.dtype.newbyteorder("="))


def _zeroed(values: np.ndarray, dtype: str) -> np.ndarray:
    """Values as they are stored."""
    bitpix, zero = IMAGE[dtype]
    if zero == 1 << 63:
        return (values.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).view(np.int64).astype(">i8")
    return (values.astype(np.int64) - zero if zero else values).astype(STORED[bitpix])


class Blocks:
    """Reads blocks of SPARSE; made anew in each task."""

    def __init__(self, path: str, part: Part, per_block: int):
        self.file, self.part, self.per_block = open_input(path), part, per_block
        h = part.header
        if part.compressed:
            self.how, self.bitpix, self.row = h["ZCMPTYPE"].strip(), h["ZBITPIX"], h["NAXIS1"]
            self.heap = part.offset + h.get("THEAP", h["NAXIS1"] * h["NAXIS2"])
            self.cols = part.columns()
            axes = [h[f"ZNAXIS{k}"] for k in range(1, h["ZNAXIS"] + 1)]
            self.tile = math.prod(h.get(f"ZTILE{k}", axes[0] if k == 1 else 1) for k in range(1, len(axes) + 1))
            self.total = math.prod(axes)

    def _tile(self, k: int) -> np.ndarray:
        count = min(self.tile, self.total - k * self.tile)
        record = self.file.read_at(self.row, self.part.offset + k * self.row)
        for name, how in (("COMPRESSED_DATA", self.how), ("GZIP_COMPRESSED_DATA", "GZIP_1"), ("UNCOMPRESSED_DATA", "")):
            if name in self.cols:
                letter, _, at, _ = self.cols[name]
                n, where = struct.unpack_from(">2i" if letter == "P" else ">2q", record, at)
                if n:
                    form = next(self.part.header[f"TFORM{i}"] for i in range(1, 9) if self.part.header.get(f"TTYPE{i}") == name)
                    width = {"B": 1, "I": 2, "J": 4, "E": 4, "D": 8}.get(form.strip().lstrip("0123456789")[1:2], 1)
                    raw = self.file.read_at(n * width, self.heap + where)
                    return tile_values(raw, how, self.bitpix, count, self.part.header) if how else np.frombuffer(raw, STORED[self.bitpix])
        raise OSError("a tile has no data")

    def image(self, k: int) -> np.ndarray:
        """Stored values of block k."""
        n = self.per_block
        if not self.part.compressed:
            kind = STORED[self.part.header["BITPIX"]]
            size = np.dtype(kind).itemsize
            return np.frombuffer(self.file.read_at(n * size, self.part.offset + k * n * size), kind)
        lo, hi = k * n // self.tile, -(-(k + 1) * n // self.tile)
        got = np.concatenate([self._tile(t) for t in range(lo, hi)])
        return got[k * n - lo * self.tile :][:n]

    def records(self, k: int) -> dict[str, np.ndarray]:
        return table_columns(self.file, self.part, k * self.per_block, self.per_block)


def table_columns(file: pa.NativeFile, part: Part, first: int, count: int) -> dict[str, np.ndarray]:
    row = part.header["NAXIS1"]
    raw = np.frombuffer(file.read_at(row * count, part.offset + first * row), np.uint8).reshape(-1, row)
    out = {}
    for name, (letter, n, at, zero) in part.columns().items():
        kind = np.dtype(LETTER[letter])
        v = np.ascontiguousarray(raw[:, at : at + n * kind.itemsize]).view(kind).reshape(-1)
        out[name] = v == ord("T") if letter == "L" else _unzeroed(v, zero)
    return out


# coverage -----------------------------------------------------------------------------------------------------------
def coverage_of(path: str, parts: list[Part], nside_sparse: int) -> tuple[int, dict[int, int]]:
    """Coverage resolution, and the block number of each covered pixel."""
    cov = extension(parts, "COV") or parts[0]
    nc = cov.header["NSIDE"]
    bits = px.shift_between(nside_sparse, nc)
    with open_input(path) as f:
        index = np.frombuffer(f.read_at(cov.size, cov.offset), STORED[cov.header["BITPIX"]]).astype(np.int64)
    block = (index + (np.arange(len(index), dtype=np.int64) << bits)) >> bits
    live = np.flatnonzero(block > 0)
    return nc, dict(zip(live.tolist(), block[live].tolist(), strict=True))


def read_coverage(path: str) -> tuple[int, int, list[int]]:
    """(coverage resolution, map resolution, covered pixels); the blocks themselves are not read."""
    parts = parts_of(path)
    sparse = extension(parts, "SPARSE")
    if sparse is None:
        raise RuntimeError(f"{path} holds no map with coverage")
    nc, blocks = coverage_of(path, parts, sparse.header["NSIDE"])
    return nc, sparse.header["NSIDE"], sorted(blocks)


# reading ------------------------------------------------------------------------------------------------------------
_OWN = frozenset("SIMPLE XTENSION BITPIX NAXIS PCOUNT GCOUNT TFIELDS EXTEND EXTNAME PIXTYPE NSIDE SENTINEL PRIMARY WIDEMASK WWIDTH BITPACK RESHAPED BZERO BSCALE THEAP ZIMAGE ZCMPTYPE ZBITPIX ZNAXIS ZQUANTIZ CHECKSUM DATASUM".split())


def metadata_of(part: Part) -> dict[str, Any]:
    """What the map's owner put into the header."""
    numbered = ("NAXIS", "TTYPE", "TFORM", "TZERO", "TSCAL", "ZNAXIS", "ZTILE", "ZNAME", "ZVAL", "TDIM", "TNULL")
    return {k: v for k, v in part.header.items() if k and k not in _OWN and not k.rstrip("0123456789").startswith(numbered) and v is not None}


def map_meta(parts: list[Part], nc: int) -> Meta:
    sparse = extension(parts, "SPARSE")
    h = sparse.header
    sentinel = h.get("SENTINEL", px.UNSEEN)
    if not sparse.is_image:
        names = {name: next(t for t, v in COLUMN.items() if v == (letter, zero)) for name, (letter, _, _, zero) in sparse.columns().items()}
        return describe(nc, h["NSIDE"], names, h["PRIMARY"].strip(), _fit(names[h["PRIMARY"].strip()], sentinel))
    if h.get("WIDEMASK"):
        return describe(nc, h["NSIDE"], "uint8", maxbits=8 * h["WWIDTH"])
    if h.get("BITPACK") or isinstance(sentinel, bool):
        return describe(nc, h["NSIDE"], "bool", packed=bool(h.get("BITPACK")))
    return describe(nc, h["NSIDE"], sparse.image_type(), None, _fit(sparse.image_type(), sentinel))


def _fit(dtype: str, sentinel: Any) -> Any:
    return float(sentinel) if is_float(dtype) else int(sentinel)


def read_map(spark: SparkSession, path: str, pixels: list[int] | None = None) -> tuple[SkyMap, dict]:
    """The map of a file, or of some of its blocks, and its metadata."""
    parts = parts_of(path)
    sparse = extension(parts, "SPARSE")
    nc, blocks = coverage_of(path, parts, sparse.header["NSIDE"])
    if pixels is not None:
        if len(set(pixels)) < len(pixels):
            raise RuntimeError("the pixels to read must be unique")
        blocks = {int(p): blocks[int(p)] for p in sorted(pixels) if int(p) in blocks}
        if not blocks:
            raise RuntimeError("none of the pixels is covered")
    meta = map_meta(parts, nc)
    n = 1 << meta.bits
    names = meta.values
    words = len(names) if meta.kind == "wide" else 0
    per = n * (meta.maxbits // 8) if meta.kind == "wide" else n // 8 if meta.packed else n
    zero = int(sparse.header.get("BZERO", 0)) if sparse.is_image else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Blocks(path, sparse, per)
        for b in batches:
            for cov, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not sparse.is_image:
                    values = reader.records(k)
                    keep = values[meta.primary] != meta.sentinel
                elif meta.kind == "wide":
                    raw = np.zeros((n, 8 * words), np.uint8)
                    raw[:, : meta.maxbits // 8] = reader.image(k).astype(np.uint8).reshape(n, -1)
                    packed = raw.view("<i8")
                    values = {c: packed[:, i] for i, c in enumerate(names)}
                    keep = raw.any(axis=1)
                elif meta.kind == "bool":
                    v = reader.image(k)
                    keep, values = (np.unpackbits(v.astype(np.uint8), bitorder="little") if meta.packed else v) != 0, {}
                else:
                    v = _unzeroed(reader.image(k), zero)
                    keep = v != (np.float32(meta.sentinel) if meta.dtype == "float32" else meta.sentinel)
                    values = {"v": v}
                at = np.flatnonzero(keep)
                cols = [pa.array(at + (cov << meta.bits)), *(pa.array(np.ascontiguousarray(values[c][at])).cast(kinds[c]) for c in names)]
                yield pa.RecordBatch.from_arrays(cols, names=["pix", *names])

    arrow = {"boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
    kinds = {c: pa.int64() if meta.kind == "wide" else arrow[SPARK[meta.dtype[c] if meta.kind == "record" else meta.dtype]] for c in names}
    tasks = max(spark.sparkContext.defaultParallelism, len(blocks) * per // (1 << 22))
    todo = deal(spark, sorted(blocks.items()), "cov_pix bigint, block bigint", tasks)
    df = todo.mapInArrow(run, meta.schema())
    cov = spark.createDataFrame([(c,) for c in blocks], "cov_pix bigint")
    own = metadata_of(sparse)
    return SkyMap(df, Meta(**(vars(meta) | {"metadata": {k: v for k, v in own.items() if k == k.upper()} or None})), cov), own


def table_frame(spark: SparkSession, path: str, part: Part, columns: dict[str, str], rows_each: int = 1 << 20) -> DataFrame:
    """Some columns of a table by Spark type, with `_row`, the number of the element; read by ranges of rows."""
    total = part.header["NAXIS2"]
    ranges = [(a, min(rows_each, total - a)) for a in range(0, total, rows_each)] or [(0, 0)]
    forms = part.columns()
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = open_input(path)
        for b in batches:
            for first, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if count:
                    got = table_columns(f, part, first, count)
                    each = forms[next(iter(columns))][1]
                    row = np.arange(first * each, (first + count) * each)
                    yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(got[c]).cast(arrow[t]) for c, t in columns.items())], names=["_row", *columns])

    return deal(spark, ranges, "first bigint, n bigint", len(ranges)).mapInArrow(run, "_row bigint, " + ", ".join(f"`{c}` {t}" for c, t in columns.items()))


def _spark_type(form: tuple[str, int, int, int]) -> tuple[str, str]:
    name = next(t for t, v in COLUMN.items() if v == (form[0], form[3]))
    return name, SPARK[name]


def read_healpix(spark: SparkSession, path: str, nside_coverage: int) -> SkyMap:
    """A table of full-sky values (IMPLICIT), of pixels and values (EXPLICIT), or a multi-order set (NUNIQ)."""
    part = next(p for p in parts_of(path) if not p.is_image)
    h, forms = part.header, part.columns()
    if str(h.get("ORDERING", "")).strip() == "NUNIQ":
        column = next(iter(forms))
        # our own files tell the resolution of their map; in others MOCORDER may be far finer than any pixel
        own = 1 << int(h["MOCORDER"]) if str(h.get("MOCTOOL", "")).strip() == MOC_TOOL else None
        return from_moc(table_frame(spark, path, part, {column: "bigint"}).select(F.col(column).alias("uniq")), nside_coverage, own)
    nside, ring = h["NSIDE"], str(h.get("ORDERING", "")).strip() == "RING"
    scheme = str(h.get("INDXSCHM", "IMPLICIT")).strip()
    if scheme == "IMPLICIT":
        column = next((c for c in ("T", "TEMPERATURE") if c in forms), None)
        if column is None:
            raise RuntimeError("a full-sky table has a column T or TEMPERATURE")
        df = table_frame(spark, path, part, {column: "double"}).select(F.col("_row").alias("pix"), F.col(column).alias("v"))
        return SkyMap.convert_healpix_map(df, nside_coverage, nside, nest=not ring)
    others = [c for c in forms if c != "PIXEL"]
    if len(others) != 1:
        raise NotImplementedError("a partial table has one column of values")
    dtype, kind = _spark_type(forms[others[0]])
    df = table_frame(spark, path, part, {"PIXEL": "bigint", others[0]: kind}).select(F.col("PIXEL").alias("pix"), F.col(others[0]).alias("v"))
    if ring:
        df = px.with_nest(df.withColumnRenamed("pix", "_ring"), nside, "_ring").select("pix", "v")
    return SkyMap.from_frame(df, nside_coverage, nside, dtype, sentinel=_fit(dtype, h.get("BAD_DATA", px.UNSEEN)))


# writing ------------------------------------------------------------------------------------------------------------
def _own_cards(m: SkyMap) -> list[tuple[str, Any]]:
    return list((m.metadata or {}).items())


def dense_blocks(m: SkyMap, pack: Any) -> DataFrame:
    """(cov_pix, data) of every covered block: `pack` turns the block's dense columns into bytes, in a task of its own."""
    meta, n, bits = m.meta, 1 << m.meta.bits, m.meta.bits
    names = meta.values
    missing = {c: m._missing(c) for c in names}
    rows = m.df.select(F.shiftright("pix", bits).alias("cov_pix"), F.col("pix").bitwiseAND(F.lit(n - 1)).alias("_at"), *names)
    # a row that stands for the block itself, with zeros, so that no column gets nulls and turns into floats
    rows = rows.unionByName(m.cov.select("cov_pix", F.lit(-1).cast("bigint").alias("_at"), *[F.lit(0).cast(k).alias(c) for c, k in m._kinds().items()]))
    floats = {c: is_float(meta.dtype[c] if meta.kind == "record" else meta.dtype) for c in names} if meta.kind in ("scalar", "record") else dict.fromkeys(names, False)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        real = group[group["_at"] >= 0]
        at = real["_at"].to_numpy(np.int64)
        dense = {}
        for c in names:
            dense[c] = np.full(n, missing[c], np.float64 if floats[c] else np.int64)
            dense[c][at] = real[c].to_numpy(np.float64 if floats[c] else np.int64)
        if not names:
            dense["v"] = np.zeros(n, np.uint8)
            dense["v"][at] = 1
        return pd.DataFrame({"cov_pix": [group["cov_pix"].iloc[0]], "data": [pack(dense)]})

    return rows.groupBy("cov_pix").applyInPandas(run, "cov_pix bigint, data binary")


def stored_values(meta: Meta, dense: dict[str, np.ndarray]) -> np.ndarray:
    """A block's values as the image stores them."""
    if meta.kind == "wide":
        words = np.stack([dense[c] for c in meta.values], axis=1).astype("<i8")
        return np.ascontiguousarray(words.view(np.uint8).reshape(len(words), -1)[:, : meta.maxbits // 8]).reshape(-1)
    if meta.kind == "bool":
        return np.packbits(dense["v"], bitorder="little") if meta.packed else dense["v"].astype(">i2")
    return _zeroed(dense["v"], meta.dtype)


def _record_bytes(meta: Meta, dense: dict[str, np.ndarray]) -> bytes:
    n = len(next(iter(dense.values())))
    row = np.zeros(n, [(c, LETTER[COLUMN[t][0]]) for c, t in meta.dtype.items()])
    for c, t in meta.dtype.items():
        row[c] = np.where(dense[c], ord("T"), ord("F")) if t == "bool" else _zeroed(dense[c], t)
    return row.tobytes()


def write_map(m: SkyMap, path: str, clobber: bool = False, nocompress: bool = False, pixtype: str = PIXTYPE) -> None:
    """Write a map; images are compressed tile by tile, a tile to a block, unless told not to; tables of records and 64-bit integers never are."""
    check_target(path, clobber)
    meta, n = m.meta, 1 << m.meta.bits
    if meta.kind == "scalar" and meta.dtype == "float16":
        raise NotImplementedError("FITS has no 16-bit floats")
    squeeze = not nocompress and meta.kind != "record" and not (meta.kind == "scalar" and meta.dtype in ("int64", "uint64"))
    empty = {c: np.full(n, m._missing(c), np.float64 if meta.kind in ("scalar", "record") and is_float(meta.dtype[c] if meta.kind == "record" else meta.dtype) else np.int64) for c in meta.values} or {"v": np.zeros(n, np.uint8)}

    def pack(dense: dict[str, np.ndarray]) -> bytes:
        if meta.kind == "record":
            return _record_bytes(meta, dense)
        values = stored_values(meta, dense)
        return tile_bytes(values) if squeeze else values.tobytes()

    blocks = dense_blocks(m, pack).persist()
    try:
        sizes = blocks.select("cov_pix", F.length("data").alias("n")).orderBy("cov_pix").collect()  # two numbers a block, as many as COV itself holds
        index = -(np.arange(px.n_pixels(meta.nside_coverage), dtype=np.int64) << meta.bits)
        for k, r in enumerate(sizes, 1):
            index[r.cov_pix] += k << meta.bits
        own = _own_cards(m)
        first = pack(empty)
        sentinel = meta.sentinel
        sparse: list[tuple[str, Any]] = [("EXTNAME", "SPARSE"), ("PIXTYPE", pixtype), ("NSIDE", meta.nside_sparse), ("SENTINEL", sentinel)]
        if meta.kind == "record":
            sparse += [("PRIMARY", meta.primary)]
        if meta.kind == "wide":
            sparse += [("WIDEMASK", True), ("WWIDTH", meta.maxbits // 8)]
        if meta.packed:
            sparse += [("BITPACK", True)]
        per = len(stored_values(meta, empty)) if meta.kind != "record" else n
        total = per * (len(sizes) + 1)
        bitpix, zero = (8, 0) if meta.kind == "wide" or meta.packed else (16, 0) if meta.kind == "bool" else IMAGE[meta.dtype] if meta.kind == "scalar" else (8, 0)
        shift = [("BZERO", zero), ("BSCALE", 1)] if zero else []
        with Whole(path) as out:
            out.write(header_bytes([("SIMPLE", True), ("BITPIX", 64), ("NAXIS", 1), ("NAXIS1", len(index)), ("EXTEND", True), ("EXTNAME", "COV"), ("PIXTYPE", pixtype), ("NSIDE", meta.nside_coverage), *own]))
            _padded(out, index.astype(">i8").tobytes())
            if meta.kind == "record":
                width = len(first) // n
                cards: list[tuple[str, Any]] = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", total), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(meta.dtype))]
                for k, (c, t) in enumerate(meta.dtype.items(), 1):
                    cards += [(f"TTYPE{k}", c), (f"TFORM{k}", COLUMN[t][0])] + ([(f"TZERO{k}", COLUMN[t][1]), (f"TSCAL{k}", 1)] if COLUMN[t][1] else [])
            elif squeeze:
                lengths = [len(first), *(r.n for r in sizes)]
                wide = "Q" if sum(lengths) >= 1 << 31 else "P"
                row = 16 if wide == "Q" else 8
                cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", row), ("NAXIS2", len(lengths)), ("PCOUNT", sum(lengths)), ("GCOUNT", 1), ("TFIELDS", 1), ("TTYPE1", "COMPRESSED_DATA"), ("TFORM1", f"1{wide}B({max(lengths)})")]
                cards += [("ZIMAGE", True), ("ZCMPTYPE", "GZIP_2"), ("ZBITPIX", bitpix), ("ZNAXIS", 1), ("ZNAXIS1", total), ("ZTILE1", per), *([("ZQUANTIZ", "NONE")] if bitpix < 0 else []), *shift]
            else:
                cards = [("XTENSION", "IMAGE"), ("BITPIX", bitpix), ("NAXIS", 1), ("NAXIS1", total), ("PCOUNT", 0), ("GCOUNT", 1), *shift]
            out.write(header_bytes([*cards, *sparse, *own]))
            written = 0
            if squeeze:
                ends = np.cumsum(lengths)
                table = np.stack([np.array(lengths), ends - lengths], axis=1).astype(">i8" if wide == "Q" else ">i4").tobytes()
                out.write(table)
                written += len(table)
            out.write(first)
            written += len(first)
            for data in stream_bytes(blocks.orderBy("cov_pix"), "data"):
                out.write(data)
                written += len(data)
            out.write(b"\0" * (-written % UNIT))
    finally:
        blocks.unpersist()


def _padded(out: pa.NativeFile, raw: bytes) -> None:
    out.write(raw + b"\0" * (-len(raw) % UNIT))


def _write_table(path: str, clobber: bool, rows: DataFrame, columns: list[tuple[str, str, str]], cards: list[tuple[str, Any]]) -> None:
    """A table of sorted rows: `columns` are (name in the file, column, type). Partitions are packed in tasks and copied in order."""
    check_target(path, clobber)
    kinds = [(n, LETTER[COLUMN[t][0]], COLUMN[t][1], t) for n, _, t in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = np.zeros(len(b), [(n, k) for n, k, _, _ in kinds])
            for i, (n, _, _, t) in enumerate(kinds):
                v = b.column(i).to_numpy(zero_copy_only=False)
                row[n] = _zeroed(v, t)
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes()], pa.binary())], names=["data"])

    packed = rows.select(*[c for _, c, _ in columns]).orderBy(columns[0][1]).mapInArrow(run, "data binary").persist()
    try:
        width = sum(np.dtype(k).itemsize for _, k, _, _ in kinds)
        size = packed.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
        head: list[tuple[str, Any]] = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", size // width), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns))]
        for k, (n, _, zero, t) in enumerate(kinds, 1):
            head += [(f"TTYPE{k}", n), (f"TFORM{k}", COLUMN[t][0])] + ([(f"TZERO{k}", zero), (f"TSCAL{k}", 1)] if zero else [])
        with Whole(path) as out:
            out.write(header_bytes([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]))
            out.write(header_bytes([*head, *[(k, size // width if v is ... else v) for k, v in cards]]))
            for data in stream_bytes(packed, "data"):
                out.write(data)
            out.write(b"\0" * (-size % UNIT))
    finally:
        packed.unpersist()


def write_healpix(m: SkyMap, path: str, clobber: bool = False) -> None:
    """Pixels and values as an EXPLICIT table."""
    if m.meta.kind in ("record", "wide"):
        raise NotImplementedError("the table has one column of values")
    dtype = "int16" if m.meta.kind == "bool" else m.dtype
    rows = m.df.select("pix", F.lit(1).cast("smallint").alias("v")) if m.meta.kind == "bool" else m.df
    sentinel = 0 if m.meta.kind == "bool" else m.sentinel
    cards = [("PIXTYPE", "HEALPIX"), ("INDXSCHM", "EXPLICIT"), ("ORDERING", "NESTED"), ("NSIDE", m.nside_sparse), ("OBS_NPIX", ...), ("BAD_DATA", sentinel), ("OBJECT", "PARTIAL"), ("COORDSYS", "C"), *_own_cards(m)]
    _write_table(path, clobber, rows, [("PIXEL", "pix", "int64"), ("SIGNAL", "v", dtype)], cards)


def write_moc(m: SkyMap, path: str, clobber: bool = False) -> None:
    """The valid pixels as a multi-order set."""
    cards = [("PIXTYPE", "HEALPIX"), ("ORDERING", "NUNIQ"), ("COORDSYS", "C"), ("MOCORDER", px.order_of(m.nside_sparse)), ("MOCTOOL", MOC_TOOL), ("MOCVERS", "2.0"), ("MOCDIM", "SPACE")]
    _write_table(path, clobber, to_moc(m), [("UNIQ", "uniq", "int64")], cards)
