"""Round trips through every format, partial reads, and files of other programs built by hand."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from starquilt.operators.skymap import SkyMap
from starquilt.sources import concatenate_files, fits, format_of, read_coverage, read_map, write_map

NC, NS = 8, 64
KINDS = {
    "float64": {"dtype": "float64"}, "float32": {"dtype": "float32"}, "int16": {"dtype": "int16", "sentinel": -5}, "int64": {"dtype": "int64"}, "uint16": {"dtype": "uint16"}, "uint64": {"dtype": "uint64"}, "int8": {"dtype": "int8"},
    "bool": {"dtype": "bool"}, "packed": {"dtype": "bool", "bit_packed": True}, "wide": {"dtype": "uint8", "wide_mask_maxbits": 72}, "record": {"dtype": {"a": "float32", "b": "int32", "c": "float64"}, "primary": "a"},
}


def make(spark, kind):
    df = spark.range(500).select((F.col("id") * 37 % 9000).alias("pix"), F.col("id").alias("i"))
    v = {"bool": F.lit(True), "packed": F.lit(True)}.get(kind, F.col("i") % 100 + 1)
    if kind == "uint64":
        v = F.when(F.col("i") == 3, F.lit(-(1 << 62))).otherwise(F.col("i") + 1)
    if kind == "int64":
        v = F.col("i") + (1 << 60) + 1
    if kind == "wide":
        df = df.select("pix", F.shiftleft(F.lit(1).cast("bigint"), 62).alias("w0"), F.col("i").bitwiseAND(F.lit(255)).alias("w1"))
    elif kind == "record":
        df = df.select("pix", (F.col("i") / 8).alias("a"), F.col("i").alias("b"), (F.col("i") / 3).alias("c"))
    else:
        df = df.select("pix", v.alias("v"))
    cov = spark.createDataFrame([(c,) for c in [*range(0, 141), 700]], "cov_pix bigint")
    return SkyMap.from_frame(df, NC, NS, cov=cov, metadata={"OWNER": "me", "LONGERNAME": 3}, **KINDS[kind])


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("form", ["fits", "plain", "parquet", "dense"])
def test_round_trip(spark, tmp_path, kind, form):
    m = make(spark, kind)
    path = str(tmp_path / "m")
    write_map(m, path, "fits" if form == "plain" else form, nocompress=form == "plain")
    back, told = read_map(spark, path, header=True)
    assert back == m and back.metadata == m.metadata and told["OWNER"] == "me"
    some = read_map(spark, path, pixels=[3, 9, 700, 767] if form != "parquet" else [3, 9, 700])
    want = {r.pix for r in m.df.collect() if r.pix >> 6 in (3, 9)}
    assert {r.pix for r in some.df.collect()} == want and sorted(r[0] for r in some.cov.collect()) == [3, 9, 700]
    assert sorted(r[0] for r in read_coverage(spark, path).df.collect()) == [*range(141), 700]
    with pytest.raises(RuntimeError):
        write_map(m, path, "fits")
    if form in ("fits", "dense"):
        with pytest.raises(RuntimeError):
            read_map(spark, path, pixels=[3, 3])
        with pytest.raises(RuntimeError):
            read_map(spark, path, pixels=[600])


def test_half_floats(spark, tmp_path):
    m = SkyMap.from_frame(spark.range(300).select((F.col("id") * 7).alias("pix"), (F.col("id") / 4).alias("v")), NC, NS, "float16")
    path = str(tmp_path / "half")
    write_map(m, path, "dense")
    back = read_map(spark, path)
    assert back.dtype == "float16" and back.df.exceptAll(m.df).count() == 0 and back.n_valid == 300
    assert {r.pix for r in read_map(spark, path, pixels=[4]).df.collect()} == {p for p in range(0, 2100, 7) if p >> 6 == 4}


def test_empty_map(spark, tmp_path):
    m = SkyMap.make_empty(spark, NC, NS, "float32")
    for form in ("fits", "parquet", "dense"):
        path = str(tmp_path / form)
        write_map(m, path, form)
        back = read_map(spark, path)
        assert back == m and back.n_valid == 0


def test_prunes(spark, tmp_path):
    path = str(tmp_path / "m")
    write_map(make(spark, "float64"), path, "parquet")
    plan = read_map(spark, path, pixels=[3]).df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "iopix" in plan and "GreaterThanOrEqual(pix" in plan


def test_degrade_on_read(spark, tmp_path):
    m = make(spark, "float64")
    weights = SkyMap(m.df.select("pix", (F.col("v") / 64 + 1).alias("v")), m.meta, m.cov)
    for form in ("fits", "parquet", "dense"):
        a, b = str(tmp_path / f"{form}-m"), str(tmp_path / f"{form}-w")
        write_map(m, a, form)
        write_map(weights, b, form)
        assert read_map(spark, a, degrade_nside=16, reduction="max") == m.degrade(16, "max")
        got = read_map(spark, a, degrade_nside=16, reduction="wmean", weightfile=b).df.orderBy("pix").collect()
        assert got == m.degrade(16, "wmean", weights).df.orderBy("pix").collect()
        with pytest.raises(ValueError):
            read_map(spark, a, degrade_nside=NS)


def test_healpix_tables(spark, tmp_path):
    m = make(spark, "float64")
    path = str(tmp_path / "explicit.fits")
    write_map(m, path, "healpix")
    assert format_of(path) == "healpix"
    assert read_map(spark, path, nside_coverage=NC).df.exceptAll(m.df).count() == 0
    with pytest.raises(RuntimeError):
        read_map(spark, path)
    with pytest.raises(NotImplementedError):
        write_map(make(spark, "record"), str(tmp_path / "r"), "healpix")
    moc = str(tmp_path / "moc.fits")
    b = make(spark, "bool")
    write_map(b, moc, "moc")
    back = read_map(spark, moc, nside_coverage=NC)
    k = back.nside_sparse // NS
    assert k == 1 and back.df.exceptAll(b.df).count() == 0 and back.n_valid == b.n_valid
    # complete coarse pixels alone: the file tells the resolution that its pixels do not
    whole = SkyMap.make_empty(spark, NC, NS, "bool").update_values_pix([(0, (NS // NC) ** 2)], True)
    write_map(whole, moc, "moc", clobber=True)
    back = read_map(spark, moc, nside_coverage=NC)
    assert back.nside_sparse == NS and back.n_valid == whole.n_valid == (NS // NC) ** 2 and back.df.exceptAll(whole.df).count() == 0
    # another tool's MOCORDER is no reason to write pixels out any finer than its own
    raw = open(moc, "rb").read()
    other = tmp_path / "other.fits"
    other.write_bytes(raw.replace(b"starquilt", b"some tool"))
    assert read_map(spark, str(other), nside_coverage=NC).nside_sparse == NC
    # full sky in rows of 1024 values, in ring order
    for order in ("RING", "NESTED"):
        values = np.full(12 * NS * NS, -1.6375e30, ">f4")
        values[::5] = np.arange(len(values[::5]))
        head = [("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]
        table = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 4096), ("NAXIS2", len(values) // 1024), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 1), ("TTYPE1", "TEMPERATURE"), ("TFORM1", "1024E"), ("PIXTYPE", "HEALPIX"), ("INDXSCHM", "IMPLICIT"), ("ORDERING", order), ("NSIDE", NS)]
        raw = values.tobytes()
        p = tmp_path / f"{order}.fits"
        p.write_bytes(fits.header_bytes(head) + fits.header_bytes(table) + raw + b"\0" * (-len(raw) % 2880))
        got = read_map(spark, str(p), nside_coverage=NC)
        dense = got.generate_healpix_map(nest=order == "NESTED").orderBy("pix").collect()
        assert [r.v for r in dense] == pytest.approx(values.tolist(), rel=1e-6)


def rice_encode(values, width, block=32):
    """A plain encoder, the counterpart of what is tested: first value, then blocks of shifted differences."""
    bits, (fs_bits, fs_max) = 8 * width, {1: (3, 6), 2: (4, 14), 4: (5, 25)}[width]
    full = (1 << bits) - 1
    out = [format(values[0] & full, f"0{bits}b")]
    last = values[0]
    for lo in range(0, len(values), block):
        mapped = []
        for v in values[lo : lo + block]:
            d = (v - last + (1 << (bits - 1))) % (1 << bits) - (1 << (bits - 1))
            mapped.append(2 * d if d >= 0 else -2 * d - 1)
            last = v
        shift = max(0, (sum(mapped) // len(mapped)).bit_length() - 1)
        if not any(mapped):
            out.append(format(0, f"0{fs_bits}b"))
        elif shift >= fs_max:
            out.append(format(fs_max + 1, f"0{fs_bits}b") + "".join(format(m, f"0{bits}b") for m in mapped))
        else:
            out.append(format(shift + 1, f"0{fs_bits}b"))
            out += ["0" * (m >> shift) + "1" + (format(m & ((1 << shift) - 1), f"0{shift}b") if shift else "") for m in mapped]
    text = "".join(out)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


@pytest.mark.parametrize("width", [1, 2, 4])
def test_rice(width):
    r = np.random.default_rng(width)
    top = 1 << (8 * width - 1)
    for values in ([7] * 100, r.integers(0, 5, 70).tolist(), r.integers(0 if width == 1 else -top, top, 200).tolist(), np.cumsum(r.integers(0, 2, 99)).tolist()):
        assert fits.rice_decode(rice_encode(values, width), len(values), width).tolist() == values


def test_gzip_tiles():
    v = (np.arange(50) * 1000).astype(">i4")
    assert fits.tile_values(gzip.compress(v.tobytes()), "GZIP_1", 32, 50, {}).tolist() == v.tolist()
    assert fits.tile_values(fits.tile_bytes(v), "GZIP_2", 32, 50, {}).tolist() == v.tolist()


def test_rice_file(spark, tmp_path):
    """An integer map as other programs write it: Rice tiles, a byte wide descriptor each."""
    n, covered = 64, [2, 5]
    blocks = [[-5] * n, list(range(n)), [k % 3 - 5 for k in range(n)]]
    index = -np.arange(768, dtype=np.int64) * n
    for k, c in enumerate(covered, 1):
        index[c] += k * n
    tiles = [rice_encode(b, 2) for b in blocks]
    ends = np.cumsum([len(t) for t in tiles])
    table = b"".join(struct.pack(">2i", len(t), e - len(t)) for t, e in zip(tiles, ends))
    head = [("SIMPLE", True), ("BITPIX", 64), ("NAXIS", 1), ("NAXIS1", 768), ("EXTEND", True), ("EXTNAME", "COV"), ("NSIDE", 8)]
    body = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 8), ("NAXIS2", 3), ("PCOUNT", int(ends[-1])), ("GCOUNT", 1), ("TFIELDS", 1), ("TTYPE1", "COMPRESSED_DATA"), ("TFORM1", "1PB(99)"), ("ZIMAGE", True), ("ZCMPTYPE", "RICE_1"), ("ZBITPIX", 16), ("ZNAXIS", 1), ("ZNAXIS1", 3 * n), ("ZTILE1", n), ("ZNAME1", "BLOCKSIZE"), ("ZVAL1", 32), ("ZNAME2", "BYTEPIX"), ("ZVAL2", 2), ("EXTNAME", "SPARSE"), ("NSIDE", 64), ("SENTINEL", -5)]
    pad = lambda b: b + b"\0" * (-len(b) % 2880)
    p = tmp_path / "rice.fits"
    p.write_bytes(fits.header_bytes(head) + pad(index.astype(">i8").tobytes()) + fits.header_bytes(body) + pad(table + b"".join(tiles)))
    m = read_map(spark, str(p))
    assert m.dtype == "int16" and m.sentinel == -5
    want = {(c * n + k, v) for c, b in zip(covered, blocks[1:]) for k, v in enumerate(b) if v != -5}
    assert {(r.pix, r.v) for r in m.df.collect()} == want


def test_concatenate_files(spark, tmp_path):
    spans = [(0, 3000), (2500, 6000), (6000, 7000)]
    paths = []
    for k, (a, b) in enumerate(spans):
        nc = (8, 16, 4)[k]
        m = SkyMap.from_frame(spark.range(a, b).select(F.col("id").alias("pix"), F.lit(1 << k).alias("v")), nc, NS, "int32", sentinel=0)
        paths.append(str(tmp_path / f"{k}.fits"))
        write_map(m, paths[-1])
    out = str(tmp_path / "out.fits")
    concatenate_files(spark, paths, out)
    got = read_map(spark, out)
    assert got.nside_coverage == 8 and {r.pix: r.v for r in got.df.collect()} == {p: 1 if p < 2500 else 2 if p < 6000 else 4 for p in range(7000)}
    with pytest.raises(RuntimeError):
        concatenate_files(spark, paths, out)
    with pytest.raises(RuntimeError):
        concatenate_files(spark, paths, out, check_overlap=True, clobber=True)
    concatenate_files(spark, paths, out, or_overlap=True, clobber=True, nside_coverage_out=16)
    got = {r.pix: r.v for r in read_map(spark, out).df.collect()}
    assert got[2700] == 3 and got[10] == 1 and got[5000] == 2


def test_formats(spark, tmp_path):
    with pytest.raises(OSError):
        read_map(spark, str(tmp_path / "none"))
    p = tmp_path / "x"
    p.write_bytes(b"hello" * 1000)
    with pytest.raises(NotImplementedError):
        read_map(spark, str(p))
    with pytest.raises(NotImplementedError):
        write_map(make(spark, "bool"), str(tmp_path / "y"), "csv")
    with pytest.raises(NotImplementedError):
        write_map(make(spark, "bool"), str(tmp_path / "z"), "hdf5")
