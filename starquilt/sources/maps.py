"""Reading and writing maps of any format, and joining files into one."""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import pixelization as px
from ..operators.algebra import concatenate
from ..operators.skymap import SkyCoverage, SkyMap
from . import fits, hdf5, parquet
from .files import check_target, exists, is_folder


def format_of(path: str) -> str:
    """fits, healpix, parquet, dense or hdf5, from what lies at the path."""
    if not exists(path):
        raise OSError(f"{path} does not exist")
    if is_folder(path):
        if parquet.is_native(path):
            return "parquet"
        if parquet.is_dense(path):
            return "dense"
    elif fits.is_fits(path):
        return "fits" if fits.extension(fits.parts_of(path), "SPARSE") else "healpix"
    elif hdf5.is_hdf5(path):
        return "hdf5"
    raise NotImplementedError(f"{path} is of no known format")


def read_map(
    spark: SparkSession, path: str | os.PathLike, nside_coverage: int | None = None, pixels: Sequence[int] | None = None, header: bool = False, degrade_nside: int | None = None, weightfile: str | None = None, reduction: str = "mean", use_threads: bool = False, hdf5_group: str = "map"
) -> SkyMap | tuple[SkyMap, dict]:
    """A map from a file or folder; `pixels` are the covered pixels to read, `degrade_nside` degrades while reading.

    `use_threads` is taken for the sake of callers that pass it: reading is parallel in any case.
    """
    path = os.fspath(path)
    chosen = None if pixels is None else [int(p) for p in pixels]
    kind = format_of(path)
    told: dict[str, Any] = {}
    if kind == "fits":
        m, told = fits.read_map(spark, path, chosen)
    elif kind == "healpix":
        if nside_coverage is None:
            raise RuntimeError("a table without coverage needs nside_coverage")
        m = fits.read_healpix(spark, path, nside_coverage)
        if chosen is not None:
            m = SkyMap(m.df.filter(F.shiftright("pix", m.meta.bits).isin(chosen)), m.meta, m.cov.filter(F.col("cov_pix").isin(chosen)))
    elif kind == "parquet":
        m = parquet.read_rows(spark, path, chosen)
        told = m.metadata or {}
    elif kind == "dense":
        m, told = parquet.read_dense(spark, path, chosen)
    else:
        m, told = hdf5.read_map(spark, path, hdf5_group, chosen)
    if degrade_nside is not None:
        if degrade_nside >= m.nside_sparse:
            raise ValueError("a map is degraded to a coarser resolution than its own")
        weights = read_map(spark, weightfile, pixels=pixels) if weightfile else None
        m = m.degrade(degrade_nside, reduction, weights)
    return (m, told) if header else m


def write_map(m: SkyMap, path: str | os.PathLike, format: str = "fits", clobber: bool = False, nocompress: bool = False, nside_io: int = 4, hdf5_group: str = "map", **how: str) -> None:  # noqa: A002
    path = os.fspath(path)
    if format == "fits":
        fits.write_map(m, path, clobber, nocompress, **how)
    elif format == "parquet":
        parquet.write_rows(m, path, clobber, nside_io)
    elif format == "dense":
        parquet.write_dense(m, path, clobber, nside_io, **how)
    elif format == "healpix":
        fits.write_healpix(m, path, clobber)
    elif format == "moc":
        fits.write_moc(m, path, clobber)
    elif format == "hdf5":
        hdf5.write_map(m, path, hdf5_group, clobber)
    else:
        raise NotImplementedError(f"no such format: {format}")


def read_coverage(spark: SparkSession, path: str | os.PathLike) -> SkyCoverage:
    """Just the coverage of a file."""
    path = os.fspath(path)
    kind = format_of(path)
    if kind == "fits":
        nc, ns, pixels = fits.read_coverage(path)
        return SkyCoverage.make_from_pixels(spark, nc, ns, pixels)
    if kind in ("parquet", "dense"):
        return SkyCoverage(*parquet.read_coverage(spark, path))
    raise NotImplementedError(f"{kind} files do not tell their coverage apart from their rows")


def concatenate_files(spark: SparkSession, paths: Sequence[str], out: str, check_overlap: bool = False, clobber: bool = False, nside_coverage_out: int | None = None, or_overlap: bool = False, format: str = "fits") -> None:  # noqa: A002
    """Join maps of one resolution into one file: later files win, or overlap raises, or integers are OR-ed."""
    if exists(out) and not clobber:
        raise RuntimeError(f"{out} exists")
    maps = [read_map(spark, p) for p in paths]
    if len({m.nside_sparse for m in maps}) > 1:
        raise RuntimeError("files to be joined have one resolution")
    joined = concatenate(maps, nside_coverage_out, check_overlap and not or_overlap, or_overlap)
    nc = joined.nside_coverage
    covers = []
    for m in maps:
        k = px.shift_between(max(m.nside_coverage, nc), min(m.nside_coverage, nc))
        c = F.col("cov_pix")
        if m.nside_coverage >= nc:
            covers.append(m.cov.select(F.shiftright(c, k).alias("cov_pix")))
        else:  # finer blocks of which only those that hold a pixel are covered
            covers.append(m.df.select(F.shiftright("pix", joined.meta.bits).alias("cov_pix")))
    cov = covers[0]
    for c in covers[1:]:
        cov = cov.union(c)
    check_target(out, clobber)
    write_map(SkyMap(joined.df, joined.meta, cov.distinct()), out, format, clobber)
