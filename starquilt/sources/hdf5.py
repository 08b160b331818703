"""Maps in HDF5 groups, where the `h5py` library is installed.

A group holds `cov_index_map` and `sparse_map`, a row of fine pixels for each covered pixel after one row of sentinels.
Tasks read and pack blocks; the driver writes one block after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..functions import pixelization as px
from ..functions.dtypes import is_float
from ..operators.skymap import SkyMap, describe
from .files import deal, stream_bytes


def _library():  # noqa: ANN202
    try:
        import h5py
    except ImportError as e:
        raise NotImplementedError("HDF5 needs the library h5py, which is not installed") from e
    return h5py


def is_hdf5(path: str) -> bool:
    from .files import open_input

    with open_input(path) as f:
        return f.read_at(8, 0) == b"\x89HDF\r\n\x1a\n"


def write_map(m: SkyMap, path: str, group: str = "map", clobber: bool = False) -> None:
    """Write a map as one group of a local file; other groups of the file stay."""
    h5py = _library()
    from .fits import dense_blocks

    meta, n = m.meta, 1 << m.meta.bits
    wide = meta.maxbits // 8 if meta.kind == "wide" else 0
    names = list(meta.dtype) if meta.kind == "record" else ["v"]
    kinds = {c: np.dtype(meta.dtype[c] if meta.kind == "record" else "uint8" if wide or meta.packed else meta.dtype) for c in names}

    def columns(dense: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if wide:
            return {"v": np.ascontiguousarray(np.stack([dense[c] for c in meta.values], axis=1).astype("<i8").view(np.uint8).reshape(n, -1)[:, :wide])}
        if meta.packed:
            return {"v": np.packbits(dense["v"], bitorder="little")}
        return {c: dense[c].astype(kinds[c]) for c in names}

    blocks = dense_blocks(m, lambda dense: b"".join(columns(dense)[c].tobytes() for c in names)).persist()
    try:
        covered = sorted(r[0] for r in blocks.select("cov_pix").collect())
        index = -(np.arange(px.n_pixels(meta.nside_coverage), dtype=np.int64) << meta.bits)
        for k, c in enumerate(covered, 1):
            index[c] += k << meta.bits
        shape = (n, wide) if wide else (n // 8,) if meta.packed else (n,)
        with h5py.File(path, "a") as f:
            if group in f:
                if not clobber:
                    raise RuntimeError(f"{path} has a group {group}")
                del f[group]
            g = f.create_group(group)
            g.create_dataset("cov_index_map", data=index, compression="gzip")
            sets = {c: (g.create_group(c) if meta.kind == "record" else g).create_dataset("sparse_map", (len(covered) + 1, *shape), kinds[c], compression="gzip", chunks=(1, *shape)) for c in names}
            for c, s in sets.items():
                s[0] = 0 if wide or meta.kind == "bool" else m._missing(c)
            for k, raw in enumerate(stream_bytes(blocks.orderBy("cov_pix"), "data"), 1):
                at = 0
                for c, s in sets.items():
                    size = kinds[c].itemsize * int(np.prod(shape))
                    s[k] = np.frombuffer(raw[at : at + size], kinds[c]).reshape(shape)
                    at += size
            g.attrs.update({"nside_sparse": meta.nside_sparse, "nside_coverage": meta.nside_coverage, "sentinel": meta.sentinel, "primary": meta.primary or "", "nest": True, "is_wide_mask": bool(wide), "is_bit_packed": meta.packed})
            g.attrs.update({f"metadata_{k}": v for k, v in (meta.metadata or {}).items()})
    finally:
        blocks.unpersist()


def read_map(spark: SparkSession, path: str, group: str = "map", pixels: list[int] | None = None) -> tuple[SkyMap, dict]:
    h5py = _library()
    with h5py.File(path, "r") as f:
        g = f[group]
        told = {k: v.item() if hasattr(v, "item") else v for k, v in g.attrs.items()}
        ns, nc, primary = int(told["nside_sparse"]), int(told["nside_coverage"]), str(told.get("primary") or "") or None
        index = g["cov_index_map"][:]
        kinds = {c: str(g[c]["sparse_map"].dtype) for c in g if isinstance(g[c], h5py.Group)} if primary else {"v": str(g["sparse_map"].dtype)}
        wide = g["sparse_map"].shape[2] if not primary and g["sparse_map"].ndim == 3 else 0
        packed = not primary and not wide and g["sparse_map"].shape[1] * 8 == 1 << px.shift_between(ns, nc)
    own = {k.removeprefix("metadata_"): v for k, v in told.items() if k.startswith("metadata_")}
    kind = kinds[primary or "v"]
    sentinel = None if wide or packed or kind == "bool" else float(told["sentinel"]) if is_float(kind) else int(told["sentinel"])
    meta = describe(nc, ns, kinds if primary else "bool" if packed else kind, primary, sentinel, 8 * wide, own or None, packed)
    block = (index + (np.arange(len(index), dtype=np.int64) << meta.bits)) >> meta.bits
    live = {int(c): int(block[c]) for c in np.flatnonzero(block > 0)}
    if pixels is not None:
        live = {int(p): live[int(p)] for p in pixels if int(p) in live}
        if not live:
            raise RuntimeError("none of the pixels is covered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        with h5py.File(path, "r") as f:
            for b in batches:
                for c, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    got = {x: (f[group][x] if primary else f[group])["sparse_map"][k] for x in kinds}
                    if wide:
                        raw = np.zeros((len(got["v"]), 8 * len(meta.values)), np.uint8)
                        raw[:, :wide] = got["v"]
                        keep, values = raw.any(axis=1), {w: raw.view("<i8")[:, i] for i, w in enumerate(meta.values)}
                    elif meta.kind == "bool":
                        keep, values = (np.unpackbits(got["v"], bitorder="little") if packed else got["v"]) != 0, {}
                    else:
                        keep, values = got[primary or "v"] != meta.sentinel, got
                    at = np.flatnonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(at + (c << meta.bits)), *(pa.array(np.ascontiguousarray(v[at])) for v in values.values())], names=["pix", *values])

    df = deal(spark, sorted(live.items()), "cov_pix bigint, block bigint", spark.sparkContext.defaultParallelism).mapInArrow(run, meta.schema())
    return SkyMap(df, meta, spark.createDataFrame([(c,) for c in live], "cov_pix bigint")), own
