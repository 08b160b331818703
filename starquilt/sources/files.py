"""Opening files by path or address, on the driver and in tasks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def at(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def exists(path: str) -> bool:
    system, p = at(path)
    return system.get_file_info(p).type != fs.FileType.NotFound


def is_folder(path: str) -> bool:
    system, p = at(path)
    return system.get_file_info(p).type == fs.FileType.Directory


def remove(path: str) -> None:
    system, p = at(path)
    kind = system.get_file_info(p).type
    if kind == fs.FileType.Directory:
        system.delete_dir(p)
    elif kind != fs.FileType.NotFound:
        system.delete_file(p)


def check_target(path: str, clobber: bool) -> None:
    """Raise if something is there and may not be overwritten."""
    if exists(path):
        if not clobber:
            raise RuntimeError(f"{path} exists")
        remove(path)


def open_input(path: str) -> pa.NativeFile:
    system, p = at(path)
    return system.open_input_file(p)


class Whole:
    """A file written under a name of its own and renamed when whole."""

    def __init__(self, path: str, attempt: str = "incomplete"):
        self.system, self.path = at(path)
        self.temporary = f"{self.path}.{attempt}"

    def __enter__(self) -> pa.NativeFile:
        folder = self.path.rpartition("/")[0]
        if folder:
            self.system.create_dir(folder, recursive=True)
        self.out = self.system.open_output_stream(self.temporary)
        return self.out

    def __exit__(self, kind: object, *_: object) -> None:
        self.out.close()
        if kind is None:
            self.system.move(self.temporary, self.path)
        else:
            self.system.delete_file(self.temporary)


def write_json(path: str, value: object) -> None:
    with Whole(path) as out:
        out.write(json.dumps(value).encode())


def read_json(path: str) -> dict:
    with open_input(path) as f:
        return json.loads(f.read())


def stream_bytes(rows: DataFrame, column: str) -> Iterable[bytes]:
    """A binary column to the driver, one partition at a time; the next one is fetched meanwhile."""
    return (bytes(r[0]) for r in rows.select(column).toLocalIterator(prefetchPartitions=True))


def deal(spark: SparkSession, rows: list[tuple], schema: str, tasks: int) -> DataFrame:
    """A driver-side list of file ranges as a relation of about `tasks` partitions."""
    n = max(1, min(tasks, len(rows)))
    return spark.createDataFrame(rows, schema).repartition(n)
