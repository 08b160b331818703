"""URL filter over a sorted digest array.

Rules `(host, path) -> allow or block` lie in two files: the sorted 64-bit xxhash keys with the offsets of their
records, and the records themselves (full rule string and verdict). The files are written once to the shared folder
and handed to every executor through Spark's file distribution, where workers memory-map them: rules take disk there,
not memory, however many they are. A url's candidates are the suffixes of its host that have as many labels as some
rule's host, joined with the prefixes of its path that have the length of some rule's path; their digests are looked
up by one vectorised binary search for each batch, and a hit counts only if the stored string is the candidate's, so
that colliding digests do no harm. The longest rule that fits wins.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no rule; where no rule fits, the
verdict is allow (a blocklist lets pass what it does not hold); repeated urls are judged each; an empty table gives an
empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path

#: (host, path, verdict): a path is compared from its first character on.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest64(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: the host runs from the first `://` to `/`, `?`, `#` or the end, the path from there to `?`, `#` or the end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class DigestIndex:
    """The two memory-mapped files: `keys` holds n sorted digests, n offsets and the tables of path lengths and of label counts; `records` the strings."""

    def __init__(self, keys_file: str, records_file: str, hash_of: Callable[[bytes], int] = digest64):
        head = np.memmap(keys_file, "<u8", "r")
        n, k, m = head[:3].astype(np.int64).tolist()
        self.path_lengths, self.label_counts = head[3 : 3 + k].astype(np.int64).tolist(), head[3 + k : 3 + k + m].astype(np.int64).tolist()
        self.keys, self.offsets = head[3 + k + m :][:n], head[3 + k + m :][n : 2 * n]
        self.records = np.memmap(records_file, np.uint8, "r")
        self.hash_of = hash_of

    @staticmethod
    def pack(rules: Iterable[tuple[str, str, str]], hash_of: Callable[[bytes], int] = digest64) -> tuple[bytes, bytes]:
        """The bytes of both files. Of rules given twice the later one counts."""
        last = {(h.translate(_LOWER), p): v for h, p, v in rules}
        rows = sorted((hash_of(f"{h}\0{p}".encode()), h, p, v) for (h, p), v in last.items())
        lengths, labels = sorted({len(p) for _, _, p, _ in rows}), sorted({h.count(".") + 1 for _, h, _, _ in rows})
        body, offsets = bytearray(), []
        for _, h, p, v in rows:
            offsets.append(len(body))
            text = f"{h}\0{p}".encode()
            body += struct.pack("<I?", len(text), v == "block") + text
        head = np.array([len(rows), len(lengths), len(labels), *lengths, *labels, *(r[0] for r in rows), *offsets], "<u8")
        return head.tobytes(), bytes(body) or b"\0"

    def find(self, candidates: list[bytes]) -> list[bool | None]:
        """For each candidate: whether its rule blocks, or None without a rule."""
        out: list[bool | None] = [None] * len(candidates)
        if not candidates or not len(self.keys):
            return out
        wanted = np.fromiter(map(self.hash_of, candidates), np.uint64, len(candidates))
        lo = np.searchsorted(self.keys, wanted, "left")
        for i in np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == wanted).tolist():
            at = int(lo[i])
            while at < len(self.keys) and self.keys[at] == wanted[i]:
                o = int(self.offsets[at])
                size, blocks = struct.unpack_from("<I?", self.records, o)
                if self.records[o + 5 : o + 5 + size].tobytes() == candidates[i]:
                    out[i] = blocks
                    break
                at += 1
        return out

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule, verdict) of each url."""
        parts = [split_url(u) for u in urls]
        candidates, owner = [], []
        for i, (host, path) in enumerate(parts):
            if not host:
                continue
            at, have = len(host) + 1, 0  # where the last `have` labels begin, and how many they are
            for want in self.label_counts:
                while have < want and at > 0:
                    at, have = host.rfind(".", 0, at - 1) + 1, have + 1
                if have < want:
                    break
                name = host[at:]
                for n in self.path_lengths:
                    if n <= len(path):
                        candidates.append((name, path[:n]))
                        owner.append(i)
        best: dict[int, tuple[int, str, bool]] = {}
        for (name, start), i, blocks in zip(candidates, owner, self.find([f"{h}\0{p}".encode("utf-8", "surrogatepass") for h, p in candidates]), strict=True):
            if blocks is not None and (i not in best or len(name) + len(start) > best[i][0]):
                best[i] = (len(name) + len(start), name + start, blocks)
        return [(h, p, best[i][1] if i in best else None, "block" if i in best and best[i][2] else "allow") for i, (h, p) in enumerate(parts)]


def publish(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> tuple[str, str]:
    """Write the index to the shared folder and have Spark copy it to the executors; the names under which they find it."""
    names = []
    for kind, data in zip(("keys", "records"), DigestIndex.pack(rules), strict=True):
        path = new_path(spark, f"url-{kind}")
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
        stream.write(bytearray(data))
        stream.close()
        spark.sparkContext.addFile(path)
        names.append(path.rpartition("/")[2])
    return names[0], names[1]


_OPEN: dict[str, DigestIndex] = {}


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule (`hostpath` of the longest that fits, or null), verdict."""
    keys, records = publish(df.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if keys not in _OPEN:
            _OPEN[keys] = DigestIndex(SparkFiles.get(keys), SparkFiles.get(records))
        index = _OPEN[keys]
        for b in batches:
            got = index.judge(b.column(1).to_pylist())
            cols = [pa.array([g[k] for g in got], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, "host", "path", "rule", "verdict"])

    rows = df.select(F.col(id_col), F.col(url_col))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), v AS (
  SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM u
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM v
), r(h, p, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fit AS (
  SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM p JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit ON p.page_id = fit.page_id
"""
