"""Token ids in shard files with a minimal perfect hash index.

A shard holds a range of documents in ascending key order: first the raw ids of all of them, little-endian unsigned
integers of 16 bits if the vocabulary allows it and of 32 if not, then tables, then a footer that says where each table lies. The tables: where each document begins,
its key, and the index. The index is a minimal perfect hash over the shard's distinct keys, built in levels of bit
arrays: on each level a key owns its bit if no other remaining key hashes to it, and moves on if not; the rank of the
bit is the key's slot. A slot stores the row of the key's first document and a 32-bit fingerprint of the key, so that a
key that is not there is turned away (and the stored key confirms). Lookups read a constant number of places.

Documents are dealt to shards by a range partitioning of (key, hash of text), so one key with very many rows spreads
over shards. A shard is written to a name of its own attempt and renamed when whole, so lost executors and repeated
attempts leave one whole file. What the driver sees of a shard is one line of counts.

Defined cases: a null text counts as empty and has the end id alone; documents with a null key come first and are read
by row, as they have no key to look up; equal keys are neighbours, in the order of their texts' hashes, and a lookup
gives the first and how many there are; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WHITE
from .shared import map_pieces, new_path, parts_for

END_ID = 2
MAGIC = b"SQTS"
_WS = "".join(map(re.escape, map(chr, WHITE)))
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Pieces that are encoded independently of each other. The splitting pattern of byte-level BPE always breaks before a
#: run of white space and never looks back, so such a run and the characters after it may stand alone; so may a run of
#: letters from a first place, with the one space before it, if an ASCII character that is none follows.
_PIECE = re.compile(f" ?[{_LETTERS}]++(?![^\x00-\x7f])|[{_WS}]*[^{_WS}]+|[{_WS}]+")
_WORD = re.compile(f" ?[{_LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the library's vocabulary: itself where it prints, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class LibraryCoder:
    """The tokenizers library behind a cache of chunks. Texts that hold an added token of the vocabulary, such as `<|endoftext|>`, go through the library whole."""

    def __init__(self, file: str, cache_size: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added)))).search if added else lambda t: None
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_size = cache_size

    def _ids(self, piece: str) -> list[int]:
        """One word goes straight to the library's merge model, as its splitter would hand it over; other pieces go through the whole tokenizer."""
        if _WORD.fullmatch(piece):
            return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without an end id."""
        if len(self.young) > self.cache_size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        whole = {k: self.tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts) if t and self.special(t)}
        split = [_PIECE.findall(t) if t and k not in whole else [] for k, t in enumerate(texts)]
        long = []
        for c in set().union(*split).difference(young):
            got = old.get(c)
            if got is None:
                ids = self._ids(c)
                got = struct.pack(f"<{len(ids)}I", *ids)
            young[c] = got
            if len(c) > 64:
                long.append(c)
        out = [b"".join(map(young.__getitem__, s)) for s in split]
        for c in long:
            del young[c]
        for k, ids in whole.items():
            out[k] = struct.pack(f"<{len(ids)}I", *ids)
        return out


@functools.cache
def library_coder(file: str) -> LibraryCoder:
    """One for each worker process."""
    return LibraryCoder(file)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key (the splitmix64 finaliser)."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: `words` are the levels' bits laid end to end, `ranks` the bits set before each word."""

    FINGERPRINT = 1 << 20

    def __init__(self, levels: list[int], words: np.ndarray, ranks: np.ndarray):
        self.levels, self.words, self.ranks = levels, words, ranks
        self.first = np.r_[0, np.cumsum(levels)].tolist()

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, parts, left = [], [], keys
        while len(left):
            size = -(-max(64, 2 * len(left)) // 64)
            at = (mixed(left, len(levels)) % np.uint64(size * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=size * 64) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            levels.append(size)
            left = left[~alone[at]]
        words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        ranks = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)][:-1] if len(words) else np.zeros(0, np.int64)
        return cls(levels, words, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.levels):
            if not len(todo):
                break
            at = mixed(keys[todo], level) % np.uint64(size * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + self.first[level], at & np.uint64(63)
            w = self.words[word]
            hit = (w >> bit) & np.uint64(1) == 1
            below = w & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            todo = todo[~hit]
        return out


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes documents in ascending key order."""

    def __init__(self, path: str, attempt: int, width: int = 4):
        self.path, self.width = path, width
        self.fs, at = _filesystem(path)
        self.final, self.temporary = at, f"{at}.{attempt}"
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.written, self.sizes, self.keys, self.nulls = 0, [], [], []

    def add(self, keys: list[int | None], ids: list[bytes]) -> None:
        data = b"".join(ids)
        if self.width == 2:
            data = np.frombuffer(data, "<u4").astype("<u2").tobytes()
        self.out.write(data)
        self.written += len(data)
        self.sizes.append(np.array([len(x) // 4 for x in ids], np.int64))
        self.keys.append(np.array([k or 0 for k in keys], np.int64))
        self.nulls.append(np.array([k is None for k in keys], np.uint8))

    def close(self) -> tuple[str, int, int]:
        """Path, documents and ids of the finished shard."""
        keys, nulls = np.concatenate(self.keys), np.concatenate(self.nulls)
        begins = np.r_[0, np.cumsum(np.concatenate(self.sizes))].astype("<i8")
        live = np.flatnonzero(nulls == 0)
        first = live[np.r_[True, keys[live][1:] != keys[live][:-1]]] if len(live) else live
        hashed = PerfectHash.build(keys[first])
        slot = hashed.slots(keys[first])
        row, mark = np.zeros(len(first), "<i8"), np.zeros(len(first), "<u4")
        row[slot] = first
        mark[slot] = mixed(keys[first], PerfectHash.FINGERPRINT).astype(np.uint32)
        tables = {"begins": begins, "keys": keys.astype("<i8"), "nulls": nulls, "words": hashed.words.astype("<u8"), "ranks": hashed.ranks.astype("<i8"), "rows": row, "marks": mark}
        foot: dict = {"levels": hashed.levels, "width": self.width, "tables": {}}
        for name, t in tables.items():
            foot["tables"][name] = (self.written, t.dtype.str, len(t))
            self.out.write(t.tobytes())
            self.written += t.nbytes
        end = json.dumps(foot).encode()
        self.out.write(end + struct.pack("<I", len(end)) + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return self.path, len(keys), int(begins[-1])


class Shard:
    """Reads a shard: by row, or by key through the index."""

    def __init__(self, path: str):
        fs, at = _filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        n, magic = struct.unpack("<I4s", self.file.read_at(8, size - 8))
        if magic != MAGIC:
            raise ValueError(f"{path} is no whole shard")
        foot = json.loads(self.file.read_at(n, size - 8 - n))
        self.tables = {k: np.frombuffer(self.file.read_at(np.dtype(d).itemsize * m, o), d) if m else np.zeros(0, d) for k, (o, d, m) in foot["tables"].items()}
        self.width = foot["width"]
        self.hash = PerfectHash(foot["levels"], self.tables["words"], self.tables["ranks"])
        self.begins, self.keys, self.nulls = self.tables["begins"], self.tables["keys"], self.tables["nulls"]

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of the first document of each key, -1 where the shard does not hold it."""
        slot = self.hash.slots(keys)
        out = np.full(len(keys), -1, np.int64)
        some = np.flatnonzero(slot >= 0)
        some = some[self.tables["marks"][slot[some]] == mixed(keys[some], PerfectHash.FINGERPRINT).astype(np.uint32)]
        row = self.tables["rows"][slot[some]]
        right = (self.keys[row] == keys[some]) & (self.nulls[row] == 0)
        out[some[right]] = row[right]
        return out

    def ids(self, row: int) -> bytes:
        """Ids of a row as little-endian unsigned 32-bit integers."""
        return self.ids_of(np.array([row]))[0]

    def ids_of(self, rows: np.ndarray, most: int = 8 << 20) -> list[bytes]:
        """Ids of each of the rows: rows that follow one another are read at once, in pieces of about `most` bytes."""
        begins, out, at = self.begins, [], 0
        while at < len(rows):
            # as many rows on as stand one after another and lie within `most` bytes
            n = int(np.searchsorted(begins, begins[rows[at]] + most // self.width, "right")) - 1 - int(rows[at])
            n = max(1, min(n, len(rows) - at))
            broken = np.flatnonzero(rows[at : at + n] != rows[at] + np.arange(n))
            n = int(broken[0]) if len(broken) else n
            lo = int(begins[rows[at]])
            raw = self.file.read_at((int(begins[rows[at] + n]) - lo) * self.width, lo * self.width)
            data = raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
            cut = ((begins[rows[at] : rows[at] + n + 1] - lo) * 4).tolist()
            out += [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            at += n
        return out


def write_store(df: DataFrame, tokenizer_file: str, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20, end_id: int = END_ID) -> list[tuple[int, str, int, int]]:
    """Write all documents; a line for each shard in key order: number, path, documents, ids."""
    end = struct.pack("<I", end_id)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    n = parts_for(rows, shard_bytes)
    rows = rows.withColumn("_h", F.xxhash64("_text")).repartitionByRange(n, "_id", "_h").sortWithinPartitions("_id", "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        coder, writer = library_coder(tokenizer_file), None
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for b in batches:
            if len(b):
                writer = writer or ShardWriter(f"{folder}/shard-{at.partitionId():07d}", at.taskAttemptId(), width)
                writer.add(b.column(0).to_pylist(), [x + end for x in coder.encode(b.column(1).to_pylist())])
        if writer:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "path", "docs", "ids"), (at.partitionId(), *writer.close()), strict=True))])

    return sorted(tuple(r) for r in map_pieces(rows, run, "part long, path string, docs long, ids long").collect())


def read_store(like: DataFrame, shards: list[tuple[int, str, int, int]], id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document, read back through the index: id, start (ids of all documents before it), n_tokens, ids_crc32, and `ids` if asked for."""
    spark = like.sparkSession
    kind = like.schema[id_col].dataType.simpleString()
    lines, start = [], 0
    for part, path, _, ids in shards:
        lines.append((part, path, start))
        start += ids
    todo = spark.createDataFrame(lines, "part long, path string, base long").repartitionByRange(max(1, len(lines)), "part")
    arrow = pa.int32() if kind == "int" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                shard = Shard(path)
                for lo in range(0, len(shard), 1024):
                    hi = min(len(shard), lo + 1024)
                    keys, nulls = shard.keys[lo:hi], shard.nulls[lo:hi] == 1
                    row = np.arange(lo, hi)
                    found = shard.find(keys[~nulls])
                    # rows of one key follow its first one
                    row[~nulls] = found + (row[~nulls] - np.searchsorted(shard.keys[shard.nulls.sum() :], keys[~nulls]) - int(shard.nulls.sum()))
                    data = shard.ids_of(row)
                    cols = [
                        pa.array(keys, arrow, mask=nulls), pa.array(shard.begins[row] + base), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array([zlib.crc32(x) for x in data], pa.int64()),
                        *([pa.array(data, pa.binary())] if with_ids else []),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return todo.mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def store_and_read(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    shards = write_store(df, tokenizer_file, new_path(df.sparkSession, "tokens"), id_col, text_col, **how)
    return read_store(df, shards, id_col)
