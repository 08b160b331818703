"""Near-duplicates by SimHash and a self-join of binary tries.

Fingerprint: the text with A-Z lower-cased is cut into words at space and 0x09-0x0D; XXH64 (seed 42) of each run of
three words votes on 64 bits, and a bit is set if over half of the hashes set it. Fingerprints that differ in at most
three bits are linked; a class is a connected component, named by its smallest id.

Search: the self-join of a binary trie, walked from pairs of nodes. So that many tasks share it, four tries are kept,
each beginning with another 16-bit block: two linked fingerprints share some block, so the pairs of different nodes at
depth 16 need not be walked, and a task takes whole nodes at that depth with themselves. A node of over `bucket`
fingerprints is split the same way by four 12-bit blocks of the other 48 bits, one of over 16 `bucket` once more by
9-bit blocks, and one of over 64 `bucket` by 6-bit blocks: below that 21 bits remain, so that no task ever holds more
than 2^21 fingerprints of a node together, whatever the input. Below, pairs of nodes are walked down together, the
differing bits so far are carried along, and a pair over the budget is pruned. Pairs of nodes that already lie wholly in one class are pruned too, since they can add no link between
classes; to make that happen early, neighbours in the sorted order are linked first. A bucket returns a spanning forest,
never all pairs. Components come from rounds of contraction: each vertex hangs itself under its smallest neighbour,
trees are flattened by pointer jumping, and edges are rewritten between roots until none is left.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and are linked like any others;
under three words, all words make the one shingle; a null id is never the smallest unless all are null; repeated rows
are in one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import columns_of, frozen, join_groups, map_pieces, row_hash, unused

WORDS, SEED, BUDGET = 3, 42, 3


def shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    if len(words) > WORDS:
        return [h(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:], strict=False)]
    return [h(b" ".join(words), SEED)] if words else []


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k, t in enumerate(texts):
        hashes = np.array(shingle_hashes(t), "<u8")
        n = len(hashes)
        if not n:
            continue
        ones = np.zeros(64, np.int64)
        for lo in range(0, n, 4096):  # sums of bytes stay within 16 bits
            bits = np.unpackbits(hashes[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint16)
        out[k] = weights[2 * ones > n].sum(dtype=np.uint64)
    return out


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Add the fingerprint as a signed long of the same bits."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(at).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, name])

    return map_pieces(df, run, StructType([*df.schema.fields, StructField(name, LongType())]))


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Merge the classes of a and b in `label`, where every class is named by its least member; whether there was anything to merge."""
    merged = False
    while len(a):
        x, y = label[a], label[b]
        go = x != y
        if not go.any():
            break
        merged = True
        a, b, x, y = a[go], b[go], x[go], y[go]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
    return merged


class _Ones:
    """Counts of set bits before a place, for each depth of the trie: a bit vector with running counts, an eighth and a sixteenth of a byte for each print."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.kept = prints, {}

    def before(self, depth: int, at: np.ndarray) -> np.ndarray:
        if depth not in self.kept:
            bits = np.packbits((self.prints >> np.uint64(63 - depth)).astype(np.uint8) & 1, bitorder="little")
            words = np.zeros(len(bits) // 8 + 2, "<u8")
            words.view(np.uint8)[: len(bits)] = bits
            self.kept[depth] = words, np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int32)[:-1]].astype(np.int32)
        words, counts = self.kept[depth]
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[word] + np.bitwise_count(words[word] & below)


def trie_forest(prints: np.ndarray, starts: np.ndarray, budget: int = BUDGET, room: int = 1 << 15) -> np.ndarray:
    """Class labels (least index) under links within buckets.

    `prints` are sorted and distinct in each bucket; bucket k is prints[starts[k]:starts[k + 1]]. At most `room` pairs
    of nodes are walked at a time, the deeper ones first, so that under 3 `room` pairs of 17 bytes wait at each depth.
    """
    n = len(prints)
    label = np.arange(n)
    if n < 2:
        return label
    bucket = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    for turn in range(0, 64, 8):  # true links among neighbours in eight sorted orders
        turned = prints if not turn else (prints << np.uint64(turn)) | (prints >> np.uint64(64 - turn))
        order = np.lexsort((turned, bucket))
        for gap in (1, 2, 3):
            if n > gap:
                i, j = order[:-gap], order[gap:]
                near = (bucket[i] == bucket[j]) & (np.bitwise_count(prints[i] ^ prints[j]) <= budget)
                _unite(label, i[near], j[near])
    del bucket, turned, order
    ones = _Ones(prints)

    def split(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        return hi - (ones.before(depth, hi) - ones.before(depth, lo))

    lo, hi = starts[:-1].astype(np.int32), starts[1:].astype(np.int32)
    some = hi - lo > 1
    stack = [(0, lo[some], hi[some], lo[some], hi[some], np.zeros(int(some.sum()), np.int8))]
    changes, merged = np.zeros(0, np.int32), True
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > room:
            for k in range((len(alo) - 1) // room * room, -1, -room):
                stack.append((depth, *(x[k : k + room].copy() for x in (alo, ahi, blo, bhi, err))))
            continue
        if merged:
            changes, merged = np.r_[0, np.cumsum(label[1:] != label[:-1], dtype=np.int32)], False
        even = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (label[alo] == label[blo])
        if even.any():
            alo, ahi, blo, bhi, err = (x[~even] for x in (alo, ahi, blo, bhi, err))
        small = (ahi - alo == 1) & (bhi - blo == 1)
        if small.any():
            a, b = alo[small], blo[small]
            near = np.bitwise_count(prints[a] ^ prints[b]) <= budget
            merged = _unite(label, a[near], b[near])
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo) or depth == 64:
            continue  # at 64, equal prints: distinct ones never get here
        amid, bmid = split(alo, ahi, depth), split(blo, bhi, depth)
        own = alo == blo
        more = err + np.int8(1)
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, more)]
        parts.append(tuple(x[~own] for x in (amid, ahi, blo, bmid, more)))
        a, b, c, d, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (b > a) & (d > c) & (e <= budget) & ~((a == c) & (b - a == 1))
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in (a, b, c, d, e))))
    return label


def _links(batches: Iterator[pa.RecordBatch], limit: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the buckets of a partition sorted by (key, print); whole buckets are taken together, about `limit` rows at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def forest(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        prints = fps.view(np.uint64)
        order = np.lexsort((prints, keys))
        keys, prints = keys[order], prints[order]
        starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        label = trie_forest(prints, starts)
        at = np.flatnonzero(label != np.arange(len(label)))
        signed = prints.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[at]), pa.array(signed[label[at]])], names=["a", "b"])

    for b in batches:
        if not len(b):
            continue
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        rows += len(b)
        if rows >= limit and held[0][0][0] != held[-1][0][-1]:
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(keys, keys[-1]))
            yield forest(keys[:cut], fps[:cut])
            held, rows = [(keys[cut:].copy(), fps[cut:].copy())], len(keys) - cut
    if held:
        yield forest(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _deal(rows: DataFrame, width: int, left: int, level: int) -> DataFrame:
    """Replace (key, rest) by four rows, one for each block of `width` bits of the `left` bits of rest."""

    def block(k: int) -> F.Column:
        rest = F.col("rest")
        value = F.shiftrightunsigned(rest, k * width).bitwiseAND(F.lit((1 << width) - 1))
        low = rest.bitwiseAND(F.lit((1 << (k * width)) - 1))
        above = (k + 1) * width
        high = F.lit(0).cast("long") if above >= left else F.shiftrightunsigned(rest, above).bitwiseAND(F.lit((1 << (left - above)) - 1))
        key = F.shiftleft(F.shiftleft(F.col("key"), 2).bitwiseOR(F.lit(k)), width).bitwiseOR(value)
        return F.struct(key.alias("key"), F.shiftleft(high, k * width).bitwiseOR(low).alias("rest"))

    out = rows.select("fp", F.explode(F.array(*[block(k) for k in range(4)])).alias("_b")).select("fp", "_b.key", "_b.rest")
    return out.withColumn("level", F.lit(level))


def links(prints: DataFrame, bucket: int = 4096) -> DataFrame:
    """(a, b) of distinct fingerprints `fp`: enough true links to join all that are linked, at most one each for a fingerprint and bucket."""
    now = _deal(prints.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), 16, 64, 1)
    done: list[DataFrame] = []
    for level, (width, left, most) in enumerate(((12, 48, bucket), (9, 36, 16 * bucket), (6, 27, 64 * bucket)), 2):
        hot = frozen(now.groupBy("key").count().filter(F.col("count") > most).select("key"))
        if not hot.take(1):
            break
        # under 4 n / bucket keys of one word each: Catalyst broadcasts them only if their measured size allows
        done.append(now.join(hot, "key", "left_anti").select("key", "fp", "level"))
        now = _deal(now.join(hot, "key", "left_semi"), width, left, level)
    done.append(now.select("key", "fp", "level"))
    rows = done[0]
    for d in done[1:]:
        rows = rows.unionByName(d)
    # keys of four levels have 18, 32, 43 and 51 bits: the level on top keeps them apart
    rows = rows.select(F.col("key").bitwiseOR(F.shiftleft(F.col("level").cast("long"), 56)).alias("key"), "fp")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as small rows with much work are not to be coalesced
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the edges (a, b): root is one vertex for each connected component."""
    edges = frozen(edges.filter("a <> b").distinct())
    roots: DataFrame | None = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = frozen(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")))
        while True:
            above = up.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
            new = frozen(up.join(above, up.p == above._v).select("v", F.col("_p").alias("p"), (F.col("_p") != F.col("p")).alias("moved")))
            up = new.drop("moved")
            if not new.filter("moved").take(1):
                break
        if roots is None:
            roots = up.select("v", F.col("p").alias("root"))
        else:
            step = up.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
            roots = roots.join(step, roots.root == step._v, "left").select("v", F.coalesce("_p", "root").alias("root"))
        a, b = up.select(F.col("v").alias("a"), F.col("p").alias("pa")), up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = frozen(edges.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root"))


def classes_of(prints: DataFrame, bucket: int = 4096) -> DataFrame:
    """For (_id, _fp) rows: each distinct `fp` with `n`, its rows, `root`, a fingerprint that stands for its class, and `component_id`, the smallest id of the class."""
    each = frozen(prints.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("least"), F.count("*").alias("n")))
    roots = frozen(components(links(each, bucket)))
    named = roots.join(each, roots.v == each.fp).groupBy("root").agg(F.min("least").alias("_c"), F.count("*").alias("_n"))
    linked = join_groups(roots, named, "root", "_n").select(F.col("v").alias("_v"), "root", "_c")
    return each.join(linked, each.fp == linked._v, "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("_v").isNull(), F.col("least")).otherwise(F.col("_c")).alias("component_id"))


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = 4096) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    prints = frozen(with_fingerprint(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", "_fp").drop("_text"))
    out = join_groups(prints, classes_of(prints, bucket).withColumnRenamed("fp", "_fp"), "_fp", "n")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = 4096) -> DataFrame:
    """The rows of `df`, all columns, of which one of each class stays: that of the smallest id (and smallest fingerprint, if rows share the id).

    Ids, fingerprints and hashes of the texts alone decide; whole rows shuffle once, to meet the id and hash of those
    that stay. Of rows alike in both, one stays.
    """
    key, text_hash, rows, place = unused(df, "_key", "_hash", "_rows", "_place")
    slim = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    prints = frozen(with_fingerprint(slim, "_text", "_fp").drop("_text"))
    found = join_groups(prints, classes_of(prints, bucket).withColumnRenamed("fp", "_fp"), "_fp", "n")
    # the first of a class: ids are compared with null last
    alike = found.groupBy("root", "_id", "_fp", "_hash").agg(F.count("*").alias("_rows"))
    first = alike.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_fp", "_hash", "_rows")).alias("_f"))
    first = frozen(first.select(F.col("_f._id").alias(key), F.col("_f._hash").alias(text_hash), F.col("_f._rows").alias(rows)))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(text_hash))
    out = df.join(first.filter(F.col(rows) == 1), same).select(*columns_of(df))
    many = first.filter(F.col(rows) > 1)
    if many.take(1):
        order = Window.partitionBy(key, text_hash).orderBy(row_hash(df))
        one = df.join(many, same).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
        out = out.union(one.select(*columns_of(df)))
    return out
