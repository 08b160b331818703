"""Approximate nearest neighbours by largest inner product: inverted lists, product-quantised residuals, exact reranking.

Equal vectors are one entry of the index that carries its `top + 1` smallest ids: ties go to the smaller id, so a larger
one can never be asked for, and a vector shared by a third of all rows costs no more than another. A bounded sample
trains the coarse centroids and, on what remains, one codebook for each slice of the dimensions; every entry is
indexed. Lists are cut into cells of at most `CELL` entries and cells packed into shards of about `SHARD`; a query
goes to the shards that hold lists it probes, once each. There a table of its products with the codebooks gives
approximate scores of all entries of those lists. The best `SHORT` of them (`top + 1` if that is more) are scored again
exactly, in double precision on the original vectors; so is every other entry that could still be among the `top + 1`
best, or tie with them: whose approximate score, with a margin, reaches the last of these. The best of all shards are merged.

How many lists to probe and how wide the margin is are measured: for `TRIAL` of the queries asked, drawn by hash, the true
neighbours are found by brute force over all entries. Lists are probed by the product with the centroid and `spread` times
the deviation of the list's products; of some spreads, the one is taken with which the fewest lists hold `TARGET` of the true
neighbours. The margin is a share of the query's length times the entry's own loss by its code, so large that it holds
`TARGET` of them. A query whose lists hold fewer than `SHORT` entries goes on to further lists until they do. So neither has
a bound that could cost recall where the data are hard. All of it is in double precision: very small, very large and
far-off vectors lose no digits.

Bounds on what is broadcast or reaches the driver: `SAMPLE` training vectors, `MOST_LISTS` centroids, a number for each
cell (`MOST_CELLS` + lists at most), and the trial's neighbours.

Defined cases: rows whose id is null, or whose vector is null, empty, zero, of another length than most vectors, or
has a null or non-finite component take no part; a query's own id is never its neighbour; rows repeated whole count
once; with fewer candidates than asked for, all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import frozen, join_groups

SAMPLE, MOST_LISTS, SLICES, CODES = 16_384, 4096, 16, 256
CELL, SHARD, SHORT = 8192, 16_384, 160
#: Cells beyond one for each list; with more entries than CELL times this, cells and shards grow instead.
MOST_CELLS = 1 << 20
TRIAL, TARGET = 512, 0.998
SPREADS = (0.0, 1.0, 2.0, 3.0)
#: In lengths of query and loss; covers the rounding of scores where codes lose nothing.
LEAST_MARGIN = 0.05


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A batch's vectors; list columns are flat in Arrow."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def codes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        total, n = np.zeros((len(c), x.shape[1])), np.bincount(own, minlength=len(c))
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The closest centroid of each row, a few thousand rows at a time."""
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(x[i : i + 2048] @ c.T - half, axis=1) for i in range(0, len(x), 2048))])


class Quantiser:
    """Coarse centroids and the codebooks of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        dim, self.spread = sample.shape[1], 0.0
        self.centroids = kmeans(sample, lists, 8, 1)
        own = nearest(sample, self.centroids)
        rest = sample - self.centroids[own]
        # each list's variance by dimension; that of all stands in for four rows, as a list may have few in the sample
        total, every = np.zeros_like(self.centroids), (rest * rest).mean(axis=0)
        np.add.at(total, own, rest * rest)
        self.variance = (total + 4 * every) / (np.bincount(own, minlength=len(total)) + 4)[:, None]
        self.cuts = np.linspace(0, dim, min(SLICES, dim) + 1).astype(int).tolist()
        self.books = [kmeans(rest[:, a:b], CODES, 6, 2) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List and codes of each row, and the length of what they lose of it, rounding of scores included."""
        x = x.astype(np.float64)
        own = nearest(x, self.centroids)
        rest = x - self.centroids[own]
        codes = [nearest(rest[:, a:b], book) for (a, b), book in zip(zip(self.cuts, self.cuts[1:], strict=False), self.books, strict=True)]
        kept = np.concatenate([book[k] for k, book in zip(codes, self.books, strict=True)], axis=1)
        lost = np.linalg.norm(rest - kept, axis=1) + 1e-10 * np.linalg.norm(x, axis=1)
        return own, np.stack(codes, axis=1).astype(np.uint8), lost

    def probe_order(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        hope = q @ self.centroids.T
        if self.spread:
            hope += self.spread * np.sqrt((q * q) @ self.variance.T)
        return np.argsort(-hope, axis=1, kind="stable")

    def scores(self, q: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate products (query, entry) from the tables of each query."""
        q = q.astype(np.float64).T
        lists, tables = self.centroids @ q, [book @ q[a:b] for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]
        out = np.empty((q.shape[1], len(own)))
        # whole rows of the tables, for a thousand entries at a time: both stay in the cache
        for lo in range(0, len(own), 1024):
            part = lists[own[lo : lo + 1024]]
            for k, table in enumerate(tables):
                part += table[codes[lo : lo + 1024, k]]
            out[:, lo : lo + 1024] = part.T
        return out


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products in double precision; each is summed by itself, so equal pairs give equal numbers wherever they stand."""
    return (q.astype(np.float64) * v.astype(np.float64)).sum(axis=-1)


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(_id, _v) of the rows that take part, and their dimension: that of most rows, the larger one if two are as common."""
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v")).filter(F.col("_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0))
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("_v", lambda x: x != 0)
    rows = rows.filter(fine)
    common = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = int(common[0]) if common else 0
    return rows.filter(F.size("_v") == dim), dim


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def true_neighbours(entries: DataFrame, quantiser: Quantiser, trial: np.ndarray, trial_ids: np.ndarray, dim: int, top: int) -> list[tuple[int, int, float]]:
    """(query number, list, margin that its approximate score needs) of the true nearest entries of a bounded set of queries, by brute force over all entries."""
    shared = entries.sparkSession.sparkContext.broadcast((quantiser, trial, trial_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, q, own = shared.value
        length, least = np.linalg.norm(q, axis=1), np.full(len(q), -np.inf)
        best: list[tuple[np.ndarray, ...]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(q)
        for b in batches:
            ids, v, lists, codes, lost = b.column(0).to_numpy(), matrix(b.column(1), dim), b.column(2).to_numpy(), codes_of(b.column(3)), b.column(4).to_numpy()
            for lo in range(0, len(ids), 4096):
                i, w, li = ids[lo : lo + 4096], v[lo : lo + 4096].astype(np.float64), lists[lo : lo + 4096]
                s = q @ w.T
                needed = (s - quantiser.scores(q, li, codes[lo : lo + 4096])) / (length[:, None] * lost[lo : lo + 4096])
                for k in np.flatnonzero(s.max(axis=1) >= least).tolist():
                    near = np.argpartition(-s[k], top)[: top + 1] if len(i) > top + 1 else np.arange(len(i))
                    near = near[i[near] != own[k]]
                    new = (s[k][near], i[near], li[near], needed[k][near])
                    every = tuple(np.r_[x, y] for x, y in zip(best[k], new, strict=True))
                    at = _top(every[0], every[1], top)
                    best[k] = tuple(x[at] for x in every)
                    if len(at) == top:
                        least[k] = best[k][0][-1]
        n = [len(x[0]) for x in best]
        columns = [np.concatenate([x[k] for x in best]) for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n)), pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int64)), pa.array(columns[3])], names=["q", "s", "i", "l", "m"])

    got = entries.select("_id", "_v", "_list", "_code", "_lost").mapInArrow(run, "q long, s double, i long, l long, m double")
    best = got.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "i"))).filter(F.col("n") <= top)
    return [(r.q, r.l, r.m) for r in best.select("q", "l", "m").collect()]


def at_target(ascending: np.ndarray) -> float:
    return float(ascending[min(len(ascending) - 1, int(np.ceil(TARGET * len(ascending))))]) if len(ascending) else 0.0


def probes_needed(quantiser: Quantiser, trial: np.ndarray, true: list[tuple[int, int, float]]) -> int:
    """The fewest lists that hold `TARGET` of the true neighbours; the quantiser is set to the spread with which they do."""
    needed = []
    for quantiser.spread in SPREADS:
        order = quantiser.probe_order(trial)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
        needed.append(int(at_target(np.sort([place[q, li] for q, li, _ in true]))) + 1 if true else order.shape[1])
    quantiser.spread = SPREADS[int(np.argmin(needed))]
    return min(needed)


def probed_lists(order: np.ndarray, sizes: np.ndarray, probes: int, least: int) -> list[np.ndarray]:
    """Of each query's order of lists, the first `probes`, and more while these hold fewer than `least` entries."""
    enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
    return [row[:n] for row, n in zip(order, np.maximum(probes, enough).tolist(), strict=True)]


def search(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, top: int = 20) -> DataFrame:
    """Neighbours of the rows whose id is divisible by `every`, among all rows: query_id, rank from 1, the id, score."""
    spark = df.sparkSession
    rows, dim = usable(df, id_col, vec_col)
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    if not dim:
        return empty
    rows = frozen(rows.distinct())
    asked = rows.filter(F.col("_id") % every == 0)
    same = rows.groupBy("_v").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n"))
    asked = frozen(join_groups(asked, same, "_v", "_n").select("_id", "_rep"))
    # one entry for each distinct vector, with its smallest ids
    small = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_v").orderBy("_id"))).filter(F.col("_n") <= top + 1)
    entries = small.groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids")).select(F.col("_ids")[0].alias("_id"), "_v", "_ids")
    entries = frozen(entries)
    count = entries.count()
    lists = int(min(MOST_LISTS, max(1, 2 ** round(np.log2(max(2.0, count**0.5))))))
    share = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.2 * SAMPLE / count) * (1 << 30)))
    drawn = sorted(entries.filter(share).select("_id", "_v").limit(SAMPLE).collect())
    if not drawn:  # a very small table may have no row of so small a hash
        drawn = sorted(entries.select("_id", "_v").limit(SAMPLE).collect())
    sample = np.array([r[1] for r in drawn], np.float64)
    quantiser = Quantiser(sample, lists)
    shared = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, codes, lost = shared.value.encode(matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lost)], names=[*b.schema.names, "_list", "_code", "_lost"])

    entries = frozen(entries.mapInArrow(encode, StructType([*entries.schema.fields, StructField("_list", IntegerType())]).add("_code", "binary").add("_lost", "double")))
    reps = asked.select(F.col("_rep").alias("_id")).distinct()
    wanted = frozen(entries.join(reps, "_id", "left_semi").select("_id", "_v"))
    asking = wanted.orderBy(F.xxhash64(F.lit(5), "_id"), "_id").limit(TRIAL).collect()
    if not asking:
        return empty
    trial = np.array([r[1] for r in asking], np.float64)
    true = true_neighbours(entries, quantiser, trial, np.array([r[0] for r in asking]), dim, top)
    probes = probes_needed(quantiser, trial, true)
    shared = spark.sparkContext.broadcast(quantiser)  # with its spread
    margin = max(LEAST_MARGIN, at_target(np.sort([m for _, _, m in true])))
    short_list = max(SHORT, top + 1)

    # cells of lists, shards of cells
    sizes = np.zeros(len(quantiser.centroids), np.int64)
    for r in entries.groupBy("_list").count().collect():
        sizes[r[0]] = r[1]
    cell = max(CELL, -(-count // MOST_CELLS))
    chunks = np.maximum(1, -(-sizes // cell))
    first = np.cumsum(chunks) - chunks
    each = np.repeat(sizes / chunks, chunks)
    shard_of = (np.cumsum(each) - each).astype(np.int64) // max(SHARD, 2 * cell)
    plan = spark.createDataFrame([(int(k), int(chunks[k]), int(first[k])) for k in range(len(chunks))], "_list int, _chunks long, _first long")
    cells = spark.createDataFrame([(int(c), int(s)) for c, s in enumerate(shard_of)], "_cell long, shard long")
    base = entries.join(F.broadcast(plan), "_list").withColumn("_cell", F.col("_first") + F.pmod(F.xxhash64("_id"), F.col("_chunks")))
    base = base.join(F.broadcast(cells), "_cell").select("shard", F.lit(0).alias("kind"), F.col("_id").alias("id"), F.col("_v").alias("v"), F.col("_list").alias("list"), F.col("_code").alias("code"), F.col("_lost").alias("lost"), F.lit(None).cast("array<int>").alias("lists"))

    where = spark.sparkContext.broadcast((first, chunks, shard_of, sizes))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, chunks, shard_of, sizes = where.value
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                order = probed_lists(shared.value.probe_order(matrix(part.column(1), dim)), sizes, probes, short_list)
                shard, owner, probed = [], [], []
                for k, lists in enumerate(order):
                    at = np.repeat(lists, chunks[lists])
                    cell = np.concatenate([np.arange(first[x], first[x] + chunks[x]) for x in lists])
                    s = shard_of[cell]
                    for one in np.unique(s):
                        shard.append(one)
                        owner.append(k)
                        probed.append(np.unique(at[s == one]).astype(np.int32))
                took = part.take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *took.columns, pa.array(probed, pa.list_(pa.int32()))], names=["shard", "id", "v", "lists"])

    routed = wanted.mapInArrow(route, StructType([StructField("shard", base.schema["shard"].dataType), StructField("id", base.schema["id"].dataType), StructField("v", base.schema["v"].dataType), StructField("lists", base.schema["lists"].dataType)]))
    queries = routed.select("shard", F.lit(1).alias("kind"), "id", "v", F.lit(-1).alias("list"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("lost"), "lists")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(shard_of[-1]) + 1)
    lined = base.unionByName(queries).repartition(tasks, "shard").sortWithinPartitions("shard", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a shard come first and are held; its queries follow and pass through."""
        quantiser = shared.value
        now, held, ready = None, [], None
        for b in batches:
            shard, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.r_[0, np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1, len(shard)]
            for lo, hi in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                part = b.slice(lo, hi - lo)
                if shard[lo] != now:
                    now, held, ready = shard[lo], [], None
                if kind[lo] == 0:
                    held.append((part.column(2).to_numpy(), matrix(part.column(3), dim), part.column(4).to_numpy(), codes_of(part.column(5)), part.column(6).to_numpy()))
                    continue
                if not held:
                    continue
                ready = ready or tuple(np.concatenate(x) for x in zip(*held, strict=True))
                ids, v, own, codes, lost = ready
                for at in range(0, hi - lo, 64):
                    some = part.slice(at, 64)
                    q, names = matrix(some.column(3), dim), some.column(2).to_pylist()
                    probed = np.zeros((len(names), len(quantiser.centroids)), bool)
                    for k, x in enumerate(some.column(7).to_pylist()):
                        probed[k, x] = True
                    rough = np.where(probed[:, own], quantiser.scores(q, own, codes), -np.inf)
                    short = np.argpartition(-rough, short_list, axis=1)[:, :short_list] if len(ids) > short_list else np.arange(len(ids))[None, :].repeat(len(names), 0)
                    out: list[tuple[np.ndarray, np.ndarray]] = []
                    for k in range(len(names)):
                        near = short[k][rough[k, short[k]] > -np.inf]
                        s = exact(q[k][None, :], v[near])
                        best = _top(s, ids[near], top + 1)
                        if len(best) > top:  # else these were all
                            able = rough[k] + margin * np.linalg.norm(q[k].astype(np.float64)) * lost >= s[best[-1]]
                            able[near] = False
                            for more in np.array_split(np.flatnonzero(able), able.sum() // 4096 + 1):
                                near, s = np.r_[near[best], more], np.r_[s[best], exact(q[k][None, :], v[more])]
                                best = _top(s, ids[near], top + 1)
                        out.append((ids[near][best], s[best]))
                    n = [len(x[0]) for x in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n), pa.int64()), pa.array(np.concatenate([x[0] for x in out]), pa.int64()), pa.array(np.concatenate([x[1] for x in out]), pa.float64())], names=["rep", "entry", "score"])

    found = lined.mapInArrow(scan, "rep long, entry long, score double")
    by = Window.partitionBy("rep")
    found = frozen(found.withColumn("_n", F.row_number().over(by.orderBy(F.desc("score"), "entry"))).filter(F.col("_n") <= top + 1).drop("_n"))
    full = found.join(entries.select(F.col("_id").alias("entry"), "_ids"), "entry").select("rep", "score", F.explode("_ids").alias("id"))
    full = full.withColumn("_n", F.row_number().over(by.orderBy(F.desc("score"), "id"))).filter(F.col("_n") <= top + 1)
    # at most top + 1 pairs for each distinct query vector; each query then leaves itself out
    pairs = full.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("_near"))
    counts = asked.groupBy(F.col("_rep").alias("rep")).agg(F.count("*").alias("_n"))
    answers = join_groups(asked.withColumnRenamed("_rep", "rep"), counts.join(pairs, "rep"), "rep", "_n")
    own = F.slice(F.filter("_near", lambda x: x["id"] != F.col("_id")), 1, top)
    return answers.select(F.col("_id").alias("query_id"), F.posexplode(own).alias("_k", "_x")).select("query_id", (F.col("_k") + 1).cast("int").alias("rank"), F.col("_x.id").alias(id_col), (-F.col("_x.s")).alias("score"))
