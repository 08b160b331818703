"""Language identification by cross-parsing.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed greedily into
the longest phrases that occur in a language's sample; the language that needs the fewest phrases for each character
wins (ties: the smaller code). Letters are lower-cased, runs of anything else count as one space.

The automata keep only the transitions they have, as double arrays side by side, so that one array step moves every
block of a batch one character on in every language at once. Every letter of the samples is a symbol of its own,
whatever the script; only letters that no sample holds are one symbol, which fits nowhere. A letter that a language's
sample lacks is a phrase of its own there. Texts are cut into blocks of `BLOCK` characters, each parsed from the start,
so a long text takes no more steps than a short one; no character is left out, and a phrase that a border cuts counts
twice, in every language alike.

Learning: of each language the `DOCS` labelled rows of the least hash among those of at most `LONGEST` code points are
learnt whole; a language that has only longer ones gives a passage of `LONGEST` code points of each, which begins at a
place drawn by hash. The tables grow with the number of languages, by a few MB each. Only text and label are learnt from.

Defined cases: a null text, or one without a letter, is `und` with score 0; with no labelled row everything is `und`;
a null id is not held out and not learnt from; repeated rows are each predicted; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .bpe import classes
from .shared import map_pieces

DOCS, LONGEST = 48, 1000
BLOCK = 2048
#: A text belongs to no learnt language if even the best one needs over `FIT` times the phrases, and `FEW` more, that
#: letters drawn at random from that language's would take on average: n log(letters) / log(length of the sample).
FIT, FEW = 1.1, 4
SPACE, OTHER = 0, 1


def letters_of(text: str) -> np.ndarray:
    """Code points, lower-cased, with each run of what is no letter as one zero."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = _lower()[points]
    return low[(low > 0) | np.r_[True, low[:-1] > 0]] if len(low) else low


@functools.cache
def _lower() -> np.ndarray:
    """Lower-case code point of each letter, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    at = np.flatnonzero(classes() == 0)
    table[at] = [ord(c) if len(c := chr(p).lower()) == 1 else p for p in at.tolist()]
    return table


class Table:
    """Transitions as a double array: cell state + symbol holds the state it belongs to and the next one."""

    def __init__(self, rows: list[dict[int, int]], size: int):
        span = 64 + 3 * sum(map(len, rows))
        full, used, base = bytearray(span + size), bytearray(span), [0] * len(rows)
        draw = random.Random(1).random
        # the start stays 0; of the others, those with many transitions find room first
        for s in sorted(range(len(rows)), key=lambda s: (s > 0, -len(rows[s]))):
            at = int(draw() * span) if s else 0
            while used[at] or any(full[at + c] for c in rows[s]):
                at = int(draw() * span)
            base[s], used[at] = at, 1
            for c in rows[s]:
                full[at + c] = 1
        self.cells = np.full((span + size, 2), -1, np.int32)
        for s, row in enumerate(rows):
            for c, to in row.items():
                self.cells[base[s] + c] = base[s], base[to]

    def __getitem__(self, at: tuple[int, int]) -> int:
        owner, to = self.cells[at[0] + at[1]].tolist()
        return to if owner == at[0] else -1


def automaton(symbols: list[int], size: int) -> Table:
    """Transitions (state, symbol) of the suffix automaton, -1 where there is none; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return Table(nxt, size)


class Model:
    """Side-by-side automata of all languages."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = {}
        for name in self.languages:
            parts = [letters_of(t) for t in samples[name]]
            texts[name] = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.uint32))]) if parts else np.zeros(0, np.uint32)
        every = np.concatenate([np.zeros(0, np.uint32), *texts.values()])
        self.points = np.unique(every[every > 0]).astype(np.uint32)
        tables, self.roots = [], []
        base = 0
        self.random_rate = []
        for name in self.languages:
            self.random_rate.append(np.log(len(np.unique(texts[name])) + 1) / np.log(len(texts[name]) + 3))
            t = automaton(self.symbols(texts[name]).tolist(), 2 + len(self.points)).cells
            t[t >= 0] += base
            self.roots.append(base)
            base += len(t)
            tables.append(t)
        #: The state after a letter that the sample lacks, and before the first one: nothing follows it.
        self.dead = base
        self.cells = np.concatenate([*tables, np.full((2 + len(self.points), 2), -1, np.int32)])

    @functools.cached_property
    def _symbol(self) -> np.ndarray:
        table = np.full(0x110000, OTHER, np.min_scalar_type(2 + len(self.points)))
        table[0] = SPACE
        table[self.points] = np.arange(2, 2 + len(self.points))
        return table

    def symbols(self, letters: np.ndarray) -> np.ndarray:
        return self._symbol[letters]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_symbol"}

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (language, text) and number of letters and spaces parsed of each text; 0 where it has no letter."""
        seqs = [letters_of(t) if t else np.zeros(0, np.uint32) for t in texts]
        seqs = [s if s.any() else s[:0] for s in seqs]
        sizes = np.array([len(s) for s in seqs], np.int64)
        blocks = -(-sizes // BLOCK)
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        if not sizes.sum() or not self.languages:
            return total, sizes
        owner = np.repeat(np.arange(len(texts)), blocks)
        first = np.cumsum(blocks) - blocks
        grid = np.zeros((int(blocks.sum()), BLOCK), self._symbol.dtype)
        flat = grid.reshape(-1)
        for s, at in zip(seqs, (first * BLOCK).tolist(), strict=True):
            flat[at : at + len(s)] = self._symbol[s]
        # long blocks first, so that those not yet at their end are the first ones at every step
        length = np.minimum(BLOCK, sizes[owner] - BLOCK * (np.arange(len(owner)) - first[owner]))
        order = np.argsort(-length, kind="stable")
        live = np.searchsorted(-length[order], -np.arange(BLOCK), side="left").tolist()
        grid = np.ascontiguousarray(grid[order].T)
        cells = self.cells.view(np.int64).reshape(-1)  # owner and next state are read at once
        roots = np.array(self.roots, np.int32)
        state = np.full((grid.shape[1], len(roots)), self.dead, np.int32)
        count = np.zeros(state.shape, np.int32)
        for row, n in zip(grid, live, strict=True):
            if not n:
                break
            now = state[:n]
            got = cells.take(now + row[:n, None].astype(np.int32)).view(np.int32).reshape(n, -1, 2)
            stuck = got[:, :, 0] != now
            count[:n] += stuck
            state[:n] = got[:, :, 1]
            block, lang = np.nonzero(stuck)
            again = self.cells[roots[lang] + row[block].astype(np.int32)]
            state[block, lang] = np.where(again[:, 0] == roots[lang], again[:, 1], self.dead)
        for k in range(len(self.languages)):
            total[k] = np.bincount(owner[order], weights=count[:, k], minlength=len(texts)).astype(np.int64)
        return total, sizes

    def parsed(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """Language, score and fit of each text.

        The score is the difference of the two least numbers of phrases as a share of their sum; a single language is
        held against a phrase for each half character. The fit is whether the text belongs to the language at all.
        """
        for lo in range(0, len(texts), 256):
            total, sizes = self.phrases(texts[lo : lo + 256])
            for k, n in enumerate(sizes.tolist()):
                if not n or not self.languages:
                    yield "und", 0.0, bool(n)
                    continue
                order = np.argsort(total[:, k], kind="stable")
                best = int(total[order[0], k])
                second = int(total[order[1], k]) if len(order) > 1 else 2 * n
                yield self.languages[order[0]], max(0.0, (second - best) / (second + best)), best <= FIT * self.random_rate[order[0]] * n + FEW

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [x[:2] for x in self.parsed(texts)]


def held_out(id_col: str):  # noqa: ANN201
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from a bounded sample of the labelled rows that are not held out: `DOCS` texts or passages of at most `LONGEST` code points for each language are all that reaches the driver."""
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    text, drawn = F.coalesce(F.col(text_col), F.lit("")), F.xxhash64(id_col)
    more = F.length(text) - F.lit(LONGEST)
    passage = F.when(more <= 0, text).otherwise(F.substring(text, F.pmod(drawn, F.greatest(more, F.lit(1)).cast("long")).cast("int") + 1, F.lit(LONGEST)))
    slim = rows.select(F.col(lang_col).alias("_lang"), (more > 0).alias("_long"), drawn.alias("_h"), F.col(id_col).alias("_id"), passage.alias("_text"))
    order = Window.partitionBy("_lang").orderBy("_long", "_h", "_id", "_text")
    got = slim.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= DOCS).orderBy("_lang", "_n").collect()
    samples: dict[str, list[str]] = {}
    whole = {r["_lang"] for r in got if not r["_long"]}
    for r in got:
        if not (r["_long"] and r["_lang"] in whole):
            samples.setdefault(r["_lang"], []).append(r["_text"])
    return Model(samples)


def with_language(df: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = m.predict(b.column(at).to_pylist())
            cols = [*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *names])

    return map_pieces(df, run, StructType([*df.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score."""
    model = train(df, id_col, text_col, lang_col)
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    return with_language(rows, model, "_text").select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `df` that have a language: a letter, and a predicted language that fits the text. Where none was learnt, a letter is enough."""
    model = train(df, id_col, text_col, lang_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            keep = [fits for _, _, fits in m.parsed(texts)] if m.languages else [bool(t) and bool(letters_of(t).any()) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_pieces(df, run, df.schema)
