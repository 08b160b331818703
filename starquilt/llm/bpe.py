"""Byte-level BPE over a vectorised pre-tokeniser.

Texts of a batch become one array of code points. Each code point has a class (letter, number, white space, other),
and together with its right neighbours one of nine symbols; the splitting pattern is a ten-state automaton over these
symbols. Every symbol is a function from states to states; the functions and their compositions form a small monoid,
so the state before each character is an associative scan over monoid elements: products inside blocks, a scan over
the block totals, and one last product. A table over (state, symbol) says where a piece begins. No regular expression
takes part. Pieces, slices of the UTF-8 bytes, go through a cache of merged pieces; what it does not hold is merged
pair by pair, lowest rank first. Byte offsets of the vocabulary decode ids back to bytes.

Defined cases: a null text counts as empty; empty texts have no ids; text in any script round-trips byte for byte;
the special token's string is ordinary text; repeated rows and equal ids are each encoded; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_pieces

L, N, O, APOSTROPHE1, APOSTROPHE2, W, LAST_SPACE, LAST_WHITE, END = range(9)
START, IN_L, IN_N, IN_O, IN_W, AT_SPACE, AT_WHITE, ONE_MORE, TWO_MORE, CUT = range(10)
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points that one scan takes; a longer text is cut at the first run of white space from there on, where a piece
#: always begins and nothing before it matters. A text without white space is scanned whole.
SLICE = 1 << 20
_RUN = re.compile("(?<=[^{0}])[{0}]".format("".join(map(re.escape, map(chr, WHITE)))))
BLOCK = 128


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a piece begins before it."""
    if symbol == L:
        if state in (ONE_MORE, TWO_MORE):
            return (CUT if state == ONE_MORE else ONE_MORE), False
        return IN_L, state not in (IN_L, AT_SPACE)
    if symbol == N:
        return IN_N, state not in (IN_N, AT_SPACE)
    if symbol == O or symbol in (APOSTROPHE1, APOSTROPHE2) and state in (IN_O, AT_SPACE):
        return IN_O, state not in (IN_O, AT_SPACE)
    if symbol in (APOSTROPHE1, APOSTROPHE2):
        return (ONE_MORE if symbol == APOSTROPHE1 else TWO_MORE), True
    if symbol == W:
        return IN_W, state != IN_W
    if symbol == END:
        return START, True
    return (AT_SPACE if symbol == LAST_SPACE else AT_WHITE), True


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin table (state, symbol); monoid product table; element of each symbol; image of the start state under each element."""
    begins = np.array([[_step(s, a)[1] for a in range(9)] for s in range(10)])
    identity = tuple(range(10))
    of_symbol = [tuple(_step(s, a)[0] for s in range(10)) for a in range(9)]
    found = {identity: 0}
    queue = [identity]
    for f in queue:
        for g in of_symbol:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    product = np.array([[found[tuple(g[x] for x in f)] for g in queue] for f in queue], np.int32)
    return begins, product, np.array([found[f] for f in of_symbol], np.int32), np.array([f[START] for f in queue], np.int8)


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point: L, N, O or W."""
    table = np.full(0x110000, O, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((L, r"\p{L}+"), (N, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
            if a < 0xD800 < b:
                table[0xD800:0xE000] = O
    table[WHITE] = W
    return table


def scan(elements: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Inclusive products of monoid elements, by blocks: inside each block, then over the blocks' totals, then joined."""
    n = len(elements)
    if n <= BLOCK:
        out = np.empty(n, np.int32)
        acc = 0
        table = product
        for i, e in enumerate(elements.tolist()):
            acc = table[acc, e]
            out[i] = acc
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros((rows, BLOCK), np.int32)  # element 0 is the identity
    grid.reshape(-1)[:n] = elements
    grid = np.ascontiguousarray(grid.T)
    width, flat = product.shape[1], product.reshape(-1)
    for i in range(1, BLOCK):
        grid[i] = flat[grid[i - 1] * width + grid[i]]
    totals = scan(grid[-1].copy(), product)
    before = np.zeros(rows, np.int32)
    before[1:] = totals[:-1]
    return flat[before * width + grid].T.reshape(-1)[:n]


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin, in code points of several texts laid end to end; `ends` are the texts' ends."""
    begins, product, of_symbol, image = _automaton()
    n = len(points)
    kind = classes()[points]
    symbol = kind.copy()
    last = np.zeros(n, bool)
    last[ends[ends > 0] - 1] = True
    following = np.full(n, W, np.uint8)
    following[:-1] = kind[1:]
    following[last] = W
    closing = (kind == W) & (following != W)
    symbol[closing] = np.where(points[closing] == 32, LAST_SPACE, LAST_WHITE)
    quotes = np.flatnonzero((points == 39) & ~last)
    if len(quotes):
        one = points[quotes + 1]
        symbol[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = APOSTROPHE1
        quotes = quotes[quotes + 2 < n]
        quotes = quotes[~last[quotes + 1]]
        pair = points[quotes + 1].astype(np.int64) << 21 | points[quotes + 2]
        symbol[quotes[np.isin(pair, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])]] = APOSTROPHE2
    elements = of_symbol[symbol]
    first = np.r_[0, ends[:-1]]
    first = first[first < ends]
    elements[first] = product[of_symbol[END], elements[first]]  # each text begins afresh
    state = image[scan(elements, product)]
    before = np.empty(n, np.int8)
    before[0] = START
    before[1:] = state[:-1]
    before[first] = START
    return begins[before, symbol]


def cut(text: str) -> Iterator[str]:
    """The text in parts of about SLICE, which are encoded independently of each other."""
    at = 0
    while at < len(text):
        m = _RUN.search(text, at + SLICE)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_file: str, cache_size: int = 200_000):
        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.vocab: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            self.vocab[i] = piece
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.cache: dict[bytes, bytes] = {}  # two generations: what was used lately moves to the young one
        self.aged: dict[bytes, bytes] = {}
        self.pairs: dict[int, int] = {}
        self.cache_size = cache_size

    def _pair(self, a: int, b: int) -> int:
        """Rank of the joined pair, or a number above all ranks."""
        key = a << 20 | b
        r = self.pairs.get(key)
        if r is None:
            r = self.ranks.get(self.vocab[a] + self.vocab[b], 1 << 30)
            if len(self.pairs) < 1 << 17:
                self.pairs[key] = r
        return r

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of the lowest rank is joined, the leftmost first, until none can be."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[c] for c in piece]
        if len(ids) > 48:
            return self._merge_long(ids)
        pair = self._pair
        ranks = [pair(a, b) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == 1 << 30:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [low]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = pair(low, ids[i + 1])
            if i:
                ranks[i - 1] = pair(ids[i - 1], low)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, so that a piece of n bytes takes n log n steps."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self._pair(ids[i], ids[i + 1])) < 1 << 30]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := self._pair(r, ids[after[i]])) < 1 << 30:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if before[i] >= 0 and (x := self._pair(ids[before[i]], r)) < 1 << 30:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return [x for x in ids if x >= 0]

    def _packed(self, piece: bytes) -> bytes:
        got = self.aged.get(piece)
        if got is None:
            ids = self.merge(piece)
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self.cache) >= self.cache_size:
                self.aged, self.cache = self.cache, {}
            self.cache[piece] = got
        return got

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            if len(t) > SLICE:
                out += self._encode(group) if group else []
                out.append(b"".join(self._encode([part])[0] for part in cut(t)))
                group, size = [], 0
                continue
            if group and size + len(t) > SLICE:
                out += self._encode(group)
                group, size = [], 0
            group.append(t)
            size += len(t)
        return out + self._encode(group) if group else out

    def _encode(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) for t in texts])
        starts = np.flatnonzero(boundaries(points, ends))
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        offsets = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offsets[1:])
        raw = joined.encode("utf-8", "surrogatepass")
        cut = [*offsets[starts].tolist(), len(raw)]
        pieces = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        known, slow = self.cache.get, self._packed
        coded = [known(p) or slow(p) for p in pieces]
        first = np.searchsorted(starts, np.r_[0, ends]).tolist()
        return [b"".join(coded[a:b]) for a, b in zip(first, first[1:], strict=False)]

    def decode(self, ids: bytes) -> bytes:
        vocab = self.vocab
        return b"".join([vocab[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, ids: bytes) -> np.ndarray:
        """Where each id begins in the decoded bytes, and their length last."""
        sizes = [len(self.vocab[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        return np.r_[0, np.cumsum(sizes, dtype=np.int64)] if sizes else np.zeros(1, np.int64)


@functools.cache
def coder(ranks_file: str) -> Coder:
    """One coder, and so one cache, for each worker process."""
    return Coder(ranks_file)


def encode_documents(df: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded, the bytes that the ids stand for."""
    rows = df.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_file)
        for b in batches:
            ids = c.encode_batch(b.column(1).to_pylist())
            cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids", "decoded"])

    return map_pieces(rows, run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens and the SHA-256 of ids and decoded bytes."""
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
