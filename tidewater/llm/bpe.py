"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation: every code point gets a class from an array; an automaton of eight states over these classes
knows where tokens begin. Its transition functions compose associatively, so a piece of text is cut into blocks
whose functions are composed side by side, chained, and then replayed from the known states. The slices between
boundaries go through a cache of merged pairs, and the ids of a whole piece are gathered with array indexing.
Token byte offsets are kept, so that decoding is one gather too.

Null text counts as empty: no ids, and the hash of no bytes; an empty table gives no rows. A very long text is a piece
of its own. A long run without a boundary is merged with a heap
in O(n log n). Rows are independent, so repeated ids and ties need no rule; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, distinct_spans, flat, pieces

LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK, BREAK = range(8)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers that Unicode 15.1 and 16.0 added to those of 15.0 (first and last code point).
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    (0x2EBF0, 0x2EE5D),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Versions of Python's Unicode tables that these complete to 16.0, which the encoder's pattern is read by.
UNICODE = ("15.0.0", "15.1.0", "16.0.0")
#: Distinct slices kept by a worker before its cache starts anew.
CACHE_SLICES = 250_000
_NONE = 1 << 60


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, by Unicode 16.0 whichever of UNICODE the worker's Python has."""
    if unicodedata.unidata_version not in UNICODE:
        raise RuntimeError(f"code point classes are known for Unicode {', '.join(UNICODE)}, this Python has {unicodedata.unidata_version}")
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for ranges, kind in ((NEWER_LETTERS, LETTER), (NEWER_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a token begins, by class and state. White space also looks at what follows."""
    after = np.zeros((8, 8), np.uint8)
    begins = np.ones((8, 8), bool)
    joins = {LETTER: (IN_LETTERS, AFTER_SPACE), NUMBER: (IN_NUMBERS, AFTER_SPACE), OTHER: (IN_OTHER, AFTER_SPACE), SHORT: (IN_OTHER, AFTER_SPACE), LONG: (IN_OTHER, AFTER_SPACE), SPACE: (AFTER_SPACE, AFTER_BLANK), BLANK: (AFTER_SPACE, AFTER_BLANK), BREAK: ()}
    to = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT: ONE_LEFT, LONG: TWO_LEFT, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK, BREAK: FRESH}
    for c in range(8):
        after[c] = to[c]
        for s in joins[c]:
            begins[c, s] = False
            if c in (SHORT, LONG):
                after[c, s] = IN_OTHER
        if c != BREAK:
            after[c, ONE_LEFT], after[c, TWO_LEFT] = FRESH, ONE_LEFT
            begins[c, ONE_LEFT] = begins[c, TWO_LEFT] = False
    return after, begins


_AFTER, _BEGINS = _automaton()
_NEXT = _AFTER.ravel()


def _threes() -> np.ndarray:
    """Transition functions of three classes in a row, composed: state out, by the classes and the state in."""
    two = _AFTER[:, _AFTER]  # second class, first class, state
    three = _AFTER[:, two]  # third, second, first, state
    return np.ascontiguousarray(three.transpose(2, 1, 0, 3)).ravel()


_NEXT3 = _threes()


def states(kind: np.ndarray) -> np.ndarray:
    """State before each code point, by a blocked scan over transition functions.

    Composition is associative: threes of code points have their functions in a table, these are composed along
    blocks that lie side by side, the blocks' functions are chained, and each block replays from its known state.
    """
    n = len(kind)
    thirds = -(-n // 3)
    width = max(1, int(thirds**0.5) // 3)
    blocks = -(-thirds // width)
    padded = np.full(3 * blocks * width, BREAK, np.uint8)
    padded[:n] = kind
    one, two, three = padded[0::3], padded[1::3], padded[2::3]
    code = (one.astype(np.int16) * 64 + two * np.int16(8) + three).reshape(blocks, width)
    steps = np.ascontiguousarray(code.T).astype(np.intp) * 8
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))  # each block's function: state in, state out
    for step in steps:
        whole = _NEXT3.take(step[:, None] + whole)
    state = np.empty(blocks, np.uint8)
    at = FRESH
    for b, f in enumerate(whole.tolist()):
        state[b] = at
        at = f[at]
    out = np.empty((width, blocks), np.uint8)
    for t, step in enumerate(steps):
        out[t] = state
        state = _NEXT3.take(step + state)
    before = np.empty(3 * blocks * width, np.uint8)
    before[0::3] = out.T.ravel()
    before[1::3] = _NEXT.take(one * np.uint8(8) + before[0::3])
    before[2::3] = _NEXT.take(two * np.uint8(8) + before[1::3])
    return before[:n]


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, where each slice begins (and the last ends), and each text's first slice."""
    joined = "\0".join(["", *texts])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    breaks = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
    kind = classes()[code]
    kind[breaks] = BREAK
    quote = np.flatnonzero((code == 39) & (kind == OTHER))
    one, two = np.append(code, [0, 0])[quote + 1], np.append(code, [0, 0])[quote + 2]
    kind[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pair = np.isin(one * np.uint32(256) + two, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & (one < 128) & (two < 128)
    kind[quote[pair]] = LONG
    before = states(kind)
    begins = _BEGINS[kind, before]
    white = (kind == SPACE) | (kind == BLANK)
    inside = np.append(~white[1:] & (kind[1:] != BREAK), False)
    begins |= white & inside & (before != ONE_LEFT) & (before != TWO_LEFT)
    bytes_each = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
    bytes_each[breaks] = 0
    place = np.zeros(len(code) + 1, np.int64)
    np.cumsum(bytes_each, out=place[1:])
    begins[breaks] = False
    starts = np.flatnonzero(begins)
    return "".join(texts).encode("utf-8", "surrogatepass"), np.append(place[starts], place[-1]), np.append(np.searchsorted(starts, breaks), len(starts))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: join the pair of lowest rank, leftmost first, until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 96:
        return _merge_long(piece, ranks)
    get, none = ranks.get, 1 << 60
    cuts = list(range(len(piece) + 1))
    rank = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while rank and (least := min(rank)) != none:
        i = rank.index(least)
        del cuts[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            rank[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and (j := right[i]) < n and (r := ranks.get(piece[i : right[j]])) is not None:
            heapq.heappush(heap, (r, i, right[j]))

    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := right[i]) >= n or right[j] != end:
            continue
        alive[j] = False
        right[i] = end
        if end < n:
            left[end] = i
        offer(i)
        offer(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


class Slices:
    """Numbered slices with their ids in one array, grown by whole batches."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def add(self, keys: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Take up new slices; ids: those of all, one after the other."""
        self.known.update(zip(keys, range(len(self.begin) - 1, len(self.begin) - 1 + len(keys)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])


class Encoding:
    """A rank file with its cache of slices and its table for decoding."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        most = max(self.ranks.values()) + 1
        by_id: list[bytes] = [b""] * most
        for token, i in self.ranks.items():
            by_id[i] = token
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in by_id])]).astype(np.int64)
        self.cache = Slices()
        joins = sorted((ra * most + rb, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (ra := self.ranks.get(t[:i])) is not None and (rb := self.ranks.get(t[i:])) is not None)
        self.most = most
        self.pair = np.array([k for k, _ in joins] or [-1], np.int64)
        self.pair_rank = np.array([r for _, r in joins] or [_NONE], np.int64)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make, or _NONE; a negative token joins with nothing."""
        key = np.where((a < 0) | (b < 0), -2, a * self.most + b)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], _NONE)

    def merge_all(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many slices and their numbers: short ones side by side as rows of a matrix, a join in each row at a time."""
        size = np.fromiter(map(len, keys), np.int64, len(keys))
        data = np.frombuffer(b"".join(keys), np.uint8)
        begin = np.cumsum(size) - size
        lengths = np.zeros(len(keys), np.int64)
        parts = []  # numbers of slices, their tokens as a matrix filled up with -1
        whole = np.fromiter((self.ranks.get(k, -1) for k in keys), np.int64, len(keys))
        parts.append((np.flatnonzero(whole >= 0), whole[whole >= 0, None]))
        size = np.where(whole >= 0, 0, size)
        for low, high in ((0, 8), (8, 12), (12, 20), (20, 32)):
            mine = np.flatnonzero((size > low) & (size <= high))
            if not len(mine):
                continue
            tokens = np.full((len(mine), high + 1), -1, np.int64)
            tokens[np.arange(high + 1) < size[mine, None]] = self.single[data[flat(begin[mine], size[mine])]]
            rank = self._joined(tokens[:, :-1], tokens[:, 1:])
            row, column = mine, np.arange(high)
            while len(row):
                at = rank.argmin(1)
                least = rank[np.arange(len(row)), at]
                go = least != _NONE
                if not go.all():
                    parts.append((row[~go], tokens[~go]))
                    row, tokens, rank, at, least = row[go], tokens[go], rank[go], at[go], least[go]
                each = np.arange(len(row))
                tokens[each, at] = least
                moved = column + (column > at[:, None])  # what stands right of the join moves one to the left
                tokens[:, :-1] = np.take_along_axis(tokens, moved, 1)
                tokens[:, -1] = -1
                rank = np.take_along_axis(rank, np.minimum(moved, high - 1), 1)
                rank[:, -1] = _NONE
                rank[each, at] = self._joined(tokens[each, at], tokens[each, at + 1])
                before = np.maximum(at - 1, 0)
                rank[each, before] = np.where(at > 0, self._joined(tokens[each, before], tokens[each, at]), rank[each, before])
        for i in np.flatnonzero(size > 32).tolist():
            parts.append((np.array([i]), np.array([merge(keys[i], self.ranks)])))
        for rows, tokens in parts:
            lengths[rows] = (tokens >= 0).sum(1)
        ids = np.zeros(lengths.sum(), np.uint32)
        first = np.cumsum(lengths) - lengths
        for rows, tokens in parts:
            ids[flat(first[rows], lengths[rows])] = tokens[tokens >= 0]
        return ids, lengths

    def slices(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each slice in the cache, and each text's first slice."""
        data, place, bounds = boundaries(texts)
        if len(self.cache.known) > CACHE_SLICES:
            self.cache = Slices()
        first, same = distinct_spans(np.frombuffer(data, np.uint8), place[:-1], place[1:])
        get = self.cache.known.get
        keys = [data[a:b] for a, b in zip(place[first].tolist(), place[first + 1].tolist(), strict=True)]
        numbers = [get(k, -1) for k in keys]
        if -1 in numbers:
            new = list(dict.fromkeys(k for n, k in zip(numbers, keys, strict=True) if n < 0))
            self.cache.add(new, *self.merge_all(new))
            numbers = [n if n >= 0 else get(k) for n, k in zip(numbers, keys, strict=True)]
        found = np.array(numbers, np.int64)[same]
        return found, bounds

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        found, bounds = self.slices(texts)
        begin = self.cache.begin
        total = np.concatenate([[0], np.cumsum((begin[1:] - begin[:-1])[found])])
        return total[bounds[1:]] - total[bounds[:-1]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's first id."""
        found, bounds = self.slices(texts)
        ids, begin = self.cache.ids, self.cache.begin
        lengths = (begin[1:] - begin[:-1])[found]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids[flat(begin[:-1][found], lengths)], total[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and each text's first byte."""
        lengths = (self.begin[1:] - self.begin[:-1])[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.bytes[flat(self.begin[:-1][ids], lengths)], total[bounds]


@lru_cache(4)
def load(path: str) -> Encoding:
    """The encoding of a rank file, once per worker."""
    return Encoding(path)


def _texts(batch: pa.RecordBatch) -> list[str]:
    col = batch.column("text")
    return (col.fill_null("") if col.null_count else col).to_pylist()


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """docs' doc_id with n_tokens, by the rank file at `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encoding.counts(_texts(batch)))], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").transform(arrow_map, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and begins (array of long: the byte at which each id begins) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path)
        for batch in pieces(batches):
            ids, bounds = encoding.encode(_texts(batch))
            lengths = (encoding.begin[1:] - encoding.begin[:-1])[ids]
            at = np.cumsum(lengths) - lengths
            first = np.concatenate([at, [lengths.sum()]])[bounds[:-1]]
            at = at - np.repeat(first, np.diff(bounds))
            off = pa.array(bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(off, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(at))], names=["doc_id", "ids", "begins"])

    return docs.select("doc_id", "text").transform(arrow_map, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, begins array<bigint>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path)
        for batch in pieces(batches):
            ids, bounds = encoding.encode(_texts(batch))
            back, ends = encoding.decode(ids, bounds)
            raw = memoryview(ids.astype("<u4").tobytes())
            body = memoryview(back.tobytes())
            b, e = bounds.tolist(), ends.tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(bounds)),
                pa.array([hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(b, b[1:], strict=False)], pa.string()),
                pa.array([hashlib.sha256(body[i:j]).hexdigest() for i, j in zip(e, e[1:], strict=False)], pa.string()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").transform(arrow_map, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
