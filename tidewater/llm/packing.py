"""Packing: fill windows of tokens by combinations of lengths, with repeat counts from non-negative least squares.

A document longer than the window gives whole windows of its own and one rest; only rests (1 .. window - 1 tokens)
are combined. Their histogram has fewer than `window` bins at any corpus size, so it alone goes to the driver. There
shallow combinations (two or three lengths that fill a window exactly) are enumerated, their repeat counts solved
against the histogram with all counts >= 0, rounded down, and what is left is packed greedily, longest first and
best fit, whole runs of equal patterns at a time. The plan is a table whose size depends on the window only. Each
rest gets a rank among the rests of its length (counted by buckets of ids and contents, so that neither one common
length nor one id of many texts meets in a task), and looks its sequence and offset up by that rank.

Null text counts as empty and still has its end token, so every row gets a piece. A very long text is a piece of work
of its own and is cut at whole windows. Rows that repeat an id are packed each on their own; ties go by id, then by
contents. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, buffers, distinct_spans, flat, materialize, pieces, span_hashes, words

WINDOW = 2048
END_ID = 1
#: Rows per bucket in which ranks are counted, about.
BUCKET_ROWS = 20_000
#: Distinct words kept by a worker before its cache starts anew, and places of the cache's hash table.
CACHE_WORDS, CACHE_PLACES = 450_000, 1 << 20


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True


def _longer(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """An array whose first `used` items stay, with more behind them and, if it had to grow, some room."""
    if used + len(more) > len(held):
        held = np.concatenate([held[:used], np.empty(len(more) + used // 4, held.dtype)])
    held[used : used + len(more)] = more
    return held


class Words:
    """Numbered words with their bytes and ids, all in arrays: a fraction of what a dict of them takes. Found by hash, compared by bytes."""

    def __init__(self) -> None:
        self.place, self.slot, self.placed = np.zeros(CACHE_PLACES, np.uint64), np.zeros(CACHE_PLACES, np.int32), 0
        self.ids, self.text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.begin, self.at, self.n = np.zeros(1, np.int64), np.zeros(1, np.int64), 0  # of ids and bytes

    def find(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Numbers of the spans with these hashes; -1: not known."""
        h = h | np.uint64(1)
        number, left, at = np.full(len(h), -1), np.arange(len(h)), (h % np.uint64(CACHE_PLACES)).astype(np.int64)
        while len(left):
            there = self.place[at]
            hit = there == h[left]
            number[left[hit]] = self.slot[at[hit]]
            on = (there != 0) & ~hit
            left, at = left[on], (at[on] + 1) % CACHE_PLACES
        known = np.flatnonzero(number >= 0)
        own, length = self.at[number[known]], (stops - starts)[known]
        same = self.at[number[known] + 1] - own == length
        number[known[~same]] = -1
        known, own, length = known[same], own[same], length[same]
        if len(known):  # no word is empty
            offset = flat(np.zeros(len(known), np.int64), length)
            equal = self.text[np.repeat(own, length) + offset] == data[np.repeat(starts[known], length) + offset]
            number[known[~np.logical_and.reduceat(equal, np.cumsum(length) - length)]] = -1
        return number

    def add(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers for new spans with their ids. Beyond three quarters of the places, and if a hash is taken, a number is not found again."""
        number, size = self.n + np.arange(len(h)), stops - starts
        self.ids, self.text = _longer(self.ids, self.begin[self.n], ids), _longer(self.text, self.at[self.n], data[flat(starts, size)])
        self.begin = _longer(self.begin, self.n + 1, self.begin[self.n] + np.cumsum(lengths))
        self.at = _longer(self.at, self.n + 1, self.at[self.n] + np.cumsum(size))
        self.n += len(h)
        h, first = np.unique(h | np.uint64(1), return_index=True)
        h, left = h[: (room := max(0, 3 * CACHE_PLACES // 4 - self.placed))], number[first][:room]
        at = (h % np.uint64(CACHE_PLACES)).astype(np.int64)
        while len(left):
            there = self.place[at]
            free = np.flatnonzero(there == 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.place[at[free]], self.slot[at[free]] = h[free], left[free]
            self.placed += len(free)
            on = there != h
            on[free] = False
            h, left, at = h[on], left[on], (at[on] + 1) % CACHE_PLACES
        return number


class WordEncoding:
    """A tokenizer file that never joins across ASCII white space, nor a letter with a mark; with a cache of words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = Words()
        self.marks: dict[str, list[int]] = {}

    def _whole(self, text: str) -> list[int]:
        """Through the whole tokenizer; runs of marks are few and stay known."""
        if (ids := self.marks.get(text)) is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            if len(text) <= 8 and len(self.marks) < 100_000:
                self.marks[text] = ids
        return ids

    def _ids(self, word: bytes) -> list[int]:
        """A word of lower-case letters needs no more than the merges, with or without a run of marks behind it."""
        text = word.decode()
        stem = text.rstrip("!#$%&*,.:;<>?|")
        if stem.isalpha() and stem.islower() and (stem.isascii() or unicodedata.is_normalized("NFC", stem)):
            ids = [t.id for t in self.model.tokenize(stem.encode().decode("latin-1").translate(_LETTERS))]
            return ids if len(stem) == len(text) else ids + self._whole(text[len(stem) :])
        return self._whole(text)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's first id."""
        lower = _LOWER[data]
        starts, stops, bounds = words(lower, off)
        cut = np.flatnonzero(_MARK[lower[stops - 1]] & (stops - starts > 1))
        cut = cut[_ASCII_LETTER[lower[stops[cut] - 2]]]
        marks = stops[cut] - 1  # a mark behind an ASCII letter is a part of its own
        more = np.zeros(len(starts) + 1, np.int64)
        more[cut + 1] = 1
        bounds = bounds + np.cumsum(more)[bounds]
        stops = np.insert(stops, cut, marks)
        starts = np.insert(starts, cut + 1, marks)
        if self.cache.n > CACHE_WORDS:
            self.cache = Words()
        h, raw = span_hashes(lower, starts, stops), lower.tobytes()
        first, same = distinct_spans(lower, starts, stops, h)
        h, a, b = h[first], starts[first], stops[first]
        numbers = self.cache.find(h, lower, a, b)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            h, a, b = h[new], a[new], b[new]
            found = [self._ids(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            numbers[new] = self.cache.add(h, lower, a, b, np.fromiter(itertools.chain.from_iterable(found), np.uint32, counts.sum()), counts)
        numbers = numbers[same]
        at = self.cache.begin[numbers]
        lengths = self.cache.begin[numbers + 1] - at
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids, begin = self.cache.ids[flat(at, lengths)], total[bounds]
        if any(s in raw for s in self.special):  # the library treats their strings apart: encode such texts whole
            o, body, parts = off.tolist(), data.tobytes(), np.split(ids, begin[1:-1])
            for i, (a, b) in enumerate(zip(o, o[1:], strict=False)):
                if any(s in raw[a:b] for s in self.special):
                    parts[i] = np.array(self.tokenizer.encode(body[a:b].decode(), add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids.astype(np.uint32), begin


@lru_cache(4)
def load(path: str) -> WordEncoding:
    """The encoding of a tokenizer file, once per worker."""
    return WordEncoding(path)


def measured(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, n (ids with the end id) and crcs: for each window of the document and for its rest, the CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in pieces(batches):
            ids, starts = encoding.encode(*buffers(batch.column("text")))
            raw, s = ids.astype("<u4").tobytes(), (4 * starts).tolist()
            crcs = []
            for a, b in zip(s, s[1:], strict=False):
                body = raw[a:b] + end
                crcs.append([zlib.crc32(body[i : i + 4 * window]) for i in range(0, len(body), 4 * window)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(starts) + 1), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "n", "crcs"])

    return docs.select("doc_id", "text").transform(arrow_map, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, crcs array<bigint>")


def combinations(have: np.ndarray, window: int) -> np.ndarray:
    """Twos and threes of present lengths that fill a window exactly, ascending; rows padded with 0.

    have: counts by length. Of the threes those whose first two parts are equal, neighbours or stand at a few
    spacings are taken: about 20 for each length, which lets any histogram be met closely without window**2 columns.
    """
    lengths = np.flatnonzero(have)
    twos = lengths[(lengths <= window // 2) & (have[window - lengths] > 0)]
    rows = [np.stack([np.zeros_like(twos), twos, window - twos], axis=1)]
    for step in (0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610):
        b = lengths + step
        c = window - lengths - b
        ok = (c > 0) & (b < window)
        a, b, c = lengths[ok], b[ok], c[ok]
        ok = (have[b] > 0) & (have[c] > 0)
        rows.append(np.sort(np.stack([a[ok], b[ok], c[ok]], axis=1), axis=1))
    return np.unique(np.concatenate(rows), axis=0) if len(lengths) else np.zeros((0, 3), np.int64)


def repeats(combos: np.ndarray, have: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared difference between the lengths used and the histogram.

    Accelerated projected gradient: the matrix has up to three ones a column, so a product is a bincount or a gather.
    """
    if not len(combos):
        return np.zeros(0)
    size = len(have)
    used = lambda x: sum(np.bincount(combos[:, k], x, size) for k in range(3)) * (np.arange(size) > 0)
    back = lambda r: sum(np.where(combos[:, k] > 0, r[combos[:, k]], 0) for k in range(3))
    v = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(used(y) - have) / (1.05 * top))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def plan(have: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Where the k-th rest of each length goes, and the number of sequences.

    have: counts of rests by length, have[0] = 0. Returned rows (length, first rank, ranks, first sequence, copies in
    a sequence, offset) cover the ranks 0 .. have[length] - 1 of each length without gaps.
    """
    have = have.astype(np.int64).copy()
    patterns: list[tuple[list[int], int]] = []
    combos = combinations(have, window)
    x = np.floor(repeats(combos, have.astype(float)) + 1e-6).astype(np.int64)
    for k in np.argsort(-x, kind="stable").tolist():  # no more than there are
        if x[k] <= 0:
            break
        parts = [int(p) for p in combos[k] if p]
        times = min(x[k], *(have[p] // parts.count(p) for p in parts))
        if times > 0:
            for p in parts:
                have[p] -= times
            patterns.append((sorted(parts, reverse=True), int(times)))
    while len(left := np.flatnonzero(have)):
        parts, room, free = [], window, have.copy()
        while room and len(fit := np.flatnonzero(free[: room + 1])):
            p = int(fit[-1])
            many = int(min(free[p], room // p))
            parts += [p] * many
            free[p] -= many
            room -= many * p
        times = int(min(have[p] // parts.count(p) for p in set(parts)))
        for p in set(parts):
            have[p] -= times * parts.count(p)
        patterns.append((parts, times))
    rows, sequences, ranks = [], 0, np.zeros(len(have), np.int64)
    for parts, times in patterns:
        offset = 0
        for p in dict.fromkeys(parts):
            copies = parts.count(p)
            rows.append((p, ranks[p], copies * times, sequences, copies, offset))
            ranks[p] += copies * times
            offset += copies * p
        sequences += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6), sequences


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    sizes = materialize(measured(docs, path, window, end_id), "packing").withColumn("rest", (F.col("n") % window).cast("int"))
    counted = sizes.groupBy("rest").agg(F.count("*").alias("rows")).collect()  # at most `window` rows
    have = np.zeros(window + 1, np.int64)
    for r in counted:
        have[r["rest"]] = r["rows"]
    buckets = max(8, int(have.sum()) // BUCKET_ROWS)
    have[0] = 0
    table, sequences = plan(have, window)
    key = F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(buckets)).cast("int").alias("bucket")
    sizes = sizes.select("*", key, F.floor(F.col("n") / window).alias("whole"))

    # Ranks: counts by bucket and length give each bucket its first rank; inside a bucket rows are numbered in order of id.
    by_length = sizes.groupBy("rest", "bucket").agg(F.count("*").alias("rows"), F.sum("whole").alias("whole"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = by_length.select("rest", "bucket", F.coalesce(F.sum("rows").over(before.partitionBy("rest")), F.lit(0)).alias("first_rank"))
    wholes = by_length.groupBy("bucket").agg(F.sum("whole").alias("w")).select("bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("first_whole"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("crcs")]
    inside = Window.partitionBy("bucket").orderBy("rest", *order)
    ranked = sizes.withColumns({
        "rank": F.row_number().over(Window.partitionBy("bucket", "rest").orderBy(*order)) - 1,
        "wholes": F.coalesce(F.sum("whole").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    placed = ranked.join(first, ["rest", "bucket"]).join(wholes, "bucket").select(
        "doc_id", "n", "crcs", "rest", (F.col("rank") + F.col("first_rank")).alias("rank"), (F.col("wholes") + F.col("first_whole") + sequences).alias("own"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(1) << 40  # above any rank: (length, rank) as one sorted number
        keys = table[:, 0] * span + table[:, 1] if len(table) else np.zeros(0, np.int64)
        for batch in batches:
            n, rest, rank, own = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("n", "rest", "rank", "own"))
            parts = -(-n // window)
            row = np.repeat(np.arange(len(n)), parts)
            k = flat(np.zeros(len(n), np.int64), parts)
            last = (k == parts[row] - 1) & (rest[row] > 0)
            sequence, offset = own[row] + k, np.zeros(len(row), np.int64)
            if last.any():
                mine = row[last]
                hit = table[np.searchsorted(keys, rest[mine] * span + rank[mine], "right") - 1]
                nth = rank[mine] - hit[:, 1]
                sequence[last] = hit[:, 3] + nth // hit[:, 4]
                offset[last] = hit[:, 5] + nth % hit[:, 4] * rest[mine]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row)), pa.array(k * window), pa.array(np.where(last, rest[row], window)),
                batch.column("crcs").flatten(), pa.array(n[row]), pa.array(sequence), pa.array(offset),
            ], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    names = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return placed.transform(arrow_map, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {names}")
