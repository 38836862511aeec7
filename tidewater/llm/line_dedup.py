"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact Jaccard, and one kept line per component.

Lines are what "\\n" separates; a line's shingles are its runs of five characters (a shorter line is one shingle).
One pass hashes every line and keeps, of each, the smallest shingle hash in 32 bins (empty bins borrow from the next
full one); eight bands of four bins each have a recall of 0.985 at a similarity of 0.8 and 0.999 at 0.87. Lines that
share a band are candidates unless their set sizes or parities exclude a similarity of 0.8. Parities say for each of
256 places or more, by the set's size, whether an odd number of its hashes fall there: two sets differ in no fewer
hashes than their parities in places, so neither test loses a link.

Candidates are verified by the Jaccard similarity of their shingle sets (0.8 or more), in two rounds. First, each line
of a band meets the first one in order of size that its parities allow: fewer pairs than lines, which join most
copies. Then all pairs of a band meet whose lines are still in different components. In a band of very many lines those
outside its largest component ask all others, in blocks. So no link of two lines that share a band is lost, and copies
that are joined already make no pairs, nor do two lines that the first round has compared. Only lines with a candidate
are read again, by their hashes, from the documents, once for both rounds.
Linked lines and exact repeats form components by distributed union-find. Of a component only the first line, by
(doc_id, position), stays; a line that repeats within a text goes at once.

Bands travel packed, many to a row, in groups by their high bits, each with its line's size and its parities in 256 places:
where a band has few lines, those with none near leave before any join. The tables with bands and parities go when those of
shared bands are there.

Lines without a visible character are never compared and always stay. Null and empty texts stay as they are, and so
do rows without an id. A very long line is a task's piece of its own. Rows that repeat an id are alike if their texts
are equal: a line stays in each of them if it stays in one; rows of one id with different texts are judged each on
its own. Lines whose 64-bit hashes collide are compared as one of them only (the other stays). A document that had
words and is left with no line is dropped by `filter_documents`. An empty table gives no rows; extra columns pass
through, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, PIECE_BYTES, arrow_map, broadcast_if_small, buffers, discard, flat, free_name, key_groups, keyed, materialize, mix64, packed, pieces, span_hashes
from .graph import components

SHINGLE = 5
BINS, ROWS = 32, 4
BANDS = BINS // ROWS
#: Words of a line's parities, as powers of two: the least, the most, and hashes of a set for each word (of 64 places).
LEAST_WORDS, MOST_WORDS, PER_WORD = 2, 10, 84
#: Lines of a band, and shingles of its lines, that one task holds at a time (twice as many where two blocks meet).
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Lines of a band up to which those without a near one go before any join.
FEW = 64
#: Pairs that are verified in one numpy step, and candidates of a group that are held.
STEP, HELD = 1 << 14, 1 << 20

_rng = np.random.Generator(np.random.PCG64(99))
_TURN = _rng.integers(1, 1 << 62, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = [f"b{k}" for k in range(BANDS)]
#: A line and its bands, as they travel; its mark is its parities in the least words.
_SENT = np.dtype([("line", "<i8"), ("bands", "<i8", BANDS), ("size", "<i8"), ("mark", "<u8", 1 << LEAST_WORDS)])
_MARK = np.dtype((np.void, 8 << LEAST_WORDS))


def _byte_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts with "\\n" between them, begin and end of each line in it, and the number of each line's text."""
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    at = np.flatnonzero(data == 10)
    per_text = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    return data, np.append(0, at + 1), np.append(at, len(data)), np.repeat(np.arange(len(texts)), per_text)


def _code_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with "\\n" between them, begin and end of each line in them."""
    code = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    breaks = np.flatnonzero(code == 10)
    return code, np.append(0, breaks + 1), np.append(breaks, len(code))


def _shingles(code: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the spans' shingles, one span after the other, and how many each has. Spans ascend, with a code point or more between them."""
    number = np.maximum(stops - starts - SHINGLE + 1, np.minimum(1, stops - starts))
    padded = np.append(code, np.zeros(SHINGLE, np.uint32)).astype(np.uint64)
    every = np.empty(len(code), np.uint64)
    for low in range(0, len(code), 1 << 15):  # so much of all arrays stays in a cache
        high = min(len(code), low + (1 << 15))
        part = padded[low:high] * _TURN[0]
        for k in range(1, SHINGLE):
            part += padded[low + k : high + k] * _TURN[k]
        every[low:high] = part
    edge = np.zeros(len(code) + 1, np.int8)  # spans ascend and do not meet, so a running sum says what lies in one
    some = number > 0
    edge[starts[some]] = 1
    edge[(starts + number)[some]] -= 1
    value = every[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    short = np.flatnonzero((stops - starts < SHINGLE) & (number > 0))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE):
            own += np.where(starts[short] + k < stops[short], padded[starts[short] + k] + np.uint64(1 << 32), 0).astype(np.uint64) * _TURN[k]
        value[(np.cumsum(number) - number)[short]] = own
    for low in range(0, len(value), 1 << 15):
        value[low : low + (1 << 15)] = mix64(value[low : low + (1 << 15)])
    return value, number


def _level(size: np.ndarray) -> np.ndarray:
    """Logarithm of how many words the parities of a set have; linked sets are one level apart at most."""
    return np.clip(np.ceil(np.log2(np.maximum(size, 1) / PER_WORD)), LEAST_WORDS, MOST_WORDS).astype(np.int64)


def _parities(row: np.ndarray, value: np.ndarray, bits: int, level: np.ndarray) -> np.ndarray:
    """Words of all rows' parities, one row after the other: the high ones of a value's `bits` name a word of its row, the low six a place. Rows and values ascend."""
    begin = np.cumsum(1 << level) - (1 << level)
    word = begin[row] + (value >> (bits - level[row]).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int((1 << level).sum()), np.uint64)
    if len(word):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[first]] = np.bitwise_xor.reduceat(np.uint64(1) << (value & np.uint64(63)), first)
    return out


class Parities:
    """Parities of rows, to be compared by pairs: the longer of two is folded to half its words."""

    def __init__(self, words: np.ndarray, level: np.ndarray) -> None:
        self.level, begin = level, np.cumsum(1 << level) - (1 << level)
        self.tables: dict[int, np.ndarray] = {}
        self.at = np.zeros((2, len(level)), np.int64)  # where a row stands in the table of its level, and of the next lower
        for k in np.unique(level).tolist():
            rows = np.flatnonzero(level == k)
            own = words[flat(begin[rows], np.full(len(rows), 1 << k))].reshape(-1, 1 << k)
            below = self.tables.get(k - 1, np.zeros((0, 1 << (k - 1)), np.uint64))
            self.at[0, rows], self.at[1, rows] = np.arange(len(rows)), len(below) + np.arange(len(rows))
            self.tables[k - 1], self.tables[k] = np.concatenate([below, own[:, ::2] ^ own[:, 1::2]]), own

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many places rows x and y differ; their levels are one apart at most."""
        level, out = np.minimum(self.level[x], self.level[y]), np.zeros(len(x), np.int64)
        for k in np.unique(level).tolist():
            for at in np.array_split(here := np.flatnonzero(level == k), 1 + (len(here) << k >> 20)):
                a, b = (self.at[(self.level[v] > k).astype(np.int64), v] for v in (x[at], y[at]))
                out[at] = np.bitwise_count(self.tables[k][a] ^ self.tables[k][b]).sum(1, dtype=np.int64)
        return out

    def near(self, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether rows x and y may be linked: at a similarity of 0.8, sets differ in a ninth of their sizes' sum."""
        out = _alike(size, x, y)
        at = np.flatnonzero(out)
        out[at] = 9 * self.differ(x[at], y[at]) <= size[x[at]] + size[y[at]]
        return out


def signatures(value: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band hashes (spans x bands), words of parities and set size of each span from its shingles; every span has one at least."""
    n = len(number)
    size, parity, out = np.zeros(n, np.int64), [np.zeros(0, np.uint64)], np.zeros((n, BANDS), np.int64)
    ends = np.cumsum(number)
    low = done = 0
    while low < n:  # the number of a span must fit beside its hashes, and the arrays into a cache
        high = min(n, low + (1 << 20), max(low + 1, int(np.searchsorted(ends, done + (1 << 17), "right"))))
        count = number[low:high]
        own = value[done : int(ends[high - 1])]
        done = int(ends[high - 1])
        key = np.sort(np.repeat(np.arange(high - low, dtype=np.uint64) << np.uint64(42), count) | own >> np.uint64(22))
        key = key[np.append(True, key[1:] != key[:-1])]
        cell = (key >> np.uint64(37)).astype(np.int64)  # span and bin
        size[low:high] = np.bincount(cell >> 5, minlength=high - low)
        parity.append(_parities(cell >> 5, key & np.uint64((1 << 42) - 1), 42, _level(size[low:high])))
        least = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        minima = np.full((high - low) * BINS, -1, np.int64)
        minima[cell[least]] = (key[least] & np.uint64((1 << 37) - 1)).astype(np.int64)
        minima = minima.reshape(-1, BINS)
        holes = np.flatnonzero((minima < 0).any(1))
        if len(holes):
            have, filled = minima[holes], minima[holes].copy()
            for step in range(1, BINS):
                empty = filled < 0
                if not empty.any():
                    break
                lent = np.roll(have, -step, axis=1)
                filled = np.where(empty & (lent >= 0), lent + (step << 37), filled)
            minima[holes] = filled
        joint = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], high - low, axis=0)
        grouped = minima.astype(np.uint64).reshape(-1, BANDS, ROWS)
        for r in range(ROWS):
            joint = mix64(joint * np.uint64(31) + grouped[:, :, r])
        out[low:high] = joint.view(np.int64)
        low = high
    return out, np.concatenate(parity), size


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, limit=PIECE_BYTES // 2):
        texts = batch.column("text").to_pylist()
        data, begins, ends, doc = _byte_lines(texts)
        code, starts, stops = _code_lines(texts)
        position = np.arange(len(doc)) - np.searchsorted(doc, doc)
        seen = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data > 32) & (data != 127), out=seen[1:])
        full = np.flatnonzero(seen[ends] > seen[begins])
        h1 = span_hashes(data, begins[full], ends[full])
        own = np.zeros(len(full), bool)  # not yet in the same text
        own[np.unique(keyed(doc[full], h1), return_index=True)[1]] = True
        once = np.sort(np.unique(h1, return_index=True)[1])  # a line's bands once in a piece
        value, number = _shingles(code, starts[full[once]], stops[full[once]])
        bands, parity, size = signatures(value, number)
        place = np.zeros(len(full), np.int64)
        place[once] = np.arange(len(once))
        rest = np.ones(len(full), bool)
        rest[once] = False
        wide = lambda v: pa.array(v[place] if len(v) else np.zeros(len(full), v.dtype), mask=rest)
        words = np.concatenate([[0], np.cumsum(8 << _level(size))]).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(once), [None, pa.py_buffer(words), pa.py_buffer(parity)])
        h2 = span_hashes(data[::-1], len(data) - ends[full], len(data) - begins[full])
        yield pa.RecordBatch.from_arrays([
            *(batch.column(k).take(pa.array(doc[full])) for k in ("doc_id", "tkey")), pa.array(position[full].astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(~own), wide(size),
            *(wide(bands[:, k]) for k in range(BANDS)), blobs.take(pa.array(place, mask=rest)),
        ], names=["doc_id", "tkey", "pos", "h1", "h2", "again", "size", *_BAND, "parity"])


def _folded(words: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Parities of all rows in the least words, rows x words: two rows differ in no more places than before."""
    step = np.repeat(1 << (level - LEAST_WORDS), 1 << LEAST_WORDS)
    return np.bitwise_xor.reduceat(words, np.cumsum(step) - step).reshape(-1, 1 << LEAST_WORDS) if len(step) else np.zeros((0, 1 << LEAST_WORDS), np.uint64)


def _travelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_measure` with all bands of a batch packed into its first row."""
    for batch in batches:
        once = batch.filter(batch.column("size").is_valid())
        sent = np.empty(once.num_rows, _SENT)
        sent["line"], sent["size"] = once.column("h1").to_numpy(), once.column("size").to_numpy()
        for k, name in enumerate(_BAND):
            sent["bands"][:, k] = once.column(name).to_numpy()
        sent["mark"] = _folded(buffers(once.column("parity"))[0].view(np.uint64), _level(sent["size"]))
        rest = batch.drop_columns(_BAND)
        first = pa.array([sent.tobytes(), *[None] * (batch.num_rows - 1)][: batch.num_rows], pa.binary())
        yield rest.append_column("bands", first)


def _keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (a hash of the text: it tells rows of one id apart) and text of rows that have lines to compare."""
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")


def measured(docs: DataFrame, travelling: bool = False) -> DataFrame:
    """A row for every line with a visible character: doc_id, tkey, pos, two hashes, again (a repeat in its text), and size, bands and parities.

    These last are null where the same line just went by. travelling: the bands of many lines are packed in the `bands` of one row.
    """
    places, numbers = "doc_id bigint, tkey bigint, pos int, h1 bigint, h2 bigint, again boolean, size bigint", ", ".join(f"{k} bigint" for k in _BAND)
    if travelling:
        return _keyed_texts(docs).transform(arrow_map, lambda b: _travelling(_measure(b)), f"{places}, parity binary, bands binary")
    return _keyed_texts(docs).transform(arrow_map, _measure, f"{places}, {numbers}, parity binary")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row of each line: h1, h2, how many texts have it (n) and the smallest doc_id."""
    return lines.where("not again").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))


def _alike(size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the set sizes of rows i and j allow a similarity of 0.8."""
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    return 100 * small.astype(np.int64) >= 80 * large.astype(np.int64)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line, with its bands, size and mark, of what `_travelling` packed."""
    for batch in batches:
        for blob in batch.column("bands"):
            sent = np.frombuffer(blob.as_buffer(), _SENT)
            mark = np.ascontiguousarray(sent["mark"])
            marks = pa.Array.from_buffers(pa.binary(_MARK.itemsize), len(sent), [None, pa.py_buffer(mark)])
            columns = [np.ascontiguousarray(v) for v in (sent["line"], *sent["bands"].T, sent["size"])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), marks], names=["line", *_BAND, "size", "mark"])


def _bands(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Bands and their lines (with sizes and marks, if there), of half of HELD at a time, packed by groups of bands."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            size += BANDS * batch.num_rows
        if 2 * size >= HELD or (batch is None and size):
            t = pa.Table.from_batches(held).combine_chunks()
            band = np.concatenate([t.column(k).to_numpy() for k in _BAND]).view(np.uint64)
            order = np.argsort(band)
            row = order % t.num_rows
            more = {"bands": band[order], "lines": t.column("line").to_numpy()[row]}
            if "mark" in t.column_names:
                more |= {"sizes": t.column("size").to_numpy()[row], "marks": np.frombuffer(t.column("mark").chunk(0).buffers()[1], _MARK)[row]}
            yield packed(more["bands"], more, groups)
            held, size = [], 0


def _first(v: np.ndarray) -> np.ndarray:
    """Which items differ from the one before."""
    return np.append(True, v[1:] != v[:-1])[: len(v)]


def _near_in_band(band: np.ndarray, size: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Which rows have a near one in their band, by sizes and marks; in a band of over FEW lines all. Bands ascend."""
    out = np.zeros(len(band), bool)
    group = np.cumsum(_first(band))
    many = np.bincount(group)[group] > FEW
    out[many] = True
    at = np.flatnonzero(~many)
    at = at[np.lexsort([size[at], group[at]])]
    own = size[at]
    parity = Parities(np.frombuffer(mark[at].tobytes(), np.uint64), np.full(len(at), LEAST_WORDS))
    for x, y in _steps(group[at], lambda x, y: parity.near(own, x, y), own):
        out[at[x]] = out[at[y]] = True
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed rows in order of their group: rows of bands with two lines or more; if they have marks, of lines with a near one.

    Of a large group they leave as soon as the band is known to be shared, near or not, so that a line may leave more than once.
    """
    now, held, size, known = None, [], 0, np.zeros(0, np.int64)  # known: bands of the group that are shared
    whole = True  # all of the group is held

    def settled(rest: bool) -> tuple[pa.RecordBatch, np.ndarray, tuple[np.ndarray, ...]]:
        rows = [np.concatenate(v) for v in zip(*held, strict=True)] if held else [known, known]
        band, line, *more = rows
        order = np.argsort(band)
        first = _first(band[order])
        alone = first & np.append(first[1:], True)[: len(first)] & ~np.isin(band[order], known)
        at = order[~alone]
        at = at[np.lexsort([line[at], band[at]])]
        at = at[_first(band[at]) | _first(line[at])]  # each line once in a band
        first = _first(band[at])
        keep = ~(first & np.append(first[1:], True)[: len(first)]) | np.isin(band[at], known)
        sent, seen = at[keep], np.union1d(known, band[at[keep]])
        left = np.append(order[alone], at[~keep]) if rest else at[:0]
        if more and whole:
            sent = sent[_near_in_band(band[sent], *(v[sent] for v in more))]
        return pa.RecordBatch.from_arrays([pa.array(band[sent]), pa.array(line[sent])], names=["band", "line"]), seen, tuple(v[left] for v in rows)

    for batch in batches:
        names = [k for k in ("bands", "lines", "sizes", "marks") if k in batch.schema.names]
        for k, *blobs in zip(batch.column("dealt").to_pylist(), *(batch.column(n) for n in names), strict=True):
            if k != now or size > HELD:
                whole = whole and k != now
                out, known, rest = settled(k == now)
                yield out
                held, known = ([rest], known) if k == now else ([], known[:0])
                whole, now, size = k != now, k, 0
            held.append(tuple(np.frombuffer(x.as_buffer(), _MARK if n == "marks" else np.int64) for n, x in zip(names, blobs, strict=True)))
            size += len(held[-1][0])
    yield settled(False)[0]


def shared(lines: DataFrame) -> DataFrame:
    """Rows (band, line) of bands that two different lines or more share, which may be near. Bands travel packed, many to a row; lines: `measured` so."""
    groups = key_groups(lines.sparkSession)
    kinds = ", ".join(f"{k} binary" for k in ("bands", "lines", "sizes", "marks"))
    rows = lines.where("bands is not null").select("bands").transform(arrow_map, lambda b: _bands(_opened(b), groups), f"dealt int, {kinds}")
    return rows.repartition("dealt").sortWithinPartitions("dealt").transform(arrow_map, _shared, "band bigint, line bigint")


def _mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (band, line, size, parity) in order of (band, size, line): rows with a near one in their band, beside the first such line.

    Of a band of over BLOCK lines or BLOCK_SHINGLES shingles all rows are returned, each beside the band's first line if
    that is near.
    """

    def narrow(t: pa.Table) -> pa.RecordBatch:
        band, line, size = _numbers(t, ["band", "line", "size"])
        parity = Parities(buffers(t.column("parity"))[0].view(np.uint64), _level(size))
        near, first = np.zeros(len(band), bool), np.full(len(band), -1)
        for x, y in _steps(np.cumsum(np.append(False, band[1:] != band[:-1])), lambda x, y: parity.near(size, x, y), size):
            near[x] = near[y] = True
            first[y] = x  # a farther one comes later and takes its place
        alone = first[near] < 0
        return pa.RecordBatch.from_arrays([pa.array(band[near]), pa.array(line[near]), pa.array(line[np.maximum(first[near], 0)], mask=alone)], names=["band", "line", "first"])

    def wide(t: pa.Table, head: pa.Table) -> pa.RecordBatch:
        whole = pa.concat_tables([head, t])
        size = _numbers(whole, ["size"])[0]
        ok = Parities(buffers(whole.column("parity"))[0].view(np.uint64), _level(size)).near(size, np.zeros(t.num_rows, np.int64), np.arange(1, t.num_rows + 1))
        line = head.column("line")[0].as_py()
        ok &= t.column("line").to_numpy() != line
        return pa.RecordBatch.from_arrays([t.column("band").combine_chunks(), t.column("line").combine_chunks(), pa.array(np.full(t.num_rows, line), mask=~ok)], names=["band", "line", "first"])

    held: list[pa.Table] = []  # rows of the last band, as long as it is narrow
    head, rows, shingles = None, 0, 0  # the first row of a wide band
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        band, size = t.column("band").to_numpy(), t.column("size").to_numpy()
        last = head if head is not None else held[-1] if held else None
        if last is not None and last.column("band")[-1].as_py() != band[0]:
            if held:
                yield narrow(pa.concat_tables(held))
            held, head, rows, shingles = [], None, 0, 0
        if head is not None:
            stop = int(np.searchsorted(band, band[0], "right"))
            yield wide(t.slice(0, stop), head)
            t, band, size = t.slice(stop), band[stop:], size[stop:]
            if not t.num_rows:
                continue
            head = None
        begin = int(np.searchsorted(band, band[-1]))  # where the last band begins
        if begin:
            yield narrow(pa.concat_tables([*held, t.slice(0, begin)]))
            held, rows, shingles = [], 0, 0
        held.append(t.slice(begin))
        rows, shingles = rows + t.num_rows - begin, shingles + int(size[begin:].sum())
        if rows > BLOCK or shingles > BLOCK_SHINGLES:
            whole = pa.concat_tables(held)
            head = whole.slice(0, 1)
            yield wide(whole, head)
            held, rows, shingles = [], 0, 0
    if held:
        yield narrow(pa.concat_tables(held))


def mates(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Rows (band, line, first) of `shared` that have a near line in their band; info has sizes and parities of lines."""
    beside = rows.join(info.select("line", "size", "parity"), "line").select("band", "line", "size", "parity")
    return beside.repartition("band").sortWithinPartitions("band", "size", "line").transform(arrow_map, _mates, "band bigint, line bigint, first bigint")


def _may(component: np.ndarray, side: np.ndarray, line: np.ndarray, first: np.ndarray, size: np.ndarray, parity: Parities) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which rows (x, y) of a group are to be compared: of two components and sides, not compared by the first round, and near."""

    def ok(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = (component[x] != component[y]) & ((side[x] != side[y]) | (side[x] < 0)) & (line[x] != first[y]) & (line[y] != first[x])
        at = np.flatnonzero(out)
        out[at] = parity.near(size, x[at], y[at])
        return out

    return ok


def _steps(group: np.ndarray, ok: Callable[[np.ndarray, np.ndarray], np.ndarray], size: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows (x < y) of equal group, one distance after the other, that `ok(x, y)` lets pass; groups are ascending."""
    left, step = np.arange(len(group)), 0
    while len(left):
        step += 1
        left = left[left + step < len(group)]
        left = left[group[left + step] == group[left]]
        if size is not None:  # sizes ascend in a group: if one is too large, so are all after it
            left = left[100 * size[left] >= 80 * size[left + step]]
        keep = ok(left, left + step)
        yield left[keep], (left + step)[keep]


_PLACE = ["band", "i", "j"]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from rows in order of (band, i, j)."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        key = [t.column(k).to_numpy() for k in _PLACE]
        ends = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in key]))
        if held and any(held[-1].column(k)[-1].as_py() != v[0] for k, v in zip(_PLACE, key, strict=True)):
            yield pa.concat_tables(held)
            held = []
        if len(ends):
            cut = int(ends[-1]) + 1
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held, t = [], t.slice(cut)
        held.append(t)
    if held:
        yield pa.concat_tables(held)


def _numbers(t: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [t.column(k).to_numpy().astype(np.int64) for k in names]


def _group_of(band: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.cumsum(np.append(False, (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (band, i, j, size): lines with a near one of another component, and of the other side if there are sides, in their group."""
    for t in _whole(batches):
        band, i, j, side, component, line, first, size = _numbers(t, [*_PLACE, "side", "component", "line", "first", "size"])
        parity = Parities(buffers(t.column("parity"))[0].view(np.uint64), _level(size))
        met = np.zeros(len(band), bool)
        for x, y in _steps(_group_of(band, i, j), _may(component, side, line, first, size, parity), size):
            met[x] = met[y] = True
        yield pa.RecordBatch.from_arrays([pa.array(v[met]) for v in (band, i, j, side, component, line, first)], names=[*_PLACE, "side", "component", "line", "first"])


def crossing(rows: DataFrame, info: DataFrame, parts: DataFrame) -> DataFrame:
    """Groups of the second round, from rows of `mates`: band, i, j, and lines near to one of another component (side, component, line, first).

    first is the line that the first round compared a line with, or itself: the two are not compared again.

    Only bands of two components or more are dealt out. In a band of very many lines those outside its largest
    component ask all others: blocks i of asking lines (side 1) meet blocks j of all lines (side 0).
    """
    placed = rows.select("band", "line", F.coalesce("first", "line").alias("first")).join(parts.withColumnRenamed("node", "line"), "line", "left").withColumn("component", F.coalesce("component", "line"))
    placed = materialize(placed, "placed-lines")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    line = ["component", "line", "first", "size", "parity"]
    placed = materialize(placed.join(mixed, "band").join(info.select("line", "size", "parity"), "line"), "mixed-lines")
    mixed = placed.groupBy("band").agg(blocks(F.count("*"), F.sum("size")).alias("blocks"))
    mixed = materialize(mixed, "mixed-bands")
    placed = placed.join(mixed, "band")
    dealt = placed.where("blocks = 1").select("band", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side"), *line)
    wide = mixed.where("blocks > 1")
    if not wide.isEmpty():
        held = materialize(placed.where("blocks > 1"), "wide-bands")
        each = held.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        most = each.groupBy("band").agg(F.max(F.struct("n", "component", "s")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s"))
        asking = blocks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s"))
        held = held.join(materialize(most.select("band", F.col("most.component").alias("major"), asking.alias("asking")), "majors"), "band")
        own = lambda n: F.pmod(F.xxhash64("line"), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = dealt.unionByName(held.select("band", upto("asking").alias("i"), own("blocks").alias("j"), F.lit(0).alias("side"), *line))
        dealt = dealt.unionByName(held.where("component <> major").select("band", own("asking").alias("i"), upto("blocks").alias("j"), F.lit(1).alias("side"), *line))
    return dealt.repartition(*_PLACE).sortWithinPartitions(*_PLACE, "size", "line").transform(arrow_map, _crossed, "band bigint, i bigint, j bigint, side bigint, component bigint, line bigint, first bigint")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each text whose hashes it is asked for."""
    for batch in pieces(batches):
        data, begins, ends, doc = _byte_lines(batch.column("text").to_pylist())
        h = span_hashes(data, begins, ends)
        asked = batch.column("asked")
        wanted = keyed(np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy())), asked.flatten().to_numpy().view(np.uint64))
        key = keyed(doc, h)
        first = np.sort(np.unique(key, return_index=True)[1])
        hit = first[np.isin(key[first], wanted)]
        length = ends[hit] - begins[hit]
        off = np.concatenate([[0], np.cumsum(length)])
        body = data[flat(begins[hit], length)]
        text = pa.Array.from_buffers(pa.large_string(), len(hit), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(body)])
        yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), text.cast(pa.string())], names=["line", "text"])


def line_texts(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """line and its text, for lines asked for (line, doc_id: a document that has it)."""
    routes = materialize(asked.groupBy("doc_id").agg(F.collect_set("line").alias("asked")), "routes")
    held = routes.agg(32 * F.count("*") + 8 * F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0]  # bytes
    found = docs.join(broadcast_if_small(routes, held, BROADCAST_BYTES), "doc_id").select("text", "asked").transform(arrow_map, _cut, "line bigint, text string")
    return found.dropDuplicates(["line"])


def _sets(texts: list[str]) -> np.ndarray:
    """Distinct shingles of each text, as number of the text << 48 | 48 bits of the hash, ascending; below 65,536 texts without line breaks."""
    code, starts, stops = _code_lines(texts)
    value, number = _shingles(code, starts, stops)
    key = np.sort(np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(48), number) | value >> np.uint64(16))
    return key[np.append(True, key[1:] != key[:-1])] if len(key) else key


_LOW = np.uint64((1 << 48) - 1)


def _linked(key: np.ndarray, begin: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets x and y (numbers of `_sets`; begin: where each begins) have a Jaccard similarity of 0.8 or more."""
    out = np.zeros(len(x), bool)
    n = np.diff(begin)
    cost = np.cumsum(n[x] + n[y])
    low = done = 0
    while low < len(x):
        high = min(len(x), low + STEP, max(low + 1, int(np.searchsorted(cost, done + (1 << 20), "right"))))
        done = int(cost[high - 1])
        a, b = x[low:high], y[low:high]
        each = np.arange(high - low, dtype=np.uint64) << np.uint64(48)
        both = np.sort(np.concatenate([np.repeat(each, n[k]) | key[flat(begin[k], n[k])] & _LOW for k in (a, b)]))
        same = both[1:][both[1:] == both[:-1]]
        overlap = np.bincount((same >> np.uint64(48)).astype(np.int64), minlength=high - low)
        out[low:high] = 100 * overlap >= 80 * (n[a] + n[b] - overlap)
        low = high
    return out


def _bounds(key: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(48))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, text, other) those of a Jaccard similarity of 0.8 or more."""
    for batch in pieces(batches):
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            n = part.num_rows
            _, first, same = np.unique(part.column("a").to_numpy(), return_index=True, return_inverse=True)  # pairs come by their a: its set is made once
            key = _sets(part.column("text").take(pa.array(first)).to_pylist() + part.column("other").to_pylist())
            ok = pa.array(_linked(key, _bounds(key, len(first) + n), same.reshape(-1), len(first) + np.arange(n)))
            yield pa.RecordBatch.from_arrays([part.column(k).filter(ok) for k in "ab"], names=["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked pairs. texts: line, text."""
    both = pairs.join(texts.select(F.col("line").alias("b"), F.col("text").alias("other")), "b").join(texts.select(F.col("line").alias("a"), "text"), "a")
    return both.select("a", "b", "text", "other").transform(arrow_map, _verified, "a bigint, b bigint")


def _group_links(group: np.ndarray, side: np.ndarray, component: np.ndarray, line: np.ndarray, first: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y) of links that join components within groups, at most one for each that goes away.

    Of the candidates between two components a few are verified at first, then twice as many, until one is a link or
    none is left.
    """
    n = len(texts)
    key = _sets(texts)
    begin = _bounds(key, n)
    size = np.diff(begin)
    row = (key >> np.uint64(48)).astype(np.int64)
    parity = Parities(_parities(row, key & _LOW, 48, _level(size)), _level(size))
    root = np.unique(component, return_inverse=True)[1]
    parent = np.arange(root.max() + 1)
    links: list[tuple[int, int]] = []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def settle(x: np.ndarray, y: np.ndarray) -> None:
        few = 1
        while len(x):
            tops = np.array([find(k) for k in range(len(parent))])
            a, b = tops[root[x]], tops[root[y]]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            pair = np.minimum(a, b) * len(parent) + np.maximum(a, b)
            order = np.argsort(pair, kind="stable")
            x, y, pair = x[order], y[order], pair[order]
            first = np.maximum.accumulate(np.where(np.append(True, pair[1:] != pair[:-1]), np.arange(len(pair)), 0)) if len(pair) else pair
            now = np.arange(len(pair)) - first < few
            for p, q in zip(x[now][ok := _linked(key, begin, x[now], y[now])].tolist(), y[now][ok].tolist(), strict=True):
                if find(root[p]) != find(root[q]):
                    parent[find(root[p])] = find(root[q])
                    links.append((p, q))
            x, y, few = x[~now], y[~now], 2 * few

    held, rows = [], 0
    for x, y in _steps(group, _may(root, side, line, first, size, parity)):
        held.append((x, y))
        rows += len(x)
        if rows > HELD:
            settle(*(np.concatenate(v) for v in zip(*held, strict=True)))
            held, rows = [], 0
    if held:
        settle(*(np.concatenate(v) for v in zip(*held, strict=True)))
    found = np.array(links, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _verified_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lines in order of (band, i, j): links of a Jaccard similarity of 0.8 or more that join components of a group."""
    for t in _whole(pieces(batches)):
        band, i, j, side, component, line, first = _numbers(t, [*_PLACE, "side", "component", "line", "first"])
        group = _group_of(band, i, j)
        at = 0
        while at < len(group):  # whole groups, of 16,384 lines or one group at a time
            to = int(np.searchsorted(group, group[at], "right"))
            to = max(to, int(np.searchsorted(group, group[min(len(group) - 1, at + STEP)], "left")) if at + STEP < len(group) else len(group))
            x, y = _group_links(*(v[at:to] for v in (group, side, component, line, first)), t.column("text").slice(at, to - at).to_pylist())
            a, b = line[at + x], line[at + y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            at = to


def verify_groups(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) within groups of `crossing`; rows are lines of groups, never pairs. texts: line, text."""
    sent = groups.join(texts, "line")
    return sent.repartition(*_PLACE).sortWithinPartitions(*_PLACE, "line").transform(arrow_map, _verified_groups, "a bigint, b bigint")


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links (a, b): only the components that these join are searched again."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    every = materialize(parts.join(ends, "node", "full").select("node", F.coalesce("component", "node").alias("component")), "parts")
    of_a, of_b = (every.select(F.col("node").alias(k), F.col("component").alias(f"p{k}")) for k in "ab")
    over = components(links.join(of_a, "a").join(of_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    return every.join(over.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def shared_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `shared`, and line, doc_id, h2, size and parity of lines with a band that another line shares."""
    met = materialize(shared(lines), "shared-bands")
    known = lines.where("size is not null").select("h1", "h2", "doc_id", "size", "parity").join(met.select(F.col("line").alias("h1")).distinct(), "h1", "left_semi")
    info = known.groupBy(F.col("h1").alias("line")).agg(F.min(F.struct("doc_id", "h2", "size", "parity")).alias("r"))
    return met, materialize(info.select("line", "r.*"), "shared-lines")


def line_components(met: DataFrame, info: DataFrame, docs: DataFrame) -> DataFrame:
    """Component of each line that is linked with another: line, h2 (of the text that was compared), component."""
    rows = materialize(mates(met, info), "near-bands")
    discard(met)
    pairs = rows.where("first is not null").select(F.least("line", "first").alias("a"), F.greatest("line", "first").alias("b")).distinct()
    pairs = materialize(pairs, "line-pairs")
    place = info.select("line", "doc_id")
    # All lines of both rounds are read at once.
    asked = place.join(rows.select("line").distinct(), "line", "left_semi")
    texts = materialize(line_texts(asked, docs), "line-texts")
    parts = components(materialize(verify(pairs, texts), "line-links"))
    groups = materialize(crossing(rows, info, parts), "crossing")
    links = materialize(verify_groups(groups, texts), "line-links")
    whole = merged(parts, links)
    whole = materialize(whole.join(info.select(F.col("line").alias("node"), "h2"), "node").select(F.col("node").alias("line"), "h2", "component"), "components")
    discard(info, rows, pairs, texts, groups, links)
    return whole


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (hash of the text) and the positions (array of int) of its lines that go, for texts that lose any."""
    whole = materialize(measured(docs, travelling=True), "lines")
    met, info = shared_lines(whole)
    lines = materialize(whole.select("doc_id", "tkey", "pos", "h1", "h2", "again"), "places")
    discard(whole)  # bands and parities are its most bytes
    comp = line_components(met, info, _keyed_texts(docs).select("doc_id", "text"))
    comp = comp.select(F.col("line").alias("h1"), "h2", "component")
    every = materialize(distinct_lines(lines).join(comp, ["h1", "h2"], "left").where("n > 1 or component is not null"), "found-lines")
    # An exact group of its own keeps its own first line; a component keeps the first of its groups.
    first = every.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("first_id"))
    every = every.join(first, "component", "left")
    alone = F.col("component").isNull()
    every = every.select("h1", "h2", F.coalesce("component", "h1").alias("x"), F.when(alone, F.col("h2")).otherwise(0).alias("y"), alone.alias("alone"), F.coalesce("first_id", "doc_id").alias("first_id"))
    every = materialize(every, "repeated-lines")
    repeats = lines.where("not again").select("doc_id", "tkey", "pos", "h1", "h2").join(broadcast_if_small(every, every.count(), 200_000), ["h1", "h2"])
    repeats = materialize(repeats.drop("h1", "h2"), "repeats")
    # The first line stands in the component's first document; of its lines there only one stays.
    mine, key = repeats.where("doc_id = first_id").withColumn("place", F.struct("tkey", "pos")), ["x", "y", "alone"]
    twice = mine.join(mine.groupBy(*key).agg(F.min("place").alias("kept")), key).where("place <> kept").select("doc_id", "tkey", "pos")
    gone = repeats.where("doc_id <> first_id").select("doc_id", "tkey", "pos").unionByName(twice).unionByName(lines.where("again").select("doc_id", "tkey", "pos"))
    return gone.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    """text without the lines at the ascending positions `gone`: what lies between two of them is cut out as one stretch."""

    def stretches(lines: Column) -> Column:
        before = lambda i: F.when(i == 0, -1).otherwise(F.get(gone, i - 1))
        after = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, before(i) + 2, after(i) - before(i) - 1)))

    # The lines are bound once: inside a lambda they would be split again for every stretch.
    return F.array_join(F.transform(F.array(F.split(text, "\n", -1)), stretches)[0], "\n")


def deduped(docs: DataFrame, gone: str = "gone") -> DataFrame:
    """docs with one more column, `gone`: the positions of the lines that went (null: none), and text without them."""
    if gone in docs.columns:
        raise ValueError(f"docs have a column {gone!r}; give another name")
    held = materialize(dropped_lines(docs), "gone").select(F.col("doc_id").alias("id"), "tkey", F.col("gone").alias("positions"))
    size = held.agg(48 * F.count("*") + 4 * F.coalesce(F.sum(F.size("positions")), F.lit(0))).first()[0]  # bytes
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # no name of docs can clash
    joined = rows.join(broadcast_if_small(held, size, BROADCAST_BYTES), (F.col("row.doc_id").cast("bigint") == F.col("id")) & (F.xxhash64("row.text") == F.col("tkey")), "left")
    left = F.when(F.col("positions").isNull(), F.col("row.text")).otherwise(_without(F.col("row.text"), F.col("positions")))
    return joined.select(*(left.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns), F.col("positions").alias(gone))


def filter_documents(docs: DataFrame) -> DataFrame:
    """docs with texts that keep one line of each component; emptied documents go; n_chars, if a column, is counted anew."""
    gone = free_name(docs, "gone")
    out = deduped(docs, gone).where(F.col(gone).isNull() | F.col("text").rlike(r"[^\x00-\x20]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
