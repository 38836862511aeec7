"""Vector code compression: a codebook for each part of a vector, with distances shared along tries of distinct parts.

Components become integers floor(scale * x). Each block of rows is sorted once into one trie a part position: the
block's distinct parts with their counts, in lexicographic order, a level a dimension. The tries are a table. A round
walks each of them depth first, in runs of neighbouring nodes: a node adds one difference per codebook entry to the
distances accumulated above it, so that parts with a common prefix share its work, and at the leaves the smallest distance
gives the entry, to whose sums the part goes with its count. Only these sums (entries x dimensions numbers a task) are
shuffled and reach the driver, whatever the number of rows; no key of the data is ever shuffled, so none can be hot.

Rows whose vector is null or holds a null or a component that is not finite are dropped, as are those whose length is no
positive multiple of the number of parts, or another than that of the smallest id kept. Rows that repeat an id are coded
each on their own; as first entries, rows of one id go by their components and null ids last. With fewer rows than entries
each is an entry. Arithmetic is exact: where 64 bits could be passed, integers of any size are used. Components
beyond 2**62 after scaling count as that, errors and their sums beyond 2**63 - 1 as that. No rows give no codes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows whose parts make one trie, and nodes of a level that are walked at once.
BLOCK_ROWS, RUN_NODES = 1 << 14, 2048
#: Components below this cannot pass 64 bits in any sum of a block; others take integers of any size.
_NARROW, _WIDEST, _LONGEST = 1 << 24, 1 << 62, (1 << 63) - 1

Books = list[list[list[int]]]


def kept(df: DataFrame, vector: str = "embedding", parts: int = PARTS) -> DataFrame:
    """Rows that have finite components only, in a number that the parts can share."""
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(whole, F.lit(False)) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))


def integers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """rows x width scaled integers of a list column without nulls."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    large = np.abs(scaled) >= _WIDEST
    return np.where(large, np.where(scaled < 0, -_WIDEST, _WIDEST), np.where(large, 0, scaled).astype(np.int64))


class Trie:
    """Distinct parts in lexicographic order: shared[i] leading components of part i are those of part i - 1.

    levels[d] holds the component of each node of depth d; first[d] the first node of depth d + 1 below each.
    """

    def __init__(self, shared: np.ndarray, values: np.ndarray, counts: np.ndarray, width: int) -> None:
        self.shared, self.values, self.counts, self.width = shared, values, counts, width
        at = [np.flatnonzero(shared <= d) for d in range(width)]
        ends = np.cumsum([len(a) for a in at])
        self.levels = np.split(values, ends[:-1])
        self.first = [np.append(np.searchsorted(b, a), len(b)) for a, b in zip(at, at[1:], strict=False)]
        self.narrow = bool(np.abs(values).max(initial=0) < _NARROW)

    @staticmethod
    def of(parts: np.ndarray) -> tuple[Trie, np.ndarray]:
        """The trie of all rows, and each row's leaf."""
        n, width = parts.shape
        order = np.lexsort(parts.T[::-1])
        ranked = parts[order]
        differs = ranked[1:] != ranked[:-1]
        shared = np.append(0, np.where(differs.any(axis=1), differs.argmax(axis=1), width))
        new = shared < width
        leaf = np.empty(n, np.int64)
        leaf[order] = np.cumsum(new) - 1
        shared, distinct = shared[new].astype(np.int32), ranked[new]
        values = np.concatenate([distinct[shared <= d, d] for d in range(width)])
        return Trie(shared, values, np.bincount(leaf).astype(np.int64), width), leaf

    def parts(self) -> np.ndarray:
        """The distinct parts themselves."""
        return np.stack([v[np.cumsum(self.shared <= d) - 1] for d, v in enumerate(self.levels)], axis=1)

    def walk(self, book: list[list[int]]) -> Iterator[tuple[int, np.ndarray]]:
        """First leaf of each run of leaves, and their squared distances to all entries; depth first, from left to right."""
        kind = np.int64 if self.narrow and max(abs(x) for e in book for x in e) < _NARROW else object
        entries = np.array(book, dtype=kind)
        stack = [(0, 0, len(self.levels[0]), np.zeros((len(self.levels[0]), len(book)), kind))]
        while stack:
            depth, lo, hi, above = stack.pop()
            if hi - lo > RUN_NODES:  # the left half goes first
                mid = lo + RUN_NODES
                stack += [(depth, mid, hi, above[mid - lo :]), (depth, lo, mid, above[: mid - lo])]
                continue
            step = self.levels[depth][lo:hi, None].astype(kind) - entries[:, depth]
            here = above + step * step
            if depth == self.width - 1:
                yield lo, here
                continue
            below = self.first[depth]
            stack.append((depth + 1, int(below[lo]), int(below[hi]), np.repeat(here, np.diff(below[lo : hi + 1]), axis=0)))

    def nearest(self, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """For each leaf its nearest entry, the lower of two that tie, and the squared distance."""
        runs = [(d.argmin(axis=1).astype(np.int64), d.min(axis=1)) for _, d in self.walk(book)]
        return np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])


def tries(rows: DataFrame, vector: str, width: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """part, shared, components and counts: a trie for each part position of each block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[np.ndarray]) -> pa.RecordBatch:
            block = np.concatenate(held)
            found = [Trie.of(p)[0] for p in np.split(block, parts, axis=1)]
            columns = [[a.tobytes() for a in (t.shared, t.values, t.counts)] for t in found]
            return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*columns, strict=True))], names=["part", "shared", "components", "counts"])

        held: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(integers(batch.column(0).slice(at, BLOCK_ROWS), width, scale))
                if sum(map(len, held)) >= BLOCK_ROWS:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return rows.select(vector).transform(arrow_map, run, "part int, shared binary, components binary, counts binary")


def _sums(table: DataFrame, books: Books, width: int) -> DataFrame:
    """part, entry, place, n and total: how many parts are nearest to each entry, and the sums of their components."""
    parts, entries, each = len(books), len(books[0]), width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), object), np.zeros((parts, entries, each), object)
        for batch in batches:
            for part, *arrays in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie = Trie(*(np.frombuffer(b, k) for b, k in zip(arrays, (np.int32, np.int64, np.int64), strict=True)), each)
                code, _ = trie.nearest(books[part])
                weighted = trie.parts().astype(np.int64 if trie.narrow else object) * trie.counts[:, None]
                for e in np.unique(code):
                    n[part, e] += int(trie.counts[code == e].sum())
                    total[part, e] += weighted[code == e].sum(axis=0).astype(object)
        where = [(p, e, i) for p in range(parts) for e in range(entries) for i in range(each) if n[p, e]]
        if where:
            yield pa.RecordBatch.from_arrays([
                *(pa.array(x, pa.int32()) for x in zip(*where, strict=True)), pa.array([n[p, e] for p, e, _ in where], pa.int64()), pa.array([Decimal(int(total[w])) for w in where], pa.decimal128(38, 0)),
            ], names=["part", "entry", "place", "n", "total"])

    found = table.transform(arrow_map, run, "part int, entry int, place int, n bigint, total decimal(38,0)")
    return found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Books:
    """The codebooks by part, entry and place; empty if no row is kept."""
    rows = kept(vectors, vector, parts).select(id_col, vector)
    smallest = [F.col(id_col).asc_nulls_last(), F.col(vector)]
    head = rows.orderBy(*smallest).limit(entries).collect()
    if not head:
        return []
    width = len(head[0][vector])
    rows = rows.where(F.size(vector) == width)
    if any(len(r[vector]) != width for r in head):
        head = rows.orderBy(*smallest).limit(entries).collect()
    start = integers(pa.array([r[vector] for r in head]), width, scale)
    books = [p.tolist() for p in np.split(start, parts, axis=1)]
    table = materialize(tries(rows, vector, width, parts, scale), "tries")
    for _ in range(rounds):
        for r in _sums(table, books, width).collect():  # parts x entries x places, whatever the rows
            books[r.part][r.entry][r.place] = int(r.total) // r.n
    return books


def encode(vectors: DataFrame, books: Books, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label"), scale: int = SCALE) -> DataFrame:
    """The columns to keep, code (the nearest entries' numbers in order of parts, two hex digits each) and error of each kept row."""
    parts, width = len(books), sum(len(b[0]) for b in books)
    fields = [vectors.schema[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                codes, error = np.empty((some.num_rows, parts), np.uint8), 0
                for p, part in enumerate(np.split(integers(some.column(len(keep)), width, scale), parts, axis=1)):
                    trie, leaf = Trie.of(part)
                    code, distance = trie.nearest(books[p])
                    codes[:, p], error = code[leaf], error + distance[leaf].astype(object)
                digits, step = codes.tobytes().hex(), 2 * parts
                yield pa.RecordBatch.from_arrays([
                    *some.columns[: len(keep)], pa.array([digits[i : i + step] for i in range(0, len(digits), step)]), pa.array([min(e, _LONGEST) for e in error.tolist()], pa.int64()),
                ], names=[*keep, "code", "error"])

    rows = kept(vectors, vector, parts or PARTS).where(F.size(vector) == width).select(*keep, vector)
    return rows.transform(arrow_map, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", code string, error bigint")


def decode(codes: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """codes with `vector`: what their entries stand for, about."""
    flat_books = np.array([[np.array(e, float) / scale for e in b] for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(-1, len(books))
            found = flat_books[np.arange(len(books)), code].reshape(batch.num_rows, -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "vector"])

    return codes.transform(arrow_map, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields) + ", vector array<double>")


def digest(books: Books) -> str:
    """SHA-256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the errors of all rows of an equal label, null labels together."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_LONGEST))).cast("bigint")
    sums = materialize(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "label-errors")
    return coded.join(broadcast_if_small(sums, sums.count()), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
