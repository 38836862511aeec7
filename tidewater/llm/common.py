"""What the operators share: tables in the shared folder, texts as numpy byte arrays, hashes of spans."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import shared_dir

#: Bytes of text that a task works on at once. One text is never split, so a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Rows of an Arrow batch where the session has Spark's default: documents are long rows.
BATCH_ROWS = 4000
#: Rows up to which a table of integers is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: The same for tables whose bytes have been summed.
BROADCAST_BYTES = 16 << 20
_BATCH, _CLEANUP = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _for_one_table(spark: SparkSession) -> Iterator[None]:
    """Session options while one table is written; then as before.

    Arrow batches have BATCH_ROWS, unless the session asks for others than Spark's default. Shuffle files go when the
    table is there: what follows reads the table, so that disks hold the shuffles of one table at a time.
    """
    before = {k: spark.conf.get(k, None) for k in (_BATCH, _CLEANUP)}
    try:
        if before[_BATCH] == "10000":
            spark.conf.set(_BATCH, BATCH_ROWS)
        if before[_CLEANUP] is not None:
            spark.conf.set(_CLEANUP, "true")
        yield
    finally:
        for k, v in before.items():
            if v is not None:
                spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later steps neither repeat its work nor depend on an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    with _for_one_table(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more: all that was made of them has been written."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/tidewater/" in path:
                where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def key_groups(spark: SparkSession) -> int:
    """In how many groups keys travel packed: some for each of Spark's shuffle partitions, so that a task works on one at a time."""
    return 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(key: np.ndarray, columns: dict[str, np.ndarray], groups: int) -> pa.RecordBatch:
    """A row for each group of ascending 64-bit keys, as their high bits deal them, with its part of every column as bytes."""
    bounds = np.searchsorted((key >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32), np.arange(groups + 1))
    full = np.flatnonzero(np.diff(bounds))
    ends = np.append(bounds[full], len(key))
    blobs = [pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((v.itemsize * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))]) for v in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *blobs], names=["dealt", *columns])


def unpacked(table: pa.Table, column: str, kind: object) -> np.ndarray:
    """What `packed` packed, of all rows of a table."""
    return np.frombuffer(buffers(table.column(column))[0], kind)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A hint for a table whose rows or bytes (as the limit) have been counted; beyond the limit Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow, for df.transform(arrow_map, ...)."""
    return df.mapInArrow(run, schema)


def text_filter(docs: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray], **more: Column) -> DataFrame:
    """The rows of docs for which `keep` says so, of batches of `text` and more columns; only these go to the workers, other columns stay behind."""

    names = ["text", *more]

    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for held in columns:
            batch = pa.RecordBatch.from_arrays(list(held) if len(names) > 1 else [held], names=names)
            yield pa.array(np.concatenate([np.zeros(0, bool), *(keep(b) for b in pieces(iter([batch])))]), pa.bool_())

    return docs.where(F.arrow_udf(run, "boolean")(docs["text"], *more.values()))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, from a stem."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def release() -> None:
    """Give memory that numpy has freed back to the system, where the C library can: workers live on between tasks."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string (or binary) array and where each row begins; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return body, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches to about `limit` bytes of the text column, between rows."""
    for batch in batches:
        _, off = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a byte mask for each row."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def class_counts(table: np.ndarray, data: np.ndarray, off: np.ndarray, kinds: int) -> np.ndarray:
    """How many bytes of each class every row has (rows x kinds), by a table of the 256 bytes' classes."""
    n = len(off) - 1
    key = np.repeat(np.arange(n, dtype=np.int64) * kinds, np.diff(off)) + table[data]
    return np.bincount(key, minlength=n * kinds).reshape(n, kinds)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run `[^\\x20\\x09-\\x0D]+` (or of bytes outside another gap), and for each row the number of its first word."""
    space = gap[data]
    begin = ~space
    end = begin.copy()
    begin[1:] &= space[:-1]
    end[:-1] &= space[1:]
    full = off[1:] > off[:-1]
    first, last = off[:-1][full], off[1:][full] - 1
    begin[first] = ~space[first]
    end[last] = ~space[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, np.uint64)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _upto(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, in a cache of the worker."""
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans by prefix sums; fold: A-Z as a-z."""
    power, inverse = _upto(len(data) + 1)
    table, sums = _FOLDED if fold else _TABLE, np.zeros(len(data) + 1, np.uint64)
    for low in range(0, len(data), 1 << 14):  # so much stays in a cache
        high = min(len(data), low + (1 << 14))
        part = table[data[low:high]]
        part *= power[low:high]
        part[:1] += sums[low : low + 1]
        np.cumsum(part, out=sums[low + 1 : high + 1])
    return mix64((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64) * np.uint64(_ODD))


def keyed(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row."""
    return mix64(h + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD))


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of each item, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def distinct_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One span of each content, and for each span which of these it equals; found by hash (h, if it is known), compared by bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = span_hashes(data, starts, stops) if h is None else h
    order = h.argsort()
    new = np.append(True, h[order[1:]] != h[order[:-1]])
    first, same = order[new], np.empty(len(h), np.int64)
    same[order] = np.cumsum(new) - 1
    lengths, twin = stops - starts, first[same]
    if np.array_equal(lengths[twin], lengths):
        at = flat(starts, lengths)
        if np.array_equal(data[at + np.repeat(starts[twin] - starts, lengths)], data[at]):
            return first, same
    each = np.arange(len(starts))  # two contents with one hash: every span stands for itself
    return each, each
