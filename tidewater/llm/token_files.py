"""Token ids in files of independent zstandard frames, one a document, with a trailing seek table and checksums.

A file holds, one behind the other: a frame for each of its documents (its ids as little-endian unsigned integers of 16
bits, or of 32 if the vocabulary needs them), one frame that lists the documents (an Arrow stream of their ids, whose
metadata give the width and the file's place), and the seek table of the public seekable format: a skippable frame with
the packed size, the plain size and the checksum (low half of XXH64 of the plain bytes) of every frame, and a footer. Any
reader of zstandard sees an ordinary file; one that knows the table decompresses only the documents it was asked for.

Texts are encoded where they are read, so that only packed frames travel: they are written once, dealt by ranges of the
document ids into as many tasks as FILE_BYTES asks for, and put together. Files leave through Spark's own text writer,
which commits them by task on any file system: a row is a file, bytes are written as they are, and the line separator
behind each row is the table's closing magic number. Folders `part=...` follow the order of ids.

Null text counts as empty and still has its end id, so every row gets a frame. A very long text is a frame of its own and
may make its file longer than FILE_BYTES. Rows that repeat an id have frames in order of length and checksum; equal rows
are told apart by their place only, so that neither a null id nor one id of many copies meets in a task. Null ids come
first. An empty table gives no files, and reading it no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.ranges import running_sums
from .common import BATCH_ROWS, arrow_map, broadcast_if_small, buffers, discard, materialize, pieces
from .packing import load

#: Packed bytes of a file, about. It is one row while it is written and read.
FILE_BYTES = 8 << 20
#: Files whose first places (three numbers each) are broadcast when all are read; beyond it that join shuffles.
MOST_FILES = 4_000_000
#: Folders that a request for single documents names to the reader; a wider one reads all folders and joins.
MOST_FOLDERS = 1000
LEVEL = 3
# Fixed values of the seekable format: head of the skippable frame, flag for checksums, closing magic number.
SKIPPABLE, WITH_CHECKSUMS, MAGIC = 0x184D2A5E, 0x80, b"\xb1\xea\x92\x8f"
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


def _check(plain: bytes) -> int:
    return xxh64_intdigest(plain) & 0xFFFFFFFF


def frames(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, check and frame of every row: its ids and the end id, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, pack = load(path), zstandard.ZstdCompressor(level=LEVEL)
        width = _width(encoding.tokenizer.get_vocab_size(), end_id)
        end = np.array([end_id], f"<u{width}").tobytes()
        for batch in pieces(batches):
            ids, starts = encoding.encode(*buffers(batch.column("text")))
            raw, at = ids.astype(f"<u{width}").tobytes(), (width * starts).tolist()
            plain = [raw[a:b] + end for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(p) // width for p in plain], pa.int64()), pa.array([_check(p) for p in plain], pa.int64()),
                pa.array([width] * len(plain), pa.int32()), pa.array([pack.compress(p) for p in plain], pa.binary()),
            ], names=["doc_id", "n_tokens", "check", "width", "frame"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(arrow_map, run, f"doc_id {kind}, n_tokens bigint, check bigint, width int, frame binary")


def _width(vocabulary: int, end_id: int) -> int:
    return 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4


def file_bytes(body: list[bytes], plain: list[int], checks: list[int], doc_ids: pa.Array, meta: dict[str, str]) -> bytes:
    """A whole file but for its closing magic number."""
    sink = pa.BufferOutputStream()
    listed = pa.record_batch([doc_ids], pa.schema([pa.field("doc_id", doc_ids.type)], metadata=meta))
    with pa.ipc.new_stream(sink, listed.schema) as out:
        out.write_batch(listed)
    listing = sink.getvalue().to_pybytes()
    body = [*body, zstandard.ZstdCompressor(level=LEVEL).compress(listing)]
    table = np.zeros(len(body), _ENTRY)
    table["packed"], table["plain"], table["check"] = [len(b) for b in body], [*plain, len(listing)], [*checks, _check(listing)]
    return b"".join([*body, struct.pack("<II", SKIPPABLE, table.nbytes + 9), table.tobytes(), struct.pack("<IB", len(body), WITH_CHECKSUMS)])


class TokenFile:
    """A file of token ids, of which only what is asked for is decompressed."""

    def __init__(self, body: memoryview) -> None:
        n, flags, magic = struct.unpack("<IB4s", body[-9:])
        if magic != MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("not a file of token ids")
        self.body, self.table = body, np.frombuffer(body[len(body) - 9 - _ENTRY.itemsize * n : len(body) - 9], _ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        self._plain = zstandard.ZstdDecompressor()
        listed = pa.ipc.open_stream(self.frame(n - 1)).read_all()
        self.doc_ids, meta = listed.column("doc_id"), listed.schema.metadata
        self.width, self.sequence = int(meta[b"width"]), int(meta[b"sequence"])
        self.lengths = self.table["plain"][:-1].astype(np.int64) // self.width

    def frame(self, k: int) -> bytes:
        """One frame's plain bytes, whose checksum must be right."""
        plain = self._plain.decompress(self.body[self.at[k] : self.at[k + 1]])
        if _check(plain) != self.table["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.frame(k), f"<u{self.width}")


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int) -> None:
    """Write the ids of all texts, each with the end id, to files in `out` in ascending order of doc_id."""
    packed = materialize(frames(docs, path, end_id).withColumn("place", F.monotonically_increasing_id()), "frames")
    total = packed.agg(F.sum(F.length("frame"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "check", "place"]
    dealt = packed.repartitionByRange(int(total) // FILE_BYTES + 1, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence, held = TaskContext.get().partitionId(), 0, []

        def closed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            meta = {"width": str(table.column("width")[0].as_py()), "sequence": str(sequence)}
            plain = [n * int(meta["width"]) for n in table.column("n_tokens").to_pylist()]
            body = file_bytes(table.column("frame").to_pylist(), plain, table.column("check").to_pylist(), table.column("doc_id").combine_chunks(), meta)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([body], pa.binary())], names=["part", "body"])

        size = 0
        for batch in pieces(batches, "frame"):
            held.append(batch)
            size += batch.column("frame").nbytes
            if size >= FILE_BYTES:
                yield closed()
                sequence, size, held = sequence + 1, 0, []
        if held:
            yield closed()

    files = dealt.transform(arrow_map, run, "part int, body binary").select("part", F.col("body").cast("string").alias("value"))
    files.write.partitionBy("part").option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).option("maxRecordsPerFile", 1).text(out)
    discard(packed)


def _files(spark: SparkSession, out: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(out)
    if "part" not in files.columns:  # no folder, as there were no documents
        files = files.withColumn("part", F.lit(None).cast("int"))
    return files.select("part", "path", "content", F.lit(None).cast("array<bigint>").alias("frames"))


def _opened(files: DataFrame, kind: str, with_ids: bool) -> DataFrame:
    """doc_id, path, part, sequence, frame, n_tokens and start (ids before it in its file) of each document; ids too, of the frames asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part, body, asked in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist(), batch.column("content"), batch.column("frames"), strict=True):
                f = TokenFile(memoryview(body.as_buffer()))
                starts = np.cumsum(f.lengths) - f.lengths
                asked = np.array(asked.as_py(), np.int64) if asked.is_valid else np.arange(len(f.lengths))
                for at in range(0, len(asked), BATCH_ROWS):
                    some = asked[at : at + BATCH_ROWS]
                    columns = [
                        f.doc_ids.take(pa.array(some)).combine_chunks(), pa.array([path] * len(some)), pa.array([part] * len(some), pa.int32()), pa.array([f.sequence] * len(some), pa.int32()),
                        pa.array(some), pa.array(f.lengths[some]), pa.array(starts[some]),
                    ]
                    if with_ids:
                        columns.append(pa.array([f.ids(k).astype("<u4").tobytes() for k in some.tolist()], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "path", "part", "sequence", "frame", "n_tokens", "start", "ids"][: len(columns)])

    return files.select("path", "part", "content", "frames").transform(arrow_map, run, f"doc_id {kind}, path string, part int, sequence int, frame bigint, n_tokens bigint, start bigint" + ", ids binary" * with_ids)


def _first_ids(files: DataFrame) -> DataFrame:
    """part, sequence and first (ids in all files before it): a row a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [TokenFile(memoryview(body.as_buffer())) for body in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([f.sequence for f in found], pa.int32()), pa.array([int(f.lengths.sum()) for f in found], pa.int64())], names=["part", "sequence", "n"])

    sums = materialize(files.select("part", "content").transform(arrow_map, run, "part int, sequence int, n bigint"), "first")
    first = running_sums(sums, [F.col("part"), F.col("sequence")], {"until": "n"}).select("part", "sequence", (F.col("until") - F.col("n")).alias("first"))
    return broadcast_if_small(first, sums.count(), MOST_FILES)


def index(spark: SparkSession, out: str, kind: str = "bigint") -> DataFrame:
    """doc_id, path, part, sequence, frame, n_tokens and start (ids of all documents before it), without decompressing a document.

    kind: the type of doc_id.
    """
    files = _files(spark, out)
    return _opened(files, kind, False).join(_first_ids(files), ["part", "sequence"]).withColumn("start", F.col("start") + F.col("first")).drop("first")


def read_tokens(spark: SparkSession, out: str, wanted: DataFrame | None = None, kind: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian, unsigned, 32 bits) of all documents, or of those whose doc_id is wanted.

    Frames of other documents stay packed, and folders without a wanted document are not read (up to MOST_FOLDERS of them).
    """
    files = _files(spark, out)
    first = _first_ids(files)
    if wanted is not None:
        listed = materialize(_opened(files, kind, False).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("part", "path", "frame"), "wanted")
        parts = [r[0] for r in listed.select("part").distinct().limit(MOST_FOLDERS + 1).collect()]
        if len(parts) <= MOST_FOLDERS:
            files = files.where(F.col("part").isin(parts))
        numbers = listed.groupBy("path").agg(F.sort_array(F.collect_list("frame")).alias("frames"))  # no more than a file has
        files = files.drop("frames").join(numbers, "path")
    found = _opened(files, kind, True).join(first, ["part", "sequence"])
    return found.select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids")
