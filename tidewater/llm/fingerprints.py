"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Triplets from a sliding window of five bytes (three shapes) are hashed into 256 buckets. The counts' quartiles cut
the buckets into four classes of two bits each; in front stand the length on a logarithmic scale and how the
quartiles relate. The difference of two digests is the sum of class steps and header steps, bounded by the value
that unrelated digests reach, so that likeness lies between 0 and 1.

Null text counts as empty. Texts under three bytes have no triplets, and all bucket classes are 0. Equal texts have
equal fingerprints. Documents are put in order of descending id (null ids last; equal ids by the first 64 characters of
their text, then by its hash, then by place) by ranges of all this, never in one task, so that neither null ids nor one id of
very many rows meets in one. The ranges are as many as the corpus' bytes ask for; the last row of each goes to a table
beside the first of the next, two rows a range, where they are compared. A very long text is a piece of its own. Repeated
rows stay in the order and each has its own next document. A single document is its own next. An empty table gives no rows.
Only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE_BYTES, arrow_map, buffers, materialize, pieces

BUCKETS = 256
#: Difference of two digests whose classes are independent: 1.25 steps a bucket.
MOST = 1.25 * BUCKETS
#: Bytes of text in a range of the order, about.
RANGE_BYTES = 32 << 20
_SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 4))


def _counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bucket counts of each row's triplets."""
    n = len(off) - 1
    out = np.zeros((n, BUCKETS), np.int64)
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(off))
    stop = np.repeat(off[1:], np.diff(off))
    byte = data.astype(np.uint32)
    for salt, (a, b, c) in enumerate(_SHAPES):
        m = len(data) - c
        if m <= 0:
            continue
        code = byte[a : a + m] | byte[b : b + m] << np.uint32(8) | byte[c : c + m] << np.uint32(16)
        bucket = ((code + np.uint32(salt << 24)) * np.uint32(2654435761)) >> np.uint32(24)
        inside = np.arange(m) + c < stop[:m]
        out += np.bincount((row[:m] + bucket)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    return out


def digests(data: np.ndarray, off: np.ndarray) -> list[str]:
    """Fingerprint of each row: 2 hex digits of length, 2 of quartile relations, then 2 bits for each bucket."""
    counts = _counts(data, off)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1 : BUCKETS * k // 4] for k in (1, 2, 3))
    code = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8)
    packed = code[:, 0::4] << 6 | code[:, 1::4] << 4 | code[:, 2::4] << 2 | code[:, 3::4]
    size = np.minimum(255, np.round(12 * np.log2(1 + np.diff(off)))).astype(np.uint8)
    top = np.maximum(q3[:, 0], 1)
    ratios = (q1[:, 0] * 15 // top).astype(np.uint8) << 4 | (q2[:, 0] * 15 // top).astype(np.uint8)
    whole = np.concatenate([size[:, None], ratios[:, None], packed], axis=1).tobytes()
    width = 2 + BUCKETS // 4
    return [whole[i : i + width].hex() for i in range(0, len(whole), width)]


def _steps() -> np.ndarray:
    """Sum of class differences of two bytes of four classes each."""
    x = np.arange(256)
    parts = np.stack([x >> s & 3 for s in (0, 2, 4, 6)])
    return np.abs(parts[:, :, None] - parts[:, None, :]).sum(0).astype(np.int64)


_STEPS = _steps()


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal digests, 0 for a difference of MOST or more; symmetric."""
    if not a:
        return np.zeros(0)
    width = 2 + BUCKETS // 4
    x, y = (np.frombuffer(bytes.fromhex("".join(v)), np.uint8).reshape(-1, width) for v in (a, b))
    far = _STEPS[x[:, 2:], y[:, 2:]].sum(1)
    far += np.abs(x[:, 0].astype(int) - y[:, 0]) // 2
    far += np.abs((x[:, 1] >> 4).astype(int) - (y[:, 1] >> 4)) + np.abs((x[:, 1] & 15).astype(int) - (y[:, 1] & 15))
    return 1.0 - np.minimum(far, MOST) / MOST


def of_texts(texts: list[str]) -> list[str]:
    """Fingerprints of texts, a bounded number of bytes at a time."""
    out: list[str] = []
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE_BYTES or i == len(texts) - 1 or i - at >= 4096:
            out += digests(*buffers(pa.array(texts[at : i + 1], pa.large_string())))
            at, size = i + 1, 0
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests(*buffers(batch.column("text"))), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").transform(arrow_map, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}


def _both(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch


def with_next(docs: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch] = _both, fields: str = "text string, next_text string") -> DataFrame:
    """doc_id and `fields`: what `make` gives for rows (doc_id, text, next_text), next_text being that of the document with the next lower id.

    The last document has the first as its next. Texts are shuffled once.
    """
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = held.agg(F.sum(F.octet_length("text") + 16).alias("bytes")).first()["bytes"] or 0
    keyed = held.withColumns({"_head": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), "_head", "_hash", "_place"]
    dealt = keyed.repartitionByRange(int(size) // RANGE_BYTES + 1, *order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = [f.split() for f in fields.split(", ")]

    def asked(rows: pa.Table, after: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), rows.column("text").combine_chunks(), after], names=["doc_id", "text", "next_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        names = ["doc_id", *(n for n, _ in made), "part", "edge", "edge_text"]

        def edge(row: pa.Table, number: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([row.column("doc_id").combine_chunks(), *(pa.nulls(1, _KINDS[k]) for _, k in made), pa.array([part], pa.int32()), pa.array([number], pa.int32()), row.column("text").combine_chunks()], names=names)

        for batch in pieces(batches, limit=PIECE_BYTES):
            rows = pa.Table.from_batches([batch])
            if last is None:
                yield edge(rows.slice(0, 1), 1)
            else:
                rows = pa.concat_tables([last, rows])
            n = rows.num_rows - 1
            if n:
                out = make(asked(rows.slice(0, n), rows.column("text").slice(1).combine_chunks()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([part] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())], names=names)
            last = rows.slice(n)
        if last is not None:
            yield edge(last, 2)

    table = materialize(dealt.transform(arrow_map, run, f"doc_id {kind}, {fields}, part int, edge int, edge_text string"), "next")
    firsts, lasts = (table.where(F.col("edge") == k).select("doc_id", "part", F.col("edge_text").alias("text")) for k in (1, 2))
    every = Window.orderBy("part")
    parts = firsts.select("part").select("part", F.coalesce(F.lead("part").over(every), F.min("part").over(every)).alias("ahead"))  # a number for each range
    ends = lasts.join(parts, "part").join(firsts.select(F.col("part").alias("ahead"), F.col("text").alias("next_text")), "ahead").select("doc_id", "text", "next_text")
    seams = ends.transform(arrow_map, lambda batches: (make(b) for b in pieces(batches)), f"doc_id {kind}, {fields}")
    return table.where("edge = 0").select("doc_id", *(n for n, _ in made)).unionByName(seams)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that of the next document's."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, nexts = batch.column("text").to_pylist(), batch.column("next_text").to_pylist()
        changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
        own = digests(*buffers(batch.column("text")))
        apart = [i for i in range(len(texts)) if i + 1 == len(texts) or nexts[i] != texts[i + 1]]  # else the next row has it
        after = [*own[1:], ""]
        for i, f in zip(apart, of_texts([nexts[i] for i in apart]), strict=True):
            after[i] = f
        new = of_texts(changed)
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(own, pa.string()), pa.array(new, pa.string()), pa.array(likeness(own, new)), pa.array(likeness(own, after)),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, make, "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
