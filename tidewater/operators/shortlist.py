"""Shortlists of like vectors: a coarse quantiser whose nearest cells are probed, with exact cosines of what lies there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import written

#: Rows that the cells' centres are fitted on, rounds of fitting, and the most cells.
SAMPLE_ROWS, ROUNDS, MOST_CELLS = 20_000, 8, 4096
#: Rows of the sample that the number of probes is measured on.
ASKED = 200
#: Rows of a cell, and queries of a cell, that meet in one task.
BLOCK = 4096


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, scaled to length 1."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    x = x.reshape(len(column), -1) if len(column) else x.reshape(0, 1)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and vec of rows that have an id and finite components, some not 0."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vec"))


def centres(rows: DataFrame, k: int, cells: int | None = None, recall: float = 0.95) -> tuple[np.ndarray, int]:
    """Centres of cells from SAMPLE_ROWS rows at most, in order of a hash, and the probes that find `recall` of the k nearest there.

    All rows are indexed by these centres afterwards. The probes are measured on ASKED rows of the sample, each against all of it.
    """
    sample = rows.withColumn("h", F.xxhash64("id", F.lit(5))).orderBy("h", "id").limit(SAMPLE_ROWS).select("vec").toArrow()
    if not sample.num_rows:
        return np.zeros((0, 1)), 0
    x = unit_rows(sample.column("vec").combine_chunks())
    n = min(len(x), cells or max(1, min(MOST_CELLS, round(len(x) ** 0.5))))
    c = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 0, sums / np.where(length > 0, length, 1), c)
    asked = np.arange(min(ASKED, len(x)))
    cosine = x[asked] @ x.T
    cosine[asked, asked] = -2
    best = np.argsort(-cosine, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[asked] @ c.T), axis=1, kind="stable"), axis=1, kind="stable")  # of each cell among a row's
    near = (x @ c.T).argmax(axis=1)
    at = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    return c, int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1 if len(at) else 1


def _celled(rows: DataFrame, c: np.ndarray, probes: int) -> DataFrame:
    """id, vec and the cells of the nearest centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(unit_rows(batch.column("vec")) @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), lists], names=["id", "vec", "cells"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, vec array<double>, cells array<int>")


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """From rows in order of (cell, i, j): of each group its queries' k nearest rows, ties by id."""
    held: list[pa.Table] = []

    def found() -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held)
        asks = np.asarray(t.column("asks").to_numpy())
        q, r = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        if q.num_rows and r.num_rows:
            qv, rv = (unit_rows(x.column("vec").combine_chunks()) for x in (q, r))
            ids = r.column("id").to_numpy(zero_copy_only=False)
            for at in range(0, len(qv), 256):
                cosine = qv[at : at + 256] @ rv.T
                cosine[q.column("id").to_numpy(zero_copy_only=False)[at : at + 256, None] == ids] = -2  # not itself
                for row, name in zip(cosine, q.column("id").slice(at, 256).to_pylist(), strict=True):
                    best = np.lexsort([ids, -row])[:k] if len(row) <= 4 * k else (p := np.flatnonzero(row >= np.partition(row, -k)[-k]))[np.lexsort([ids[p], -row[p]])[:k]]
                    best = best[row[best] > -2]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(best), t.schema.field("id").type), pa.array(ids[best], t.schema.field("id").type), pa.array(row[best])], names=["query_id", "id", "cosine"])

    key = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        keys = list(zip(*(t.column(x).to_pylist() for x in ("cell", "i", "j")), strict=True))
        at = 0
        while at < len(keys):
            to = at
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            if keys[at] != key and held:
                yield from found()
                held = []
            key = keys[at]
            held.append(t.slice(at, to - at))
            at = to
    if held:
        yield from found()


def shortlist(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 10, probes: int | None = None, cells: int | None = None, recall: float = 0.95) -> DataFrame:
    """query_id, rank, id and cosine: of each query the k rows of highest cosine in the cells of its nearest centres.

    Without `probes` they are as many as find `recall` of the k nearest in the sample. Every row is in one cell. Rows of a large cell are dealt into blocks and so are a cell's many queries; each block meets
    each in one task, which returns k rows a query. With probes = cells the result is exact. Rows without a vector, or with
    one of zeros or that is not finite, are in no list; vectors have one length.
    """
    rows = usable(vectors, id_col, vector)
    c, measured = centres(rows, k, cells, recall)
    probes = probes or measured
    kind = rows.schema["id"].dataType.simpleString()
    if not len(c):
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank bigint, id {kind}, cosine double")
    placed = written(_celled(rows, c, 1).select("id", "vec", F.element_at("cells", 1).alias("cell")), "cells")
    asked = written(_celled(usable(queries, id_col, vector), c, probes).select("id", "vec", F.explode("cells").alias("cell")), "probes")
    blocks = lambda t, name: t.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = written(blocks(placed, "rows").join(blocks(asked, "asks_in"), "cell"), "cell-sizes")  # a row a cell
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(F.broadcast(sizes), "cell").select("cell", own("rows").alias("i"), upto("asks_in").alias("j"), F.lit(False).alias("asks"), "id", "vec")  # MOST_CELLS rows at most
    right = asked.join(F.broadcast(sizes), "cell").select("cell", upto("rows").alias("i"), own("asks_in").alias("j"), F.lit(True).alias("asks"), "id", "vec")
    met = left.unionByName(right).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(lambda b: _nearest(b, k), f"query_id {kind}, id {kind}, cosine double")
    best = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")  # k rows for each block met
    return met.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")
