"""Isolation forest: trees on small seeded samples, as flat arrays that score all rows at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE = 100, 256


def expected_path(n: np.ndarray) -> np.ndarray:
    """The mean length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees x nodes in the order of a heap: feature (-1 for a leaf), threshold (below it goes left), and a leaf's path length."""

    names: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path) of each row: near 1 for what is isolated early."""
        total, each = np.zeros(len(x)), np.arange(len(x))
        for f, t, p in zip(self.feature, self.threshold, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            while (inner := f[node] >= 0).any():
                at = each[inner]
                k = node[at]
                node[at] = 2 * k + 1 + (x[at, f[k]] >= t[k])
            total += p[node]
        return 2.0 ** (-total / len(self.path) / max(float(expected_path(self.rows)), 1e-9))

    def judge(self, df: DataFrame, score: str = "anomaly") -> DataFrame:
        """df with its score; null where a feature is null or not finite."""
        names, values = self.names, [c for c in df.columns if c != score]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(names))], axis=1).astype(float)
                ok = np.isfinite(x).all(axis=1)
                got = np.zeros(len(x))
                got[ok] = self.scores(x[ok])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in values), pa.array(got, mask=~ok)], names=[*values, score])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != score)
        return df.select(*values, *(F.col(n).cast("double").alias(f"_x{i}") for i, n in enumerate(names))).mapInArrow(run, f"{fields}, `{score}` double")


def _tree(x: np.ndarray, depth: int, chance: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree over the sample x."""
    nodes = (2 << depth) - 1
    feature, threshold, path = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    open_nodes = [(0, 0, x)]
    while open_nodes:
        node, level, own = open_nodes.pop()
        varied = np.flatnonzero(np.ptp(own, axis=0) > 0) if len(own) > 1 else np.zeros(0, int)
        if level == depth or not len(varied):
            path[node] = level + float(expected_path(len(own)))
            continue
        f = int(chance.choice(varied))
        low, high = own[:, f].min(), own[:, f].max()
        t = chance.uniform(low, high)
        t = high if t <= low else t  # both sides have a row
        feature[node], threshold[node] = f, t
        open_nodes += [(2 * node + 1, level + 1, own[own[:, f] < t]), (2 * node + 2, level + 1, own[own[:, f] >= t])]
    return feature, threshold, path


def fit(df: DataFrame, id_col: str, features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> IsolationForest:
    """A forest on trees * sample rows at most, those of the least hash of id and seed, each in one tree.

    With fewer rows the trees share them, each a sample of its own. Rows with a feature that is null or not finite are left
    out. The same rows give the same forest, however they are partitioned; ids are unique.
    """
    fine = reduce(lambda a, b: a & b, (F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in features))
    rows = df.where(fine).select(F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"), F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)))
    x = np.array([r[2:] for r in rows.orderBy("h", "id").limit(trees * sample).collect()], float).reshape(-1, len(features))
    chance = np.random.default_rng(seed)
    each = min(sample, len(x))
    dealt = [x[k * sample : (k + 1) * sample] if len(x) == trees * sample else x[np.sort(chance.choice(len(x), each, replace=False))] if each else x for k in range(trees)]
    depth = max(1, int(np.ceil(np.log2(max(2, each)))))
    feature, threshold, path = (np.stack(v) for v in zip(*(_tree(d, depth, chance) for d in dealt), strict=True))
    return IsolationForest(list(features), feature, threshold, path, each)
