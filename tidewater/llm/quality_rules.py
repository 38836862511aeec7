"""Quality rules: gradient-boosted trees over document statistics.

`statistics` reads a text's UTF-8 bytes with numpy. A small trainer grows trees of a fixed depth on a bounded
sample of labelled rows; each tree is a set of flat arrays (feature, threshold, value by node), so that scoring a
batch is one array step per level. Chosen features are held monotonic: more symbols, repeated lines or repeated
words never raise a score.

Null text counts as empty: no words, so base_failed. Repeated rows are judged alike, each on its own. An empty
documents table gives no rows; with no usable label (or one class only) the model says "keep" to all, and only
the base rules decide. Labels that disagree on one id count by their mean, a tie as good; of rows that repeat a
labelled id one is sampled, that of the least features. Splits of equal gain go to the first feature and threshold.
A very long text is counted whole, as a piece of its own. Extra columns pass through `filter_documents` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, buffers, class_counts, keyed, per_row, pieces, rows_of, span_hashes, text_filter, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Model features and the sign a feature's effect may have (0: free).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": 0, "digits": 0, "marks": 0, "other": 0, "line_words": 0, "distinct_words": 0}
#: Bound of the labelled rows that the trees are fitted on.
TRAIN_ROWS = 20_000

_NONE, _SYMBOL, _UPPER, _DIGIT, _MARK, _OTHER = range(6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[97:123] = _NONE
_CLASS[list(b".,;:'\"()-")] = _NONE
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_CLASS[list(b"!?")] = _MARK
_CLASS[list(b"#*$%&|<>")] = _SYMBOL


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The five base counts of each row, and its model features (rows x FEATURES)."""
    n = len(off) - 1
    starts, stops, bounds = words(data, off)
    n_words = np.diff(bounds)
    cum = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=cum[1:])
    row = rows_of(bounds)
    word_chars = np.bincount(row, cum[stops] - cum[starts], n).astype(np.int64)
    kinds = class_counts(_CLASS, data, off, 6)
    n_symbols = kinds[:, _SYMBOL]

    # Lines that hold a word, as spans of bytes; equal spans of one row are repeats.
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([off[:-1], breaks + 1]))
    line_row = np.searchsorted(off, line_start, "right") - 1
    extra = np.repeat(np.arange(n), per_row(data == 10, off) + 1)  # rows in order, also where texts are empty
    line_row = extra if len(extra) == len(line_row) else line_row
    line_stop = np.append(line_start[1:], len(data))
    same = np.append(line_row[1:] == line_row[:-1], False)
    line_stop = np.where(same, line_stop - 1, line_stop)
    has_word = np.searchsorted(starts, line_stop) > np.searchsorted(starts, line_start)
    line_start, line_stop, line_row = line_start[has_word], line_stop[has_word], line_row[has_word]
    _, first = np.unique(keyed(line_row, span_hashes(data, line_start, line_stop)), return_index=True)
    n_lines = np.bincount(line_row, minlength=n)
    n_dup_lines = n_lines - np.bincount(line_row[first], minlength=n)

    h = span_hashes(data, starts, stops)
    _, first = np.unique(keyed(row, h), return_index=True)
    distinct = np.bincount(row[first], minlength=n)
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        inside = row[2:] == row[:-2]
        window = h[:-2] * np.uint64(0x9FB21C651E98DF25) + h[1:-1] * np.uint64(0xA24BAED4963EE407) + h[2:]
        at = np.flatnonzero(inside)
        _, place, times = np.unique(keyed(row[at], window[at]), return_inverse=True, return_counts=True)
        twice = at[times[place] >= 2]
        covered[twice] = covered[twice + 1] = covered[twice + 2] = True
    n_repeat_words = np.bincount(row, covered, n).astype(np.int64)

    base = dict(zip(BASE, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), strict=True))
    per_word = 1.0 / np.maximum(n_words, 1)
    per_char = 1.0 / np.maximum(word_chars, 1)
    features = np.stack([
        np.log1p(n_words), word_chars * per_word, n_symbols * per_word, n_dup_lines / np.maximum(n_lines, 1), n_repeat_words * per_word,
        kinds[:, _UPPER] * per_char, kinds[:, _DIGIT] * per_char, kinds[:, _MARK] * per_word,
        kinds[:, _OTHER] * per_char, n_words / np.maximum(n_lines, 1), distinct * per_word,
    ], axis=1) if n else np.empty((0, len(FEATURES)))
    return base, features


@dataclass
class Trees:
    """Full binary trees of one depth as arrays (tree, node); a split that was not worth making sends all rows left."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    prior: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for each row."""
        out = np.full(len(x), self.prior)
        each = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[each, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out


def train(x: np.ndarray, y: np.ndarray, signs: list[int] | None = None, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, weight: float = 4.0) -> Trees:
    """Boost logistic loss by second-order gains over quantile bins.

    signs: -1, 0 or 1 by feature. A split whose leaf values would go against the sign is not made, and the middle
    of the two values bounds everything below, so the whole sum is monotonic.
    """
    inner = 2**depth - 1
    signs = [0] * x.shape[1] if signs is None else signs
    y = y.astype(float)
    rate_good = float(y.mean()) if len(y) else 1.0
    if len(y) == 0 or rate_good in (0.0, 1.0):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 1.0, depth)
    prior = float(np.log(rate_good / (1 - rate_good)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    score = np.full(len(y), prior)
    feature, threshold, value = [], [], []
    leaf = lambda g, h: -g / (h + weight)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            best = 1e-6
            low[2 * k + 1] = low[2 * k + 2] = low[k]
            high[2 * k + 1] = high[2 * k + 2] = high[k]
            if len(mine):
                total_g, total_h = g[mine].sum(), h[mine].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    left_g = np.cumsum(np.bincount(binned[mine, j], g[mine], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[mine, j], h[mine], len(e) + 1))[:-1]
                    a, b = np.clip(leaf(left_g, left_h), low[k], high[k]), np.clip(leaf(total_g - left_g, total_h - left_h), low[k], high[k])
                    gain = left_g**2 / (left_h + weight) + (total_g - left_g) ** 2 / (total_h - left_h + weight) - total_g**2 / (total_h + weight)
                    gain[(left_h < 1) | (total_h - left_h < 1) | (signs[j] * (b - a) < 0)] = -1
                    if gain[i := int(np.argmax(gain))] > best:
                        best, f[k], t[k] = gain[i], j, e[i]
                        if signs[j]:
                            middle = (a[i] + b[i]) / 2
                            up, down = (2 * k + 2, 2 * k + 1) if signs[j] > 0 else (2 * k + 1, 2 * k + 2)
                            low[2 * k + 1 : 2 * k + 3], high[2 * k + 1 : 2 * k + 3] = low[k], high[k]
                            low[up], high[down] = middle, middle
                        else:
                            low[2 * k + 1 : 2 * k + 3], high[2 * k + 1 : 2 * k + 3] = low[k], high[k]
                node[mine] = 2 * k + 1 + (x[mine, f[k]] > t[k])
        at = node - inner
        v = rate * np.clip(leaf(np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)), low[inner:], high[inner:])
        score += v[at]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    return Trees(np.array(feature), np.array(threshold), np.array(value), prior, depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of all rows of at most `rows` labelled ids, chosen by a hash of the id alone."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most `rows` rows


def one_per_id(table: DataFrame, names: list[str], rows: int) -> DataFrame:
    """Of features (doc_id, y, names) one row an id and at most `rows`: what may go to the driver. Rows of one id combine before they are shuffled."""
    least = table.groupBy("doc_id").agg(F.min(F.struct("y", *names)).alias("r"))
    return least.select("doc_id", "r.*").limit(rows)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        _, x = statistics(*buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array(c) for c in x.T)], names=["doc_id", "y", *FEATURES])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fit the trees on a bounded sample of labelled rows; only its features reach the driver."""
    sample = labelled_sample(docs, labels, rows=rows)
    found = sample.transform(arrow_map, _features, "doc_id bigint, y double, " + ", ".join(f"{k} double" for k in FEATURES))
    table = one_per_id(found, list(FEATURES), rows).toPandas().sort_values("doc_id")
    return train(table[list(FEATURES)].to_numpy(float), table["y"].to_numpy(float), list(FEATURES.values()))


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    """Too few words, or over half of them in repeated windows."""
    return (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])


def judge(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the model's log-odds, one row per document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            base, x = statistics(*buffers(batch.column("text")))
            failed, score = base_failed(base), model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(base[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(~failed & (score >= 0)), pa.array(score)], names=["doc_id", *BASE, "base_failed", "kept", "score"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} bigint" for k in BASE) + ", base_failed boolean, kept boolean, score double"
    return docs.select("doc_id", "text").transform(arrow_map, run, schema)


def filter_documents(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        base, x = statistics(*buffers(batch.column("text")))
        return ~base_failed(base) & (model.score(x) >= 0)

    return text_filter(docs, keep)
