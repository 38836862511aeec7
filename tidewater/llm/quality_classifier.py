"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic classifier on byte-class shares gives each document a log-likelihood ratio for good quality. Documents
are counted by path and host (known labels as they are, the rest by their posterior), and each level is shrunk
towards the one above it: host towards the corpus, path towards its host. How strongly is estimated from the data
by the method of moments, so that sparse sites stay near the prior and large ones keep their own rate. A document's
log-odds are its own ratio plus its path's posterior; it is kept if these are not negative.

Only the classifier is fitted on a bounded sample of labelled rows; counts cover all rows. Grouping by path comes
first and combines before the shuffle, so a host with a third of all rows is a few sums.

Null texts count as empty, null hosts and paths as groups of their own, and repeated rows each count. Labels that
disagree on one id are averaged; of rows that repeat a labelled id one is sampled, that of the least features. Odds
of exactly 0 keep a document. A very long text is read whole, as a piece of its own. With no usable labels the ratio
is 0 and every document is kept. Empty tables give no rows. Extra columns pass through `filter_documents` untouched,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, arrow_map, broadcast_if_small, buffers, class_counts, free_name, materialize, pieces, text_filter, words
from .quality_rules import labelled_sample, one_per_id

#: Bound of the labelled rows that the classifier is fitted on.
TRAIN_ROWS = 20_000
#: A document's own evidence is bounded to this many nats.
MOST = 12.0
_CLASSES = [range(65, 91), range(97, 123), range(48, 58), b".,;:'\"-()", b"!?", b"#*$%&", b"|<>", b"\n", range(128, 256)]
FEATURES = len(_CLASSES) + 3
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _k


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Logarithms of byte-class shares, of the word length and of the number of words; rows x FEATURES."""
    starts, stops, bounds = words(data, off)
    n_words = np.diff(bounds)
    size = np.maximum(np.diff(off), 1)
    counts = class_counts(_CLASS, data, off, len(_CLASSES) + 1)[:, :-1]
    columns = list(np.log((counts + 1.0) / (size + 20.0)[:, None]).T)
    held = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=held[1:])
    inside = held[bounds[1:]] - held[bounds[:-1]]
    first = np.zeros(len(starts) + 1, np.int64)
    np.cumsum((data[starts] >= 65) & (data[starts] <= 90), out=first[1:])
    columns += [np.log1p(inside / np.maximum(n_words, 1)), np.log1p(n_words), np.log((first[bounds[1:]] - first[bounds[:-1]] + 1.0) / (n_words + 2.0))]
    return np.stack(columns, axis=1)


@dataclass
class Classifier:
    """Standardised features, their weights, and the share of good labels that the weights were fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    share: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of good to bad, bounded by MOST."""
        own = (x - self.mean) / self.scale @ self.weight + self.bias - np.log(self.share / (1 - self.share))
        return np.clip(own, -MOST, MOST)


def train(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Classifier:
    """Ridge logistic regression by Newton steps; without both labels all evidence is 0."""
    if len(y) == 0 or y.min() == y.max():
        return Classifier(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.5)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    ridge = penalty * np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]), float(y.mean()))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        x = features(*buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array(c) for c in x.T)], names=["doc_id", "y", *(f"f{i}" for i in range(FEATURES))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    """Fit on at most `rows` labelled documents; only their features reach the driver."""
    names = [f"f{i}" for i in range(FEATURES)]
    found = labelled_sample(docs, labels, rows=rows).transform(arrow_map, _features, "doc_id bigint, y double, " + ", ".join(f"{k} double" for k in names))
    table = one_per_id(found, names, rows).toPandas().sort_values("doc_id")
    return train(table[names].to_numpy(float), table["y"].to_numpy(float))


def scored(docs: DataFrame, model: Classifier, host: str, path: str) -> DataFrame:
    """doc_id, host, path and evidence of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = model.evidence(features(*buffers(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(own)], names=["doc_id", "host", "path", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    light = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), "text")
    return light.transform(arrow_map, run, f"doc_id {kind}, host string, path string, evidence double")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(rates: DataFrame, target: Column) -> float:
    """Pseudo-count by which a level is shrunk to `target`: what variance is left beyond that of binomial sampling."""
    n, r = F.col("n"), F.col("good") / F.col("n")
    got = rates.agg(F.sum(n).alias("n"), F.count("*").alias("sites"), F.sum(n * (r - target) ** 2).alias("spread"), F.sum(target * (1 - target)).alias("noise"), F.sum(n * target * (1 - target)).alias("scale")).first()
    if not got["sites"] or got["sites"] < 2 or not got["scale"]:
        return 100.0
    between = max(0.0, got["spread"] - got["noise"]) / got["n"]
    within = got["scale"] / got["n"]
    return float(np.clip(within / between - 1 if between > 0 else 1e4, 1.0, 1e4))


def sites(light: DataFrame, labels: DataFrame, share: float) -> tuple[DataFrame, float]:
    """Posterior rate of good documents for each (host, path), and the corpus rate.

    light: scored rows; labels: doc_id, quality. Labelled documents count by their labels.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    own = F.lit(1.0) / (1 + F.exp(-(F.col("evidence") + float(np.log(share / (1 - share))))))
    counted = light.join(known, "doc_id", "left").select("host", "path", F.coalesce("label", own).alias("p"))
    by_path = materialize(counted.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "sites")
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = by_host.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (total["good"] + 1.0) / (total["n"] + 2.0) if total["n"] else 0.5
    pull = _strength(by_host, F.lit(rate))
    hosts = by_host.select("host", ((F.col("good") + pull * rate) / (F.col("n") + pull)).alias("host_rate"))
    both = by_path.join(hosts, "host")
    pull = _strength(both, F.col("host_rate"))
    return both.select("host", "path", "n", "host_rate", ((F.col("good") + pull * F.col("host_rate")) / (F.col("n") + pull)).alias("path_rate")), rate


def _bytes(rates: DataFrame) -> int:
    """Size of a table of sites: their names may be long."""
    return rates.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()[0]


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", model: Classifier | None = None) -> DataFrame:
    """doc_id, evidence, host and path posterior rates, posterior of good quality and kept, one row per document row."""
    model = model or fit(docs, labels)
    light = materialize(scored(docs, model, host, path), "evidence")
    rates, _ = sites(light, labels, model.share)
    rates = materialize(rates, "rates")
    odds = F.col("evidence") + _logit(F.col("path_rate"))
    joined = light.join(broadcast_if_small(rates, _bytes(rates), BROADCAST_BYTES), ["host", "path"])
    return joined.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-odds))).alias("quality"), (odds >= 0).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", model: Classifier | None = None) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    Texts are not shuffled: evidence is read a second time beside the site's rate, which is broadcast if small.
    """
    model = model or fit(docs, labels)
    rates, _ = sites(materialize(scored(docs, model, host, path), "evidence"), labels, model.share)
    rates = materialize(rates, "rates")
    own_host, own_path, own_prior = (free_name(docs, k) for k in ("site_host", "site_path", "site_prior"))
    prior = broadcast_if_small(rates, _bytes(rates), BROADCAST_BYTES).select(F.col("host").alias(own_host), F.col("path").alias(own_path), _logit(F.col("path_rate")).alias(own_prior))
    at = (F.coalesce(docs[host].cast("string"), F.lit("")) == F.col(own_host)) & (F.coalesce(docs[path].cast("string"), F.lit("")) == F.col(own_path))
    beside = docs.join(prior, at, "left").drop(own_host, own_path)

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        return ~(model.evidence(features(*buffers(batch.column("text")))) + batch.column("prior").to_numpy(zero_copy_only=False) < 0)

    return text_filter(beside, keep, prior=F.col(own_prior)).drop(own_prior)
