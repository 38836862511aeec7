"""Phrase collocation mining after Toivonen: a sample proposes phrases, full passes count them and their negative border.

A phrase can only be frequent if its first words without the last, and its last words without the first, are. So the first
pass over all texts counts, beside all single words, every phrase whose two such parts are proposed: this covers the
proposed phrases and the whole negative border (what is not proposed although its parts are), as far as it occurs at all.
It counts by 64-bit keys, so that the many phrases of the border, nearly all of them rare, travel as numbers; as keys could
collide, these counts are upper bounds. If a phrase of the border is frequent, the sample missed it: a failure. Any frequent
phrase that the pass did not count holds a failure, for its smallest part that is not proposed is in the border, and as
frequent at least. So the second pass counts, word by word, all phrases with a frequent key, and expands all failures: it
also counts, at any length at once, what holds a failure and only has frequent words. With it the set is closed, and the
result exact, whatever the sample was and whichever keys collide.

Phrases that are proposed, frequent by their keys, or failures are held in filters of FILTER_BITS bits, the one thing that
every task gets; their size does not grow with the corpus. A bit set for two phrases lets a pass count a phrase more than
it had to, which changes no result. In a task phrases get numbers from their words, each distinct phrase leaves with its
count, and grouping adds up, with sums in each task first, so that a very common phrase or language is a row a task. Keys
travel packed, many to a row, in groups by their high bits. Texts are never shuffled.

Null text counts as empty, null language as `und`. A very long text is a piece of its own. Repeated rows count each; ids
are not read. Ties of score go by frequency, then by the phrase's bytes. An empty table gives no phrases. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_map, buffers, distinct_spans, flat, key_groups, materialize, mix64, packed, pieces, release, span_hashes, unpacked, words

MOST_WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: Share of the text in the sample: a stretch of STRETCH bytes every so often, so that what repeats within one document is seen
#: as well. A phrase is proposed at half the count that MIN_COUNT gives to expect there.
SAMPLE_SHARE, STRETCH = 1 / 16, 512
#: Bits of a filter of phrases (8 MiB).
FILTER_BITS = 1 << 26
#: Bytes of text that a task works on at once, and keys that it holds before they are counted.
PIECE_BYTES, HELD_KEYS = 1 << 20, 1 << 20
#: Groups that a language's phrases are dealt into before the last ranking, which sees TOP rows of each.
DEALT = 256

_SPLIT = np.zeros(256, bool)
_SPLIT[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _SPLIT.copy()
_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Filter:
    """Which phrases are proposed, by two bits each: no proposed phrase is missing, some others are let through."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def empty() -> Filter:
        return Filter(np.zeros(FILTER_BITS // 8, np.uint8))

    @staticmethod
    def places(keys: np.ndarray) -> np.ndarray:
        return np.stack([keys & np.uint64(FILTER_BITS - 1), (keys >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)]).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        p = self.places(keys)
        return ((self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=0)


class Piece:
    """The words of some texts: lower-cased, with the language's hash in theirs, and which of them follow each other in a piece."""

    def __init__(self, data: np.ndarray, off: np.ndarray, langs: list[str]) -> None:
        lower = _LOWER[data]
        starts, stops, bounds = words(lower, off, _GAP)
        names = list(dict.fromkeys(langs))
        number = {x: i for i, x in enumerate(names)}
        per_row = np.array([number[x] for x in langs], np.int64)
        self.langs, self.lang = names, np.repeat(per_row, np.diff(bounds))
        hashes = np.array([xxh64_intdigest(x.encode()) for x in names], np.uint64)
        self.hash = mix64(span_hashes(lower, starts, stops) + (hashes[self.lang] if len(names) else np.zeros(0, np.uint64)))
        splits = np.concatenate([[0], np.cumsum(_SPLIT[lower])])
        self.joined = splits[starts[1:]] == splits[stops[:-1]]
        self.joined[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(starts))] - 1] = False
        self._spans = lower, starts, stops

    @cached_property
    def word(self) -> np.ndarray:
        """Numbers of the words, by language and bytes."""
        same = distinct_spans(*self._spans)[1]
        return np.unique(same * max(1, len(self.langs)) + self.lang, return_inverse=True)[1].reshape(-1)

    @cached_property
    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with one space behind each, so that a phrase is a slice, and where each word begins and ends there."""
        lower, starts, stops = self._spans
        lengths = stops - starts
        ends = np.cumsum(lengths + 1) - 1
        text = np.full(int(lengths.sum()) + len(starts), 0x20, np.uint8)
        text[flat(ends - lengths, lengths)] = lower[flat(starts, lengths)]
        return text, ends - lengths, ends

    def levels(self, chosen: Filter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 1 .. MOST_WORDS words: where the phrases begin whose two parts are chosen (all, without a filter), and their keys."""
        at, key = np.arange(len(self.hash)), self.hash
        for k in range(1, MOST_WORDS + 1):
            yield k, at, key
            if chosen is not None:
                ok = chosen.has(key)
                at, key = at[ok], key[ok]
            both = at[1:] == at[:-1] + 1
            if k == 1:
                both &= self.joined[at[:-1]]
            at, key = at[:-1][both], key[:-1][both]
            key = mix64(key * _STEP + self.hash[at + k])

    def picked(self, chosen: Filter, often: Filter, failed: Filter) -> Iterator[tuple[int, np.ndarray]]:
        """Words of a phrase, and where those begin that the second pass counts: with a frequent key, or expanding a failure."""
        holds = failed.has(self.hash)
        words = whole = often.has(self.hash)
        for k, at, key in self.levels(chosen):
            end = max(0, len(self.hash) - k + 1)
            if k > 1:
                whole = whole[:end] & words[k - 1 :] & self.joined[k - 2 :]
                holds = holds[:end] | holds[1 : end + 1]
            take = whole & holds
            take[at] = often.has(key)  # the first pass counted these
            holds[at[failed.has(key)]] = True
            yield k, np.flatnonzero(take)

    def counts(self, chosen: Filter, often: Filter, failed: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Words of a phrase, where each distinct phrase of the second pass begins first, and how often it occurs."""
        many = int(self.word.max(initial=0)) + 1
        for k, at in self.picked(chosen, often, failed):
            ids = self.word[at]
            for j in range(1, k):
                ids = np.unique(ids, return_inverse=True)[1].reshape(-1) * many + self.word[at + j]
            _, first, n = np.unique(ids, return_index=True, return_counts=True)
            yield k, at[first], n

    def phrases(self, first: np.ndarray, k: int) -> pa.Array:
        """Texts of the phrases of k words from these words on."""
        text, begins, ends = self.spaced
        begins, lengths = begins[first], ends[first + k - 1] - begins[first]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(text[flat(begins, lengths)]))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def _bits(keys: DataFrame) -> DataFrame:
    """slot and bits of the filter, from a table of keys."""
    mask = FILTER_BITS - 1
    place = F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 32).bitwiseAND(mask))).alias("place")
    one = F.expr("shiftleft(1L, int(place & 63))")
    return keys.select(place).groupBy(F.expr("int(place >> 6)").alias("slot")).agg(F.bit_or(one).alias("bits"))


def gathered(keys: DataFrame) -> Filter:
    """The filter of all keys. What reaches the driver is the filter itself, FILTER_BITS at most."""
    found, out = _bits(keys).toArrow(), Filter.empty()
    out.bits.view(np.int64)[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return out


def stretches(data: np.ndarray, off: np.ndarray, langs: list[str], share: float, at: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A share of some texts, from byte `at` of them on, as texts of their own; words torn at their ends are proposals too many at most."""
    begin = np.arange(at, len(data), max(STRETCH, round(STRETCH / share)))
    row = np.searchsorted(off, begin, "right") - 1
    size = np.minimum(STRETCH, off[row + 1] - begin)
    return data[flat(begin, size)], np.concatenate([[0], np.cumsum(size)]), [langs[r] for r in row.tolist()]


def _summed(batches: Iterator[np.ndarray], groups: int) -> Iterator[pa.RecordBatch]:
    """Keys and how often they occur, for HELD_KEYS of them at a time: a row a group of keys, as the high bits deal them."""
    held, size = [np.zeros(0, np.uint64)], 0
    for last, keys in itertools.chain(((False, k) for k in batches), [(True, np.zeros(0, np.uint64))]):
        held.append(keys)
        size += len(keys)
        if size >= HELD_KEYS or (last and size):
            found, n = np.unique(np.concatenate(held), return_counts=True)
            yield packed(found, {"keys": found, "n": n.astype("<u4")}, groups)
            held, size = [np.zeros(0, np.uint64)], 0
            release()


def _often(docs: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], min_count: int) -> DataFrame:
    """The keys that `keys` finds min_count times or more in the texts; tasks send packed counts, and a group of keys is counted at a time."""
    groups = key_groups(docs.sparkSession)

    def count(table: pa.Table) -> pa.Table:
        key, n = unpacked(table, "keys", np.uint64), unpacked(table, "n", "<u4")
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        often = np.add.reduceat(n[order].astype(np.int64), first) >= min_count
        return pa.table({"key": key[first[often]].view(np.int64)})

    counts = _texts(docs).transform(arrow_map, lambda b: _summed(keys(b), groups), "dealt int, keys binary, n binary")
    return counts.groupBy("dealt").applyInArrow(count, "key bigint")


def proposed(docs: DataFrame, share: float = SAMPLE_SHARE, min_count: int = MIN_COUNT) -> DataFrame:
    """Keys of phrases that are frequent in a sample of the texts, at half the count to expect of a frequent one."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        chance = np.random.default_rng(13)
        for batch in pieces(batches, limit=round(PIECE_BYTES / max(share, 1 / 16))):
            at = int(chance.integers(0, max(STRETCH, round(STRETCH / share))))
            piece = Piece(*stretches(*buffers(batch.column("text")), batch.column("lang").to_pylist(), share, 0 if share >= 1 else at))
            yield from (key for k, _, key in piece.levels(None) if k < MOST_WORDS)

    return _often(docs, keys, max(1, int(min_count * share / 2)))


def frequent_keys(docs: DataFrame, chosen: Filter, min_count: int = MIN_COUNT) -> DataFrame:
    """The first pass: keys, of the phrases that are proposed or in their border, that occur min_count times or more."""
    sent = docs.sparkSession.sparkContext.broadcast(chosen.bits)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in pieces(batches, limit=PIECE_BYTES):
            piece = Piece(*buffers(batch.column("text")), batch.column("lang").to_pylist())
            yield from (key for _, _, key in piece.levels(Filter(sent.value)))

    return _often(docs, keys, min_count)


def lacking(keys: DataFrame, chosen: Filter) -> DataFrame:
    """The keys that are not proposed."""
    sent = keys.sparkSession.sparkContext.broadcast(chosen.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~Filter(sent.value).has(batch.column("key").to_numpy().view(np.uint64))))

    return keys.transform(arrow_map, run, "key bigint")


def counted(docs: DataFrame, chosen: Filter, often: Filter, failed: Filter) -> DataFrame:
    """The second pass: lang, words, phrase and n; a row of no words for each language has the number of its words."""
    sent = docs.sparkSession.sparkContext.broadcast((chosen.bits, often.bits, failed.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Filter(b) for b in sent.value]
        for batch in pieces(batches, limit=PIECE_BYTES):
            piece = Piece(*buffers(batch.column("text")), batch.column("lang").to_pylist())
            names = pa.array(piece.langs, pa.string())
            n = np.bincount(piece.lang, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.array([0] * len(names), pa.int32()), pa.array([""] * len(names)), pa.array(n)], names=["lang", "words", "phrase", "n"])
            for k, first, n in piece.counts(*filters):
                yield pa.RecordBatch.from_arrays([
                    names.take(pa.array(piece.lang[first])), pa.array(np.full(len(first), k, np.int32)), piece.phrases(first, k), pa.array(n),
                ], names=["lang", "words", "phrase", "n"])

    rows = _texts(docs).transform(arrow_map, run, "lang string, words int, phrase string, n bigint")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def frequencies(docs: DataFrame, min_count: int = MIN_COUNT, share: float = SAMPLE_SHARE) -> DataFrame:
    """lang, words, phrase and n of every phrase of 1 .. MOST_WORDS words that occurs min_count times or more; words = 0: all words."""
    chosen = gathered(proposed(docs, share, min_count))
    keys = materialize(frequent_keys(docs, chosen, min_count), "frequent-keys")
    often, failed = gathered(keys), gathered(lacking(keys, chosen))
    return materialize(counted(docs, chosen, often, failed).where((F.col("n") >= min_count) | (F.col("words") == 0)), "phrases")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, share: float = SAMPLE_SHARE) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n and score.

    a, l and r count the phrase and its two parts at the cut of the lowest score, n all words of the language. A phrase is
    left out where a longer one, which holds it, is as frequent; of those one word longer suffices, as any between is too.
    """
    found = frequencies(docs, min_count, share)
    totals = found.where("words = 0").select("lang", F.col("n").alias("total"))
    known = found.where("words > 0").select("lang", "words", "phrase", F.col("n").alias("a"))
    long = F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    held = known.where("words > 2").select("lang", F.explode(F.array(*long)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = known.where("words > 1").join(held, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = alone.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("first", F.expr("substring_index(phrase, ' ', cut)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    part = lambda whole, name: known.select("lang", F.col("phrase").alias(whole), F.col("a").alias(name))
    parts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = parts.withColumns({"_up": F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("total"), "_down": wide("l") * wide("r")}).withColumn("score", F.expr("_up div _down"))
    best = scored.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    rows = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    heads = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
