"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 0.8 or more, by T-occurrence search.

Words are runs `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; shingles are 64-bit hashes of five words (fewer words:
the whole sequence is one). A link needs |A & B| >= T with T = ceil(0.8 * size) of the larger set.

1. Equal sets are one representative each.
2. Each set offers its smallest hashes (its prefix), long enough that linked sets share at least K of them. A hash is an
   inverted list of the sets that offer it. The search runs over these lists twice, and every link comes from it.
3. The first time it looks at neighbours only: where two lists that follow each other in a prefix meet, the sets that
   both hold are put in order of their next hashes, and each meets the two before it if sizes allow a link. This grows with the rows,
   however large a group of near copies, and what it links is one component from then on.
4. The second time it looks at whole lists, for pairs of different components; lists of one document drop out. As in
   DivideSkip a document sets its longest K - MEET lists aside, and only its short ones are merged: a task gets all
   short lists of a query, heap-merges them and counts how often each document occurs. Of K shared lists at least MEET
   are short for both, so that a pair is retained if it occurs MEET times. For what is retained, both times, the rest of
   the lists is probed: whether a list holds a document is whether the list's hash is among the document's sorted
   hashes, a binary search. A pair stays if the overlap reaches T. The components of all links are the result.
5. A query that finds more than DENSE documents in one list, or in all (documents much alike, but not linked), is not
   paired by rows, and its lists are not sent. It makes a block with all that share a list with it; blocks of queries
   meet blocks of documents in one task, where the same T-occurrence search runs over a local index: short lists are
   merged, long ones probed by binary search, so that counts are overlaps. It returns the links between components
   only; no row stands for a pair that is not linked.

Lists of more than 2 * DENSE documents are never held, queries with many candidates are salted, and counts combine
before shuffles; no list, group or component is held by one task. Ties in list length break by hash.

Null and empty texts have no shingles and link with nothing. A very long text is a piece of its own. Rows without an
id are returned with their size and no component. Rows that repeat an id count as one document: its largest set is
searched, and all get one component.
An empty table gives no rows. Extra columns are ignored (`keep_first` passes them through).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, arrow_map, broadcast_if_small, buffers, flat, free_name, materialize, mix64, pieces, rows_of, span_hashes, words
from .graph import components

SHINGLE = 5
#: Places of a prefix where the first search looks for two lists that meet.
HEADS = 8
#: Linked sets share at least so many hashes of their prefixes (small sets offer all they have).
LEAST_SHARED = 24
#: Documents of a block, and candidates of a query's salt.
CHUNK = 1024
SALT_ROWS = 2048
#: Candidates up to which a query is checked pair by pair.
DENSE = 64
#: How many short lists a linked pair shares at least (sets of one hash have no links but to equal sets).
MEET = 2
#: Above so many documents a list's length is not counted further: it is long.
LONG = 4096

_rng = np.random.Generator(np.random.PCG64(77))
_STEP = _rng.integers(1, 1 << 62, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def needed(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n must share with any linked set: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def shared(n: np.ndarray) -> np.ndarray:
    """K: how many hashes of their prefixes two linked sets share at least, if the smaller has n."""
    return np.minimum(needed(n), np.maximum(LEAST_SHARED, n // 12))


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingle hashes, ascending within a row, and each row's first."""
    n = len(off) - 1
    starts, stops, bounds = words(data, off)
    count = np.diff(bounds)
    h = span_hashes(data, starts, stops, fold=True)
    number = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    at = flat(bounds[:-1], number)
    row = rows_of(np.concatenate([[0], np.cumsum(number)]))
    value = np.zeros(len(at), np.uint64)
    last = bounds[1:][row]
    for k in range(SHINGLE):
        here = np.minimum(at + k, len(h) - 1)
        value += np.where(at + k < last, h[here] * _STEP[k] if len(h) else 0, np.uint64(k + 1)).astype(np.uint64)
    value = mix64(value)
    parts, sizes = [], np.zeros(n, np.int64)
    ends = np.concatenate([[0], np.cumsum(number)]).tolist()
    for i in range(n):
        s = np.sort(value[ends[i] : ends[i + 1]])
        if len(s) > 1:
            s = s[np.append(True, s[1:] != s[:-1])]
        parts.append(s)
        sizes[i] = len(s)
    return np.concatenate(parts) if parts else value, np.concatenate([[0], np.cumsum(sizes)])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values, begin = shingle_sets(*buffers(batch.column("text")))
        n = np.diff(begin)
        full = np.flatnonzero(n)
        digest = np.zeros((2, len(n)), np.int64)
        if len(full):
            at = begin[:-1][full]
            digest[0, full] = np.add.reduceat(mix64(values), at).view(np.int64)
            digest[1, full] = np.add.reduceat(mix64(values ^ np.uint64(0x5BF03635)), at).view(np.int64)
        length = np.where(n > 0, n - needed(n) + shared(n), 0)
        prefix = values[flat(begin[:-1], length)].view(np.int64)
        off = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("tkey"), pa.array(n), pa.array(digest[0]), pa.array(digest[1]),
            pa.ListArray.from_arrays(off, pa.array(prefix)),
        ], names=["doc_id", "tkey", "n", "d1", "d2", "prefix"])


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (a hash of the text: it tells rows of one id apart) and text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, set size n, two digests of the set and prefix of every row."""
    return keyed_texts(docs).transform(arrow_map, _measure, "doc_id bigint, tkey bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of token: those of tokens with two documents at least, with the list's length (LONG at most)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, token, known_long = 0, None, False

    def out(t: np.ndarray, d: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(np.minimum(c, LONG).astype(np.int32))], names=["doc_id", "token", "size"])

    def rest() -> Iterator[pa.RecordBatch]:
        if size >= 2 and held:
            t, d = (np.concatenate(x) for x in zip(*held, strict=True))
            yield out(t, d, np.full(len(t), LONG if known_long else size))

    for batch in batches:
        t, d = batch.column("token").to_numpy(), batch.column("doc_id").to_numpy()
        if not len(t):
            continue
        new = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        sizes = np.diff(np.append(new, len(t)))
        if token is not None and t[0] == token:
            head = sizes[0]
            held.append((t[:head], d[:head]))
            size += head
            if size > LONG:  # no need to hold a list whose length is known to be long
                known_long = True
                yield from rest()
                held = []
            if head == len(t):
                continue
            new, sizes = new[1:], sizes[1:]
        yield from rest()
        each = np.repeat(sizes[:-1], sizes[:-1])
        keep = each >= 2
        body = slice(new[0], new[-1])
        if keep.any():
            yield out(t[body][keep], d[body][keep], each[keep])
        held, size, token, known_long = [(t[new[-1] :], d[new[-1] :])], int(sizes[-1]), t[-1], False
    yield from rest()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (query, component, major, docs, components of a list) in order of query: documents and how many lists have them, by a heap merge.

    A pair is counted by the side that is not in a list's major component, by the smaller id if neither is. A query
    with more than DENSE documents is returned once, without any.
    """
    queries: list[int] = []
    found: list[int | None] = []
    times: list[int] = []

    def search(query: int, lists: list[list[int]]) -> None:
        mine: list[int | None] = []
        counts: list[int] = []
        for doc in heapq.merge(*lists):
            if mine and doc == mine[-1]:
                counts[-1] += 1
            elif len(mine) == DENSE:
                mine, counts = [None], [0]
                break
            else:
                mine.append(doc)
                counts.append(1)
        found.extend(mine)
        times.extend(counts)
        queries.extend([query] * len(mine))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(found, pa.int64()), pa.array(times, pa.int64())], names=["a", "b", "times"])

    at, lists = None, []
    for batch in batches:
        for query, own, major, docs, comps in zip(*(batch.column(k).to_pylist() for k in ("query", "component", "major", "docs", "components")), strict=True):
            if query != at:
                if at is not None:
                    search(at, lists)
                at, lists = query, []
            lists.append([d for d, c in zip(docs, comps, strict=True) if c != own and (c == major or query < d)])
        if len(found) > 100_000:
            yield out()
            queries, found, times = [], [], []
    if at is not None:
        search(at, lists)
    yield out()


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of rows as binaries, beside where they go."""
    for batch in pieces(batches):
        values, begin = shingle_sets(*buffers(batch.column("text")))
        raw = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((begin * 8).astype(np.int64)), pa.py_buffer(values)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("routes"), raw.cast(pa.binary())], names=["doc_id", "routes", "members"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (query, salt, other or null for the query itself, members) in order: the pairs that are linked."""
    a: list[int] = []
    b: list[int] = []
    query, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        data, off = buffers(batch.column("members"))
        for i, (q, other) in enumerate(zip(batch.column("query").to_pylist(), batch.column("other").to_pylist(), strict=True)):
            members = data[off[i] : off[i + 1]].view(np.uint64)
            if other is None:
                query, own = q, members
            elif q == query and len(own) and 4 * max(len(own), len(members)) <= 5 * min(len(own), len(members)):
                overlap = int((own[np.minimum(np.searchsorted(own, members), len(own) - 1)] == members).sum())
                if 100 * overlap >= 80 * (len(own) + len(members) - overlap):
                    a.append(q)
                    b.append(other)
        if len(a) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. texts: one row per document that may occur (doc_id, text).

    Each text is read once and its set sent to every query that asks for it; a query with many partners is there
    once for each salt.
    """
    pairs = materialize(pairs, "pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    salted = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    to_queries = salts.select(F.col("a").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("query"))
    route = F.struct(F.col("query"), F.col("salt"), F.col("itself"))
    routes = (
        to_queries.select("doc_id", "query", "salt", F.lit(True).alias("itself")).unionByName(salted.select(F.col("b").alias("doc_id"), F.col("a").alias("query"), "salt", F.lit(False).alias("itself")))
        .groupBy("doc_id").agg(F.collect_list(route).alias("routes"))
    )
    routes = materialize(routes, "routes")
    size = routes.agg(16 * F.count("*") + 24 * F.coalesce(F.sum(F.size("routes")), F.lit(0))).first()[0]  # bytes
    asked = texts.join(broadcast_if_small(routes, size, BROADCAST_BYTES), "doc_id").select("doc_id", "text", "routes")
    kind = "array<struct<query: bigint, salt: int, itself: boolean>>"
    sent = asked.transform(arrow_map, _routed, f"doc_id bigint, routes {kind}, members binary").select("doc_id", "members", F.explode("routes").alias("r"))
    sent = sent.select(F.col("r.query").alias("query"), F.col("r.salt").alias("salt"), F.when(~F.col("r.itself"), F.col("doc_id")).alias("other"), "members")
    return sent.repartition("query", "salt").sortWithinPartitions("query", "salt", F.col("other").asc_nulls_first()).transform(arrow_map, _verified, "a bigint, b bigint")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (lists, next, doc_id): each document with the one and the two places before it in its lists, if their sizes allow a link."""
    v, d, n = (np.zeros(0, np.int64) for _ in range(3))
    for batch in batches:
        v, d, n = (np.concatenate([x[-2:], batch.column(k).to_numpy()]) for k, x in (("lists", v), ("doc_id", d), ("n", n)))
        fresh = len(v) - batch.num_rows  # pairs between rows carried over are known
        x, y = [], []
        for back in (1, 2):
            at = np.flatnonzero(v[back:] == v[:-back]) + back if len(v) > back else np.zeros(0, np.int64)
            at = at[(at >= fresh) & (d[at] != d[at - back]) & (5 * np.minimum(n[at], n[at - back]) >= 4 * np.maximum(n[at], n[at - back]))]
            x.append(d[at - back])
            y.append(d[at])
        x, y = np.concatenate(x), np.concatenate(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _neighbour_pairs(reps: DataFrame) -> DataFrame:
    """Step 3: pairs (a, b) of representatives that are neighbours where two lists meet."""
    at = lambda k: F.get("prefix", F.col("pos") + k)
    heads = reps.where(F.size("prefix") > 1).select("doc_id", "n", F.slice("prefix", 1, HEADS + 2).alias("prefix"), F.explode(F.sequence(F.lit(0), F.least(F.lit(HEADS), F.size("prefix") - 1) - 1)).alias("pos"))
    rows = heads.select(F.xxhash64(at(0), at(1)).alias("lists"), F.coalesce(at(2), F.lit(0)).alias("next"), "doc_id", "n")
    order = ["lists", "next", "doc_id"]  # ranges of the whole order: two lists that very many sets share are cut too
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).transform(arrow_map, _neighbours, "a bigint, b bigint").distinct()


def _list_pairs(reps: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Step 4: retained pairs (a, b) of different components, dense queries (a), and the lists' rows (token, doc_id, component)."""
    postings = reps.select(F.explode("prefix").alias("token"), "doc_id").repartition("token").sortWithinPartitions("token").transform(arrow_map, _counted, "doc_id bigint, token bigint, size int")
    ordered = F.sort_array(F.collect_list(F.struct("size", "token")))
    lists = postings.groupBy("doc_id").agg(ordered.alias("lists")).join(reps.select("doc_id", "n"), "doc_id")
    less = F.expr("(4 * n + 4) div 5")  # the smallest set that can be linked
    aside = F.greatest(F.lit(0), F.least(F.expr("(4 * ((4 * n + 4) div 5) + 4) div 5"), F.greatest(F.lit(LEAST_SHARED), F.floor(less / 12))) - MEET)
    short = lists.select("doc_id", F.explode(F.slice("lists", F.lit(1), F.greatest(F.lit(0), F.size("lists") - aside).cast("int"))).alias("l")).select(F.col("l.token").alias("token"), "doc_id")
    short = materialize(short.join(comp, "doc_id", "left").select("token", "doc_id", F.coalesce("component", "doc_id").alias("component")), "lists")
    # Lists within one component have nothing to find. Else all but the largest component's documents are queries.
    by_comp = short.groupBy("token", "component").agg(F.count("*").alias("own"))
    mixed = by_comp.groupBy("token").agg(F.max(F.struct("own", "component")).alias("most"), F.count("*").alias("comps"), F.sum("own").alias("listed")).where("comps > 1")
    mixed = materialize(mixed.select("token", F.col("most.component").alias("major"), "listed").join(by_comp, "token"), "mixed-lists")
    rows = materialize(short.join(mixed, ["token", "component"]).select("token", "doc_id", "component", "major", "listed", (F.col("listed") - F.col("own")).alias("others")), "mixed")
    # A list that gives a query more than DENSE documents says so without being sent.
    known = materialize(rows.where((F.col("component") != F.col("major")) & (F.col("others") > DENSE)).select("doc_id").distinct(), "dense")
    queries = rows.where(F.col("component") != F.col("major")).join(known, "doc_id", "left_anti").select("token", F.col("doc_id").alias("query"), "component", "major")
    # The lists of all other queries have 2 * DENSE documents at most, as no component has more of them than the major one.
    members = rows.where(F.col("listed") <= 2 * DENSE).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("doc_id", "component"))).alias("l"))
    members = members.select("token", F.col("l.doc_id").alias("docs"), F.col("l.component").alias("components"))
    asked = queries.join(members, "token").select("query", "component", "major", "docs", "components")
    found = materialize(asked.repartition("query").sortWithinPartitions("query").transform(arrow_map, _merged, "a bigint, b bigint, times bigint"), "found")
    pairs = found.where("b is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("times").alias("times")).where(F.col("times") >= MEET).select("a", "b")
    return pairs, known.select(F.col("doc_id").alias("a")).unionByName(found.where("b is null").select("a")), rows.select("token", "doc_id", "component")


def _search(ids: np.ndarray, comps: np.ndarray, asks: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that connect components, between asking sets and the others (and among asking ones): DivideSkip on a local index.

    asks: 1 for a query, 0 for a set of the index; -1 is both.
    """
    n = np.array([len(s) for s in sets])
    off = np.concatenate([[0], np.cumsum(n)])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    _, root = np.unique(comps, return_inverse=True)
    held = np.flatnonzero(asks <= 0)
    listed = token[flat(off[held], n[held])]
    size = np.bincount(listed, minlength=int(token.max()) + 1)
    members = np.repeat(held, n[held])[np.argsort(listed, kind="stable")]  # ascending in each list
    begin = np.cumsum(size) - size
    a, b = [], []
    for i in np.flatnonzero(asks != 0).tolist():
        own = token[off[i] : off[i + 1]]
        own = own[np.argsort(size[own], kind="stable")]
        least = int(needed(n[i]))  # T
        aside = min(least - 1, int(least / (0.01 * np.log2(int(size[own[-1]]) + 2) + 1)))
        short, long = own[: n[i] - aside], own[n[i] - aside :]
        near, overlap = np.unique(members[flat(begin[short], size[short])], return_counts=True)
        keep = (overlap >= least - aside) & (near != i) & (root[near] != root[i]) & (5 * np.minimum(n[near], n[i]) >= 4 * np.maximum(n[near], n[i]))
        near, overlap = near[keep], overlap[keep]
        if not len(near):
            continue
        for t in long.tolist():
            probed = members[begin[t] : begin[t] + size[t]]
            if len(probed):
                overlap += probed[np.minimum(np.searchsorted(probed, near), len(probed) - 1)] == near
        for j in near[100 * overlap >= 80 * (n[near] + n[i] - overlap)].tolist():
            if root[j] != root[i]:
                a.append(int(ids[j]))
                b.append(int(ids[i]))
                root[root == root[j]] = root[i]
    return a, b


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (block, i, j, doc_id, component, asks, members) in order of the first three: links of each group."""
    key, held = None, []

    def links() -> pa.RecordBatch:
        a, b = _search(*(np.array([h[k] for h in held]) for k in range(3)), [h[3] for h in held]) if len(held) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        data, off = buffers(batch.column("members"))
        columns = [batch.column(k).to_pylist() for k in ("block", "i", "j", "doc_id", "component", "asks")]
        for r, (block, i, j, doc, comp, asks) in enumerate(zip(*columns, strict=True)):
            if (block, i, j) != key:
                yield links()
                key, held = (block, i, j), []
            held.append((doc, comp, asks, data[off[r] : off[r + 1]].copy().view(np.uint64)))
    yield links()


def _block_links(dense: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Step 5: links (a, b) of dense queries with all that share a list with them."""
    asking = materialize(dense.select(F.col("a").alias("doc_id")).distinct(), "asking")
    lists = rows.join(asking, "doc_id", "left_semi").select("token").distinct()
    inside = materialize(rows.join(lists, "token", "left_semi"), "dense-lists")
    blocks = components(inside.join(inside.groupBy("token").agg(F.min("doc_id").alias("a")), "token").select("a", F.col("doc_id").alias("b")))
    docs = inside.select("doc_id", "component").distinct().join(blocks.select(F.col("node").alias("doc_id"), F.col("component").alias("block")), "doc_id")
    docs = materialize(docs.join(asking.withColumn("asking", F.lit(True)), "doc_id", "left").withColumn("asking", F.coalesce("asking", F.lit(False))), "dense-documents")
    parts = lambda n: F.ceil(n / CHUNK).cast("int")
    sizes = docs.groupBy("block").agg(parts(F.count("*")).alias("parts"), parts(F.count_if("asking")).alias("asking_parts"))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    route = lambda i, j, asks: F.struct(F.col("block").alias("block"), i.alias("i"), j.alias("j"), F.lit(asks).alias("asks"), F.col("component").alias("component"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = F.transform(upto("asking_parts"), lambda i: route(i, own("parts"), 0))
    asks = F.transform(upto("parts"), lambda j: route(own("asking_parts"), j, 1))
    whole = (F.col("parts") == 1) & (F.col("asking_parts") == 1)
    both = F.array(route(F.lit(0), F.lit(0), -1))
    goes = F.when(whole, F.when(F.col("asking"), both).otherwise(held)).when(F.col("asking"), F.concat(held, asks)).otherwise(held)
    routes = materialize(docs.join(sizes, "block").select("doc_id", goes.alias("routes")), "blocks")
    size = routes.agg(16 * F.count("*") + 40 * F.coalesce(F.sum(F.size("routes")), F.lit(0))).first()[0]  # bytes
    kind = "array<struct<block: bigint, i: int, j: int, asks: int, component: bigint>>"
    sent = texts.join(broadcast_if_small(routes, size, BROADCAST_BYTES), "doc_id").select("doc_id", "text", "routes").transform(arrow_map, _routed, f"doc_id bigint, routes {kind}, members binary")
    sent = sent.select("doc_id", "members", F.inline("routes"))
    order = ["block", "i", "j"]
    return sent.repartition(*order).sortWithinPartitions(*order, "doc_id").transform(arrow_map, _searched, "a bigint, b bigint")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per document row."""
    sets = materialize(measured(docs), "sets")
    light = sets.select("doc_id", "tkey", "n", "d1", "d2")
    single = light.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n", "d1", "d2", "tkey")).alias("s")).select("doc_id", "s.*")
    firsts = single.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    chosen = single.join(firsts.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    reps = materialize(sets.where("n > 0").join(chosen.select("doc_id", "tkey"), ["doc_id", "tkey"]).dropDuplicates(["doc_id"]), "reps")
    # A representative's text: of rows that repeat an id, one whose set was chosen.
    texts = keyed_texts(docs)
    if single.count() < light.where("doc_id is not null").count():
        texts = texts.join(chosen.select("doc_id", "tkey"), ["doc_id", "tkey"], "left_semi").dropDuplicates(["doc_id"])
    texts = texts.select("doc_id", "text")
    near = materialize(verify(_neighbour_pairs(reps), texts), "near")
    comp = components(near)
    pairs, dense, rows = _list_pairs(reps, comp.select(F.col("node").alias("doc_id"), "component"))
    rest = materialize(verify(pairs, texts), "rest")
    if not dense.isEmpty():
        rest = rest.unionByName(materialize(_block_links(dense, rows, texts), "rest"))
    if not rest.isEmpty():
        comp = components(near.unionByName(rest))
    member = single.join(firsts, ["n", "d1", "d2"], "left").join(comp, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return light.join(member, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all columns; rows without an id stay."""
    dropped = materialize(linked(docs).where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    name = free_name(docs, "dropped")
    dropped = broadcast_if_small(dropped, dropped.count()).select(F.col("doc_id").alias(name))
    return docs.join(dropped, docs["doc_id"].cast("bigint") == F.col(name), "left_anti")
