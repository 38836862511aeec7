"""The dealt operators against brute force, and on rows that are null, empty, long, repeated, tied or clashing."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tidewater.llm import bpe, chat_format, fingerprints, graph, line_dedup, ngram_join, packing, quality_classifier, quality_rules, queries, token_counts, url_filter
from tidewater.llm.common import buffers

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet\n" * 4000
ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "It's a test, isn't it?\nIt's a test, isn't it?"), (5, LONG), (5, LONG), (None, "no id at all"), (6, "a"), (7, "Ünïcødé 漢字 🙂 e\u0301"), (8, "x" * 5000)]


def odd(spark):
    more = ["_id", "_gone", "gone", "gone_", "_dropped", "dropped", "component", "tkey", "_site_host", "_site_prior", "prior", "site", "row", "host", "path", "members", "routes", "next_text"]
    rows = [(i, t, "en", "s", 0, 1, "k", 1.0, *(["x"] * len(more))) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, node string, evidence double, " + ", ".join(f"`{k}` string" for k in more))


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in documents(spark).select("doc_id", "text").collect()}


def test_every_code_point_has_the_librarys_class():
    """Letters, numbers and white space as the library's own patterns see them."""
    table, single = bpe.classes(), {bytes([i]): i for i in range(256)}
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for pattern, kinds in ((r"\p{L}", {bpe.LETTER}), (r"\p{N}", {bpe.NUMBER}), (r"\s", {bpe.SPACE, bpe.BLANK})):
        library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        seen = "".join(bytes(library.encode_ordinary("".join(map(chr, every[i : i + 4096])))).decode() for i in range(0, len(every), 4096))
        assert seen == "".join(chr(c) for c in every if table[c] in kinds)


def test_bpe_as_the_library(spark):
    ranks = bpe.load(queries.BYTE_RANKS).ranks
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t or "" for _, t in ODD] + ["!'s 're''ll  it's's \n x", "'" * 999, "ab" * 3000, " \u00a0 a\u2003b"]
    ids, bounds = bpe.load(queries.BYTE_RANKS).encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == own.encode_ordinary(t)
    for r in bpe.digests(odd(spark), queries.BYTE_RANKS).where("doc_id is not null").collect():
        t = dict(ODD)[r.doc_id] or ""
        want = own.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    first = bpe.encode(odd(spark).where("doc_id = 4"), queries.BYTE_RANKS).first()
    assert len(first.ids) == len(first.begins) and first.begins[0] == 0


def test_token_counts(spark):
    lengths = sorted(r.n_tokens for r in bpe.token_counts(documents(spark), queries.BYTE_RANKS).collect())
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(documents(spark), queries.BYTE_RANKS)).cache()
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.n_tokens) and r.n_longer == sum(x > r.n_tokens for x in lengths)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths) and r.tokens_at_most == sum(x for x in lengths if x <= r.n_tokens)
    for limit in (0, 1, 777, 2048, 10**6):
        got = token_counts.at_limit(sums, limit).first()
        assert (got.n_longer, got.truncated_total) == (sum(x > limit for x in lengths), sum(min(x, limit) for x in lengths))
    assert token_counts.at_quantile(sums, 0.5).first()[0] == lengths[(len(lengths) + 1) // 2 - 1]
    assert token_counts.with_suffix_sums(token_counts.length_histogram(odd(spark).limit(0), queries.BYTE_RANKS)).count() == 0


def brute_rules(t):
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)]


def test_rules_statistics(spark):
    texts = [t or "" for _, t in ODD] + list(texts_of(spark).values())
    base, x = quality_rules.statistics(*buffers(pa.array(texts)))
    assert np.stack([base[k] for k in quality_rules.BASE], 1).tolist() == [brute_rules(t) for t in texts] and np.isfinite(x).all()


def test_trees_are_accurate_and_monotonic(spark):
    rows = documents(spark).join(labels(spark), "doc_id").select("text", "quality").collect()
    x = quality_rules.statistics(*buffers(pa.array([r.text for r in rows])))[1]
    y = np.array([r.quality for r in rows])
    half = np.arange(len(y)) % 2 == 0
    model = quality_rules.train(x[half], y[half], list(quality_rules.FEATURES.values()))
    assert ((model.score(x[~half]) >= 0) == y[~half]).mean() > 0.9
    more = x.copy()
    more[:, 2:5] += 0.3
    assert (model.score(more) <= model.score(x) + 1e-9).all()
    assert quality_rules.train(x, np.ones(len(x))).score(x).min() > 0


def test_rules_on_odd_rows(spark):
    model = quality_rules.fit(odd(spark), labels(spark).limit(0))
    got = quality_rules.judge(odd(spark), model)
    assert got.count() == len(ODD) and got.where("doc_id = 1").first().base_failed
    assert quality_rules.filter_documents(odd(spark), model).columns == odd(spark).columns
    assert quality_rules.judge(odd(spark).limit(0), model).count() == 0


def test_classifier(spark):
    got = quality_classifier.judge(documents(spark), labels(spark))
    assert got.count() == documents(spark).count()
    known = got.select("doc_id", "kept").join(labels(spark), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in known) / len(known) > 0.9
    assert quality_classifier.filter_documents(documents(spark), labels(spark)).count() == got.where("kept").count()
    none = labels(spark).limit(0)
    assert quality_classifier.filter_documents(odd(spark), none).count() == len(ODD)
    assert quality_classifier.judge(odd(spark).limit(0), none).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(i, "big", "a", 2.0) for i in range(400)] + [(1000 + i, "bad", "a", -2.0) for i in range(400)] + [(5000, "tiny", "a", -2.0)]
    light = spark.createDataFrame(rows, "doc_id bigint, host string, path string, evidence double")
    rates = {r.host: r.path_rate for r in quality_classifier.sites(light, labels(spark).limit(0), 0.5)[0].collect()}
    assert rates["bad"] < rates["tiny"] < rates["big"]


def test_fingerprints(spark):
    t = texts_of(spark)
    ids = sorted(t, reverse=True)
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(documents(spark)).collect()}
    for i, x in enumerate(ids):
        nxt = t[ids[(i + 1) % len(ids)]]
        changed = fingerprints.edited(t[x], nxt)
        a, b, c = fingerprints.of_texts([t[x], changed, nxt])
        r = got[x]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t[x]), hashlib.sha256(changed.encode()).hexdigest(), a, b)
        assert abs(r.near_edited - fingerprints.likeness([a], [b])[0]) < 1e-12 and abs(r.near_next - fingerprints.likeness([a], [c])[0]) < 1e-12
    assert fingerprints.compare_with_edits(odd(spark)).count() == len(ODD)
    assert fingerprints.compare_with_edits(odd(spark).limit(0)).count() == 0
    assert fingerprints.fingerprints(odd(spark).where("doc_id = 5")).select("fingerprint").distinct().count() == 1


def test_chat_format(spark):
    turn = lambda *x: [(i, r, t) for i, (r, t) in enumerate(x)]
    rows = [(1, turn(("user", "q"), ("assistant", "good")), turn(("user", "q"), ("assistant", "bad"))), (2, turn(("user", "q")), turn(("user", "q"))), (3, [], turn(("assistant", "z")))]
    got = {r.pair_id: r for r in chat_format.format_pairs(spark.createDataFrame(rows, f"pair_id int, chosen array<{chat_format._TURN}>, rejected array<{chat_format._TURN}>")).collect()}
    assert (got[1].n_common, got[1].prompt, got[1].chosen_completion, got[1].rejected_completion) == (1, "<user>\nq\n", "<assistant>\ngood\n", "<assistant>\nbad\n")
    m = got[1].chosen_mask[0]
    assert got[1].chosen_completion[m.begin : m.end] == "good"
    assert (got[2].n_common, got[2].chosen_completion, got[2].chosen_mask) == (1, "", []) and got[3].n_common == 0
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (3, None, None, None), (None, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert [(r.pair_id, r.rejected_id) for r in chat_format.neighbours(turns).collect()] == [(1, 2)]
    assert chat_format.format_pairs(chat_format.swapped(turns)).count() == 3
    assert chat_format.neighbours(turns.limit(0)).count() == 0


def test_url_filter(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    urls = {"http://A.Example.org/es/x?q": ("example.org/es/", "block"), "http://example.org/en/17": ("example.org/en/1", "block"), "https://x.com/de/": ("com/de/", "block"), "x://y.org/z": ("org/", "allow"), "http://notexample.org": (None, "allow"), "nothing": (None, "allow"), "http://a.net/": (None, "allow"), None: (None, "allow"), "http://xexample.org/es/": ("org/", "allow")}
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(0, next(iter(urls)), "c")], "page_id bigint, url string, host string")
    got = url_filter.judge(pages, rules).collect()
    assert len(got) == len(urls) + 1 and all((r.rule, r.verdict) == list(urls.values())[r.page_id] for r in got)
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"} and url_filter.judge(pages.limit(0), rules).count() == 0


def test_packing(spark):
    own = Tokenizer.from_file(queries.WORD_TOKENIZER)
    docs = documents(spark).select("doc_id", "text").unionByName(odd(spark).where("doc_id <> 5").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    t = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces = packing.pack(docs, queries.WORD_TOKENIZER).toPandas()
    for i, g in pieces.groupby("doc_id"):
        ids, at = own.encode(t[i], add_special_tokens=False).ids + [1], 0
        for p in g.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert set(pieces.doc_id) == set(t)
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length.to_numpy())[:-1]])).all() and g.length.sum() <= 2048
    assert pieces.length.sum() / (2048 * pieces.sequence_id.nunique()) > 0.97
    assert packing.pack(odd(spark), queries.WORD_TOKENIZER).select("doc_id").count() >= len(ODD) and packing.pack(odd(spark).limit(0), queries.WORD_TOKENIZER).count() == 0


@pytest.mark.parametrize("lengths", [{5: 1000}, {1000: 7, 1048: 7, 3: 1}, {2047: 10}, {700: 10, 648: 5, 1: 1}, {}])
def test_plan_covers_every_rank(lengths):
    have = np.zeros(2049, np.int64)
    for k, v in lengths.items():
        have[k] = v
    table, sequences = packing.plan(have)
    for k, v in lengths.items():
        mine = table[table[:, 0] == k]
        assert mine[:, 2].sum() == v and (mine[:, 1] == np.concatenate([[0], np.cumsum(mine[:, 2])[:-1]])).all()
    assert sequences >= sum(k * v for k, v in lengths.items()) / 2048


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 102), (101, 102), (200, 200), (300, 301), (301, 300)], "a bigint, b bigint")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert all(got[i] == 0 for i in range(51)) and {got[k] for k in (100, 101, 102)} == {100} and got[301] == 300
    assert graph.components(edges.limit(0)).count() == 0


def brute_links(t):
    sets = {}
    for i, x in t.items():
        w = WORD.findall(x.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in t}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sorted(t) if sets[i]]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in t}


def test_ngram_join(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 9999, 150)]
    rows = []
    for i in range(60):  # a group whose members differ ever more, so that links form chains
        w = list(base)
        for k in rng.integers(0, 150, i // 6):
            w[k] = f"e{i}-{k}"
        rows.append((10**6 + i, " ".join(w)))
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_links({r.doc_id: r.text or "" for r in docs.collect()})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs).collect()}
    assert got == want
    kept = {r.doc_id for r in ngram_join.keep_first(docs).collect()}
    assert kept == {c for _, c in want.values()}


def test_ngram_join_on_odd_rows(spark):
    got = ngram_join.linked(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r.component_id is None for r in got if r.doc_id is None)
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id in (1, 2, 3)} == {(0, 1), (0, 2), (0, 3)}
    assert ngram_join.linked(odd(spark).limit(0)).count() == 0 and ngram_join.keep_first(odd(spark)).columns == odd(spark).columns


def test_line_dedup(spark):
    t = texts_of(spark)
    where = {}
    for i in sorted(t):
        for p, line in enumerate(t[i].split("\n")):
            if any(ord(c) > 32 for c in line):
                where.setdefault(line, []).append((i, p))
    lines = list(where)
    sets = [frozenset(x[k : k + 5] for k in range(max(1, len(x) - 4))) for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    groups = {}
    for i, x in enumerate(lines):
        groups.setdefault(find(i), []).extend(where[x])
    want = {p for g in groups.values() for p in g} - {min(g) for g in groups.values()}
    got = {(r.doc_id, p) for r in line_dedup.dropped_lines(documents(spark)).collect() for p in r.gone}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_line_dedup_loses_no_link_of_a_band(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    base = ["".join(rng.choice(letters, 120)) for _ in range(3)]
    lines = []
    for i in range(360):  # families of lines that are much alike, linked or not
        x = list(base[i % 3])
        for k in rng.choice(120, rng.integers(1, 7), replace=False):
            x[k] = str(rng.choice(letters))
        lines.append("".join(x))
    lines = sorted(set(lines))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string")
    measured = {r.doc_id: r for r in line_dedup.measured(docs).collect()}
    sets = [frozenset(x[k : k + 5] for k in range(len(x) - 4)) for x in lines]
    assert all(measured[i].size == len(s) for i, s in enumerate(sets))
    bands = [{measured[i][k] for k in line_dedup._BAND} for i in range(len(lines))]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if bands[i] & bands[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i for i in range(len(lines)) if find(i) != i}
    for block in (4096, 16):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        assert {r.doc_id for r in line_dedup.dropped_lines(docs).collect()} == want
    assert 0 < len(want) < len(lines) - 3


def test_line_dedup_links_short_lines_of_a_band(spark):
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    lines = []
    for n in range(8, 21):  # a line beside the same with a mark more: alike, and alone with each other
        for _ in range(120):
            x = "".join(rng.choice(letters, n))
            lines += [x, x + "."]
    lines = sorted(set(lines))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string")
    bands = {r.doc_id: {r[k] for k in line_dedup._BAND} for r in line_dedup.measured(docs).collect()}
    where = {x: i for i, x in enumerate(lines)}
    want = {where[x + "."] for x in lines if x + "." in where and bands[where[x]] & bands[where[x + "."]]}
    assert {r.doc_id for r in line_dedup.dropped_lines(docs).collect()} == want and len(want) > 1500


def test_parities_differ_no_more_than_sets():
    rng = np.random.default_rng(12)
    sets, pairs = [], []
    for n in (4, 60, 100, 200, 900, 3000, 90_000):
        for cut in (9, 5):  # similarities of about 0.8 and 0.67
            a = np.unique(rng.integers(0, 1 << 48, n, np.uint64))
            b = np.unique(np.append(a[n // cut :], rng.integers(0, 1 << 48, n // cut + n // 40, np.uint64)))
            pairs.append((len(sets), len(sets) + 1))
            sets += [a, b]
    pairs.append((len(sets), len(sets) + 1))
    sets += [a := np.unique(rng.integers(0, 1 << 48, 350, np.uint64)), a[:320]]
    size = np.array([len(s) for s in sets])
    level = line_dedup._level(size)
    parity = line_dedup.Parities(line_dedup._parities(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), 48, level), level)
    x, y = np.array(pairs).T
    exact = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in pairs])
    assert (parity.differ(x, y) <= exact).all() and not parity.differ(x, x).any() and (level[x] != level[y]).any()
    near = parity.near(size, x, y)
    assert near[9 * exact <= size[x] + size[y]].all() and not near[(9 * exact > 1.7 * (size[x] + size[y])) & (size[x] > 500) & (size[x] < 5000)].any()


def test_line_dedup_finds_nearly_all_pairs():
    """Recall of pairs by bands, over lines of sf0.01 against copies with a few changed letters, by exact similarity."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    lines = sorted({x for t in table for x in (t or "").split("\n") if 20 <= len(x) <= 400})[:4000]
    rng = np.random.default_rng(13)
    copies = []
    for x in lines:
        y = list(x)
        for k in rng.choice(len(y), max(1, len(y) // 80), replace=False):
            y[k] = "§"
        copies.append("".join(y))
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in lines + copies]
    n = len(lines)
    like = np.array([len(sets[i] & sets[n + i]) / len(sets[i] | sets[n + i]) for i in range(n)])
    bands = line_dedup.signatures(*line_dedup._shingles(*line_dedup._code_lines(lines + copies)))[0]
    met = (bands[:n] == bands[n:]).any(1)
    linked, close = like >= 0.8, like >= 0.9
    assert linked.sum() > 2000 and met[linked].mean() > 0.98 and met[close].mean() > 0.998


def test_line_dedup_of_one_id_with_different_texts(spark):
    line = "the quick brown fox jumps over the lazy dog tonight"
    rows = [(1, f"{line}\nalpha line with its own words here"), (1, f"beta line which nobody else has in store\n{line}."), (1, f"{line}\nalpha line with its own words here"), (0, None)]
    out = line_dedup.filter_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    texts = sorted(r.text or "" for r in out)
    assert len(texts) == 4 and texts[1] == texts[2] or texts[2] == texts[3]
    assert sum(t.count(line) for t in set(texts)) == 1 and all(x in "\n".join(texts) for x in ("alpha", "beta"))


def test_line_dedup_on_odd_rows(spark):
    out = line_dedup.filter_documents(odd(spark))
    assert out.columns == odd(spark).columns and out.where("doc_id = 5").first().text.strip("\n") == "lorem ipsum dolor sit amet"
    assert out.where("doc_id = 1").count() == 1 and out.where("doc_id is null").count() == 1
    assert line_dedup.filter_documents(odd(spark).limit(0)).count() == 0


def test_pipeline(spark):
    docs = documents(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns and 0 < docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert {"pipeline", *queries.QUERIES} <= set(__spark_entry__.queries())


def test_a_sample_is_bounded_before_the_driver(spark):
    many = spark.range(60_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some words here "), F.col("id").cast("string")).alias("text"))
    docs = many.union(spark.range(100, 140).select("id", F.lit("other words")))
    said = spark.createDataFrame([(7, 1), *((i, i % 2) for i in range(100, 140))], "doc_id long, quality int")
    for rows in (10, 100):
        names = list(quality_rules.FEATURES)
        found = quality_rules.labelled_sample(docs, said, rows=rows).mapInArrow(quality_rules._features, "doc_id bigint, y double, " + ", ".join(f"{k} double" for k in names))
        got = [r.doc_id for r in quality_rules.one_per_id(found, names, rows).collect()]
        assert len(got) == len(set(got)) == min(rows, 41)


def test_quality_rules_kept_by_a_plain_walk(spark):
    """`kept` and score against trees that are walked node by node, row by row."""
    docs = documents(spark)
    model = quality_rules.fit(docs, labels(spark))
    texts = texts_of(spark)
    for r in quality_rules.judge(docs, model).collect():
        _, x = quality_rules.statistics(*buffers(pa.array([texts[r.doc_id]])))
        score = model.prior
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (1 if x[0, f[node]] <= t[node] else 2)
            score += v[node - len(f)]
        assert abs(score - r.score) < 1e-9 and r.kept == (not r.base_failed and r.score >= 0)


def test_posteriors_by_hand(spark):
    """Site rates and qualities of op2 against sums over lists."""
    docs, said = documents(spark), labels(spark)
    model = quality_classifier.fit(docs, said)
    light = [r for r in quality_classifier.scored(docs, model, "source", "lang").collect()]
    known = {r.doc_id: float(r.quality) for r in said.collect()}
    prior = np.log(model.share / (1 - model.share))
    paths, hosts = {}, {}
    for r in light:
        p = known.get(r.doc_id, 1 / (1 + np.exp(-(r.evidence + prior))))
        for table, key in ((paths, (r.host, r.path)), (hosts, r.host)):
            n, good = table.get(key, (0, 0.0))
            table[key] = (n + 1, good + p)
    rate = (sum(g for _, g in hosts.values()) + 1) / (len(light) + 2)

    def strength(rows):
        n = np.array([a for a, _, _ in rows], float)
        r = np.array([g / a for a, g, _ in rows])
        t = np.array([x for _, _, x in rows])
        between = max(0.0, (n * (r - t) ** 2).sum() - (t * (1 - t)).sum()) / n.sum()
        within = (n * t * (1 - t)).sum() / n.sum()
        return float(np.clip(within / between - 1 if between > 0 else 1e4, 1.0, 1e4))

    pull = strength([(n, g, rate) for n, g in hosts.values()])
    host_rate = {h: (g + pull * rate) / (n + pull) for h, (n, g) in hosts.items()}
    pull = strength([(n, g, host_rate[k[0]]) for k, (n, g) in paths.items()])
    path_rate = {k: (g + pull * host_rate[k[0]]) / (n + pull) for k, (n, g) in paths.items()}
    evidence = {r.doc_id: r.evidence for r in light}
    for r in quality_classifier.judge(docs, said, model=model).collect():
        own = path_rate[(r.host, r.path)]
        odds = evidence[r.doc_id] + np.log(own / (1 - own))
        assert abs(r.path_rate - own) < 1e-9 and abs(r.quality - 1 / (1 + np.exp(-odds))) < 1e-9 and r.kept == (odds >= 0)


def test_classifier_on_odd_rows(spark):
    rows = quality_classifier.judge(odd(spark), labels(spark)).collect()
    assert len(rows) == len(ODD) and all(0 < r.quality < 1 for r in rows)
    none = spark.createDataFrame([(9, None, None, None)], "doc_id long, text string, source string, lang string")
    assert [r.host for r in quality_classifier.judge(none, labels(spark)).collect()] == [""]
    assert quality_classifier.judge(odd(spark).limit(0), labels(spark)).count() == 0
    assert quality_classifier.filter_documents(odd(spark), labels(spark)).columns == odd(spark).columns


def test_fingerprints_by_hand():
    """Digests and likeness against counts over triplets, one byte at a time."""

    def digest(t):
        data, counts = t.encode(), [0] * 256
        for salt, shape in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 4))):
            for i in range(len(data) - shape[2]):
                a, b, c = (data[i + k] for k in shape)
                counts[((a | b << 8 | c << 16) + (salt << 24)) * 2654435761 % (1 << 32) >> 24] += 1
        q1, q2, q3 = (sorted(counts)[64 * k - 1] for k in (1, 2, 3))
        top = max(q3, 1)
        head = [min(255, round(12 * np.log2(1 + len(data)))), (q1 * 15 // top) << 4 | q2 * 15 // top]
        return head, [(c > q1) + (c > q2) + (c > q3) for c in counts]

    texts = ["", "ab", "abc", "the quick brown fox " * 7, "the quick brown fix " * 7, "Ünïcødé 漢字 🙂", "x" * 5000, *("".join(chr(97 + (i * i + j) % 26) for i in range(900)) for j in range(3))]
    plain, got = [digest(t) for t in texts], fingerprints.of_texts(texts)
    for (head, codes), f in zip(plain, got, strict=True):
        raw = bytes.fromhex(f)
        assert list(raw[:2]) == head and [raw[2 + i // 4] >> (6 - 2 * (i % 4)) & 3 for i in range(256)] == codes
    for i, (h, x) in enumerate(plain):
        for j, (g, y) in enumerate(plain):
            far = sum(abs(a - b) for a, b in zip(x, y, strict=True)) + abs(h[0] - g[0]) // 2 + abs((h[1] >> 4) - (g[1] >> 4)) + abs((h[1] & 15) - (g[1] & 15))
            assert abs(fingerprints.likeness([got[i]], [got[j]])[0] - (1 - min(far, 320) / 320)) < 1e-12


def test_fingerprints_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 400)
    ids = [*range(0, 90, 3), 5, 5, None]
    docs = spark.createDataFrame([(i, f"text {i} number {k} " * 3) for k, i in enumerate(ids)], "doc_id long, text string")
    rows = sorted([(i, f"text {i} number {k} " * 3) for k, i in enumerate(ids)], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {(i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)}
    assert {(r.doc_id, r.text, r.next_text) for r in fingerprints.with_next(docs).collect()} == want


def test_chat_format_on_odd_turns(spark):
    long = "word " * 40_000
    turns = [("a", 0, "user", "hi"), ("a", 1, "assistant", ""), ("a", 2, "user", "go on"), ("a", 3, "assistant", long), ("b", 0, "user", "hi"), ("b", 1, "assistant", "yes"), ("b", 1, "assistant", "yes"), (None, 0, "user", "x"), ("c", None, None, None)]
    table = spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id string, turn long, role string, text string, pair_id string, chosen string")
    got = {r.pair_id: r for r in chat_format.swapped(table).collect()}
    assert [t.text for t in got["a"].chosen] == ["hi", "", "go on", long] and [t.text for t in got["a"].rejected] == ["hi", "", "go on"]
    assert [t.text for t in got["b"].rejected] == ["hi", "yes", "yes"] and len(got["c"].chosen) == 1
    out = {r.pair_id: r for r in chat_format.format_pairs(chat_format.swapped(table)).collect()}
    assert out["a"].n_common == 3 and [(s.begin, s.end) for s in out["a"].chosen_mask] == [(12, 12 + len(long))] and out["a"].rejected_completion == ""
    assert out["b"].n_common == 3 and chat_format.neighbours(table).count() == 1 and chat_format.neighbours(table.limit(0)).count() == 0


def test_url_filter_on_long_and_hostless_urls(spark):
    urls = [None, "no scheme", "http://", "http:///path", "https://A.ORG/" + "x" * 100_000, "http://example.org/en/1" + "?" * 9, "http://b.com/de/", "http://b.com/de/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id int, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls) and [got[i][2:] for i in range(4)] == [(None, "allow")] * 4 and got[3][:2] == ("", "/path")
    assert got[4][2:] == ("org/", "allow") and got[5][2:] == ("example.org/en/1", "block") and got[6][2:] == got[7][2:] == ("com/de/", "block")


def test_ngram_join_of_one_id_with_different_texts(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, "spam " * 1000), (1, " ".join(words)), (2, " ".join([*words, "end"])), (3, "spam " * 1000), (None, " ".join(words))]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1): 1, (1, 56): 1, (2, 57): 1, (3, 1): 3, (None, 56): None}


def test_ngram_join_of_dense_groups(spark, monkeypatch):
    """Documents much alike, of which some are linked: by rows and by blocks the components are those of brute force."""
    rng = np.random.default_rng(21)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(260):
        x, at = list(base), rng.integers(0, 116, rng.integers(2, 6))
        for k in at:
            x[k] = f"n{i if i % 3 else i // 6}x{k}"
        texts[i] = " ".join(x)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in texts}
    assert 20 < len(set(want.values())) < 250
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    for dense, chunk in ((64, 1024), (3, 16), (10_000, 1024)):
        monkeypatch.setattr(ngram_join, "DENSE", dense)
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        assert {r.doc_id: r.component_id for r in ngram_join.linked(docs).collect()} == want


def test_divide_skip_counts_overlaps():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = []
    for i in range(80):
        x = pool[(i % 4) * 60 : (i % 4) * 60 + 110].copy()
        for k in rng.choice(110, rng.integers(2, 12), replace=False):
            x[k] = rng.integers(0, 1 << 63, dtype=np.uint64)
        sets.append(np.unique(x))
    for asks in (np.full(80, -1), np.arange(80) // 4 % 2):
        a, b = ngram_join._search(np.arange(80), np.arange(80), asks, sets)
        root = list(range(80))
        own = list(range(80))

        def find(r, x):
            while r[x] != x:
                x = r[x]
            return x

        for i, j in zip(a, b, strict=True):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)
            root[find(root, i)] = find(root, j)
        for i in range(80):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (asks[i] != asks[j] or asks[i] < 0) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    own[find(own, i)] = find(own, j)
        parts = lambda r: {frozenset(k for k in range(80) if find(r, k) == t) for t in {find(r, k) for k in range(80)}}  # noqa: E731, B023
        assert parts(root) == parts(own) and len(a) > 10


def test_pipeline_end_to_end_on_odd_rows(spark, tmp_path):
    """`run` over documents with odd rows and clashing columns: every piece is one of what the stages kept, and clean documents stay."""
    shared = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = odd(spark).select(*(F.col(c).cast(shared.schema[c].dataType) for c in shared.columns))
    more = shared.unionByName(rows).withColumn("_gone", F.lit(1)).withColumn("gone", F.lit("x"))
    more.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), more.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), f"test-{name}")
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "sequence_id", "offset").collect()
    assert {r.doc_id for r in got} == kept[-1]
    sizes = Counter()
    for r in got:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 2048


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    import glob
    import os

    import duckdb

    duck = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(queries.ORACLES[name]).df()
    rows = lambda df: sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and len(got) and rows(got) == rows(want)


@pytest.mark.parametrize("held", [8, 1 << 20])
def test_shared_bands_travel_packed(spark, monkeypatch, held):
    """A task sends a row a group of bands; all lines of bands of two lines or more come back, also from a group that is not held whole."""
    monkeypatch.setattr(line_dedup, "HELD", held)
    draw = np.random.default_rng(3)
    lines = [(int(draw.integers(-(1 << 62), 1 << 62)), [k // 7 - 5, 1 << 40, *(int(x) for x in draw.integers(-(1 << 62), 1 << 62, 6))]) for k in range(200)]
    lines += lines[:50]  # of other texts
    have = defaultdict(set)
    for line, bands in lines:
        for b in bands:
            have[b].add(line)
    want = {(b, x) for b, v in have.items() if len(v) > 1 for x in v}

    table = pa.table({"line": [x for x, _ in lines], **{k: [b[j] for _, b in lines] for j, k in enumerate(line_dedup._BAND)}})
    sent = pa.Table.from_batches(line_dedup._bands(iter(table.to_batches(max_chunksize=30)), 5))
    got = pa.Table.from_batches(line_dedup._shared(iter(sent.sort_by("dealt").to_batches())))
    assert {(r["band"], r["line"]) for r in got.to_pylist()} == want
    if held > 8:
        assert sent.num_rows <= 5 and got.num_rows == len(want)


@pytest.mark.parametrize("held", [500, 1 << 20])
def test_only_lines_with_a_near_one_leave_shared_bands(monkeypatch, held):
    """Marks let lines go that no line of their band is near to, and no link; a group that is not held whole loses none."""
    monkeypatch.setattr(line_dedup, "HELD", held)
    draw = np.random.default_rng(21)
    words = ["".join(draw.choice(list("abcdefghij"), 6)) for _ in range(12)]
    lines = [" ".join(draw.choice(words, 9)) for _ in range(400)]  # of few words: many bands are shared by lines that differ
    lines = sorted({*lines, *(x[:-1] + "!" for x in lines[:150])})
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(lines))), "tkey": list(range(len(lines))), "text": lines})
    rows = pa.Table.from_batches(line_dedup._measure(iter([batch]))).to_pylist()
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in lines]
    have = defaultdict(set)
    for r in rows:
        for k in line_dedup._BAND:
            have[r[k]].add(r["doc_id"])
    line = {r["doc_id"]: r["h1"] for r in rows}
    every = {(b, line[i]) for b, v in have.items() if len(v) > 1 for i in v}
    links = [(b, i, j) for b, v in have.items() for i in v for j in v if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = {(b, line[k]) for b, i, j in links for k in (i, j)}

    sent = [x.filter(x.column("bands").is_valid()) for x in line_dedup._travelling(line_dedup._measure(iter([batch])))]
    dealt = pa.Table.from_batches(line_dedup._bands(line_dedup._opened(iter(sent)), 3)).sort_by("dealt")
    got = {(r["band"], r["line"]) for x in line_dedup._shared(iter(dealt.to_batches())) for r in x.to_pylist()}
    assert want <= got <= every and len(want) > 200
    if held > 500:
        assert len(got) < len(every)


def test_line_dedup_compares_no_pair_twice(spark):
    """Two lines that the first round found not to be linked do not come into the second."""
    draw = np.random.default_rng(22)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    lines = []
    for _ in range(60):  # pairs of a similarity just below 0.8, alone in their bands
        x = "".join(draw.choice(letters, 150))
        lines += [x, "".join(x[:40] + "##" + x[42:80] + "##" + x[82:120] + "##" + x[122:])]
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in lines]
    assert all(0.7 < len(a & b) / len(a | b) < 0.8 for a, b in zip(sets[::2], sets[1::2], strict=True))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    met, info = line_dedup.shared_lines(line_dedup.measured(docs, travelling=True))
    rows = line_dedup.mates(met, info).cache()
    assert rows.where("first is not null").count() > 0
    assert line_dedup.crossing(rows, info, spark.createDataFrame([], "node bigint, component bigint")).count() == 0
    assert line_dedup.dropped_lines(docs).count() == 0
