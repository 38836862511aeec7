"""Token files, vector codes and phrases against plain versions, and on odd rows."""

import glob
import io
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from test_llm import FOLDER, ODD, documents, odd
from tokenizers import Tokenizer

import corpus_pipeline
from tidewater.llm import common, fingerprints, packing, phrases, queries, token_files, vector_codes


def library():
    return Tokenizer.from_file(queries.WORD_TOKENIZER)


def ids_of(text):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_token_files_as_the_library(spark):
    texts = sorted((r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect())
    got, at = {r.doc_id: r for r in queries.op11_token_files(spark, FOLDER).collect()}, 0
    assert len(got) == len(texts)
    for i, t in texts:
        ids = ids_of(t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_give_wanted_documents_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 40_000)
    out, docs = str(tmp_path / "files"), documents(spark)
    token_files.write_tokens(docs, queries.WORD_TOKENIZER, out, 2)
    files = glob.glob(f"{out}/part=*/*.txt")
    assert len(files) > 3
    every = {r.doc_id: (r.start, bytes(r.ids)) for r in token_files.read_tokens(spark, out).collect()}
    some = docs.where("doc_id % 50 = 0").select("doc_id")
    got = {r.doc_id: (r.start, bytes(r.ids)) for r in token_files.read_tokens(spark, out, some.union(some)).collect()}
    assert got == {i: x for i, x in every.items() if i % 50 == 0} and got
    monkeypatch.setattr(token_files, "MOST_FOLDERS", 0)
    assert {r.doc_id: (r.start, bytes(r.ids)) for r in token_files.read_tokens(spark, out, some).collect()} == got
    listed = token_files.index(spark, out).collect()
    assert {r.doc_id: (r.start, r.n_tokens) for r in listed} == {i: (s, len(x) // 4) for i, (s, x) in every.items()}
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(files[0], "rb").read()), read_across_frames=True).read()
    f = token_files.TokenFile(memoryview(open(files[0], "rb").read()))
    assert plain[: 2 * int(f.lengths.sum())] == b"".join(f.ids(k).tobytes() for k in range(len(f.lengths)))


def test_token_files_notice_damage(spark, tmp_path):
    out = str(tmp_path / "files")
    token_files.write_tokens(documents(spark).where("doc_id < 9"), queries.WORD_TOKENIZER, out, 2)
    body = bytearray(open(glob.glob(f"{out}/part=*/*.txt")[0], "rb").read())
    table = token_files.TokenFile(memoryview(bytes(body))).table
    at = len(body) - 9 - 12 * len(table) + 8  # the first checksum
    body[at] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.TokenFile(memoryview(bytes(body))).ids(0)
    with pytest.raises(ValueError, match="not a file"):
        token_files.TokenFile(memoryview(bytes(body[:-1])))


def test_token_files_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2_000)
    copies = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text of very many rows without an id").alias("text"))
    rows = odd(spark).unionByName(copies, allowMissingColumns=True)
    out = str(tmp_path / "odd")
    token_files.write_tokens(rows, queries.WORD_TOKENIZER, out, 2)
    assert len(glob.glob(f"{out}/part=*")) > 2
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, bytes(r.ids)) for r in token_files.read_tokens(spark, out).collect())
    want = sorted([((i is not None, i or 0), len(x), x.tobytes()) for i, t in ODD for x in [ids_of(t)]] + [((False, 0), len(x), x.tobytes()) for x in [ids_of("one text of very many rows without an id")] for _ in range(600)])
    assert [(g[0], len(g[2]) // 4, g[2]) for g in sorted(got, key=lambda g: (g[0], len(g[2]), g[2]))] == want
    ends = [s + len(x) // 4 for _, s, x in got]
    assert [s for _, s, _ in got] == [0, *ends[:-1]]  # no gap and no overlap, in order of ids
    empty = str(tmp_path / "empty")
    token_files.write_tokens(rows.limit(0), queries.WORD_TOKENIZER, empty, 2)
    assert token_files.read_tokens(spark, empty).count() == 0 == token_files.read_tokens(spark, empty, rows).count() == token_files.index(spark, empty).count()


def test_token_files_of_large_vocabularies():
    plain = np.array([70_000, 3], "<u4").tobytes()
    body = token_files.file_bytes([zstandard.ZstdCompressor().compress(plain)], [len(plain)], [token_files._check(plain)], pa.array(["id"]), {"width": "4", "sequence": "0"}) + token_files.MAGIC
    f = token_files.TokenFile(memoryview(body))
    assert f.ids(0).tolist() == [70_000, 3] and f.doc_ids.to_pylist() == ["id"] and token_files._width(70_000, 2) == 4 and token_files._width(49_408, 2) == 2


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector, label); codebooks, and (id, code, error, label error) of each row, in plain integers."""
    ok = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(ok[0][1]) // parts
    cut = lambda v: [tuple(v[p * w : p * w + w]) for p in range(parts)]
    first = sorted(ok)[:entries]
    books = [[list(cut(v)[p]) for _, v, _ in first] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in ok:
                x = cut(v)[p]
                held[near(p, x)[1]].append(x)
            for k, xs in held.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], Counter()
    for i, v, lab in ok:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        by_label[lab] += out[-1][2]
    return books, sorted((i, c, e, by_label[lab]) for i, c, e, lab in out)


def coded(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, part int, code string")
    books = vector_codes.train(df)
    got = vector_codes.with_label_errors(vector_codes.encode(df, books)).collect()
    return books, sorted((r.vec_id, r.code, r.error, r.label_error) for r in got)


def test_vector_codes_as_plain_integers(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vector_codes, "RUN_NODES", 7)
    rng = np.random.Generator(np.random.PCG64(1))
    rows = [(i, (rng.integers(-2, 3, 16) / 3 + i % 4).tolist(), i % 3 if i % 5 else None) for i in range(300)]
    rows += [(7, rows[3][1], 1)] * 40 + [(1000 + i, rows[5][1], 2) for i in range(90)]  # a repeated row, copies
    bad = [(400, None, 1), (401, [math.nan] * 16, 1), (402, [math.inf, *[0.0] * 15], 2), (403, [None, *[0.0] * 15], None), (404, [], 1), (405, [1.0] * 24, 1), (406, [1.0] * 5, 1)]
    books, got = coded(spark, rows + bad)
    assert (books, got) == brute_codes(rows)


def test_vector_codes_of_large_few_and_no_rows(spark):
    rows = [(i, [1e9 * (i - 3), 0.25, -1e-9, 2.0] * 4, None) for i in range(9)]
    books, got = coded(spark, rows)
    assert (books, got) == brute_codes(rows)
    huge = coded(spark, [(1, [1e30] * 8, 1), (2, [-1e300] * 8, 1)])[1]
    assert [(r[0], r[2]) for r in huge] == [(1, 0), (2, 0)]
    far = [(i, [0.0] * 8, 1) for i in range(16)] + [(20, [3e12] * 8, 1), (21, [-3e12] * 8, 1)]
    assert max(r[2] for r in coded(spark, far)[1]) == (1 << 63) - 1 == max(r[3] for r in coded(spark, far)[1])
    assert coded(spark, []) == ([], []) and coded(spark, [(1, None, 1)]) == ([], [])


def test_tries_share_prefixes():
    parts = np.array(list(itertools.product((0, 1), (5, 6, 7), (-1, 2))), np.int64)
    trie, leaf = vector_codes.Trie.of(np.concatenate([parts[::-1], parts[:4]]))
    assert [len(x) for x in trie.levels] == [2, 6, 12] and trie.parts().tolist() == parts.tolist()
    assert leaf.tolist() == [*range(12)][::-1] + [0, 1, 2, 3] and trie.counts.tolist() == [2] * 4 + [1] * 8
    codes, distance = trie.nearest([[0, 5, 0], [1, 7, 2], [1, 7, 2]])
    plain = [min((sum((int(a) - b) ** 2 for a, b in zip(p, e, strict=True)), k) for k, e in enumerate([[0, 5, 0], [1, 7, 2]])) for p in parts]
    assert list(zip(distance.tolist(), codes.tolist(), strict=True)) == plain


def test_codes_decode_near_their_vectors(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    books = vector_codes.train(vectors)
    back = {r.vec_id: np.array(r.vector) for r in vector_codes.decode(vector_codes.encode(vectors, books), books).collect()}
    for r in vectors.limit(50).collect():
        x = np.array(r.embedding)
        assert np.linalg.norm(x - back[r.vec_id]) < np.linalg.norm(x)


def brute_phrases(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        g, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[g] += len(w)
            f.update((g, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {x: c for x, c in f.items() if c >= least}
    inside = {(g, q[i : i + k]) for (g, q), c in often.items() for k in range(1, len(q)) for i in range(len(q) - k + 1) if c >= often[g, q[i : i + k]]}
    out = defaultdict(list)
    for (g, p), a in often.items():
        if len(p) > 1 and (g, p) not in inside:
            s, _, left, right = min((1000 * a * n[g] // (f[g, p[:k]] * f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
            out[g].append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((g, i + 1, p.decode(), -a, left, right, n[g], -s) for g, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("share", [1 / 16, 1.0, 1e-9])
def test_phrases_are_exact_whatever_the_sample(spark, share):
    """Even a sample of nothing, where every frequent word is a failure of the border, gives all phrases."""
    docs = documents(spark).where("doc_id < 120")
    got = sorted(tuple(r) for r in phrases.collocations(docs, 12, 50, share).collect())
    assert got == brute_phrases([(r.text, r.lang) for r in docs.collect()], 12, 50) and len(got) > 30


def test_phrases_of_odd_rows(spark):
    rows = [*((t, "en") for _, t in ODD[:4] + ODD[6:]), ("A b. a b, A\tB  a b", None), ("a b a b a b", "und"), (None, None), ("Ünïcødé 漢字 x Ünïcødé 漢字 x", ""), ("a b a b", "x\ty"), ("Ab Cd " * 3000, "de")]
    df = spark.createDataFrame([(t, g, 1, "x", 2) for t, g in rows], "text string, lang string, n bigint, phrase string, words int")
    got = sorted(tuple(r) for r in phrases.collocations(df, 2, 50, 0.5).collect())
    assert got == brute_phrases(rows, 2, 50) and {r[0] for r in got} >= {"und", "", "de"}
    assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_pass_64_bits(spark, monkeypatch):
    """a * n * 1000 and l * r beyond 2**64 divide exactly."""
    big = [("g", 0, "", 9 * 10**15 + 7), ("g", 1, "x", 7 * 10**14 + 3), ("g", 1, "y", 6 * 10**14 + 1), ("g", 2, "x y", 5 * 10**14 + 9)]
    monkeypatch.setattr(phrases, "frequencies", lambda *_: spark.createDataFrame(big, "lang string, words int, phrase string, n bigint"))
    r = phrases.collocations(spark.range(0)).first()
    assert r.score == 1000 * (5 * 10**14 + 9) * (9 * 10**15 + 7) // ((7 * 10**14 + 3) * (6 * 10**14 + 1))


def test_fingerprints_deal_rows_of_one_id(spark, monkeypatch):
    """Null ids and copies of one id lie in many ranges, and every row still has the next one as its next."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 20_000)
    rows = [(None, f"text {k % 500:03d}") for k in range(3000)] + [(7, "copy")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    pairs = Counter((i, t, want[(k + 1) % len(want)][1]) for k, (i, t) in enumerate(want))
    dealt = fingerprints.with_next(df)
    assert Counter((r.doc_id, r.text, r.next_text) for r in dealt.collect()) == pairs
    seen = fingerprints.compare_with_edits(df)
    assert seen.count() == 5000 and seen.where("doc_id = 7 and near_next = 1").count() == 1999
    assert fingerprints.with_next(df.limit(0)).count() == 0
    assert [tuple(r) for r in fingerprints.with_next(df.limit(1)).collect()] == [(None, "text 000", "text 000")]


def test_pipeline_on_no_rows_and_without_labels(spark, tmp_path):
    """No documents give no rows, no labels keep what passes the base rules, and the session's options stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    documents(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = documents(spark).where("doc_id < 40").withColumn("prior", F.lit("x"))
    rules = corpus_pipeline.rules_stage(spark, docs, str(tmp_path))
    kept = corpus_pipeline.classifier_stage(spark, rules, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == rules.count() > 0 and spark.conf.get(key) == before


def test_token_counts_of_odd_rows(spark):
    """Null texts are documents of no tokens, long ones count whole, repeated rows each; no rows give no lengths."""
    import tiktoken
    from public_tokenizers import PATTERN

    from tidewater.llm import bpe, token_counts

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load(queries.BYTE_RANKS).ranks, special_tokens={})
    want = Counter(len(own.encode_ordinary(t or "")) for _, t in ODD)
    got = token_counts.length_histogram(odd(spark), queries.BYTE_RANKS)
    assert {r.n_tokens: r.n_docs for r in got.collect()} == want and want[0] >= 2
    sums = token_counts.with_suffix_sums(got).collect()
    assert max(r.n_at_most for r in sums) == len(ODD) and {r.tokens_at_most + r.tokens_longer for r in sums} == {sum(k * n for k, n in want.items())}
    assert bpe.digests(odd(spark).limit(0), queries.BYTE_RANKS).count() == 0 == token_counts.length_histogram(odd(spark).limit(0), queries.BYTE_RANKS).count()


def test_labels_that_disagree_count_by_their_mean(spark):
    """Two labels of one document count by their mean, a tie as good, in whatever order they come."""
    from tidewater.llm import quality_rules

    docs = documents(spark).where("doc_id < 60")
    said = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, 1 - i % 2) for i in range(0, 60, 10)], "doc_id long, quality int")
    rows = {r.doc_id: r.y for r in quality_rules.labelled_sample(docs, said).select("doc_id", "y").collect()}
    turned = {r.doc_id: r.y for r in quality_rules.labelled_sample(docs, said.orderBy("quality")).select("doc_id", "y").collect()}
    assert rows == turned and all(rows[i] == (1 if i % 10 == 0 else i % 2) for i in rows) and len(rows) > 40


def test_fingerprints_of_odd_rows_by_value(spark):
    """Each odd row's fingerprint is that of its text alone, and its edited text is made of the next row in the order."""
    import hashlib

    rows = sorted([(i, t or "") for i, t in ODD], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = {(r.doc_id, r.fingerprint): r for r in fingerprints.compare_with_edits(odd(spark)).collect()}
    assert len(got) == len({(i, fingerprints.of_texts([t])[0]) for i, t in rows})
    for k, (i, t) in enumerate(rows):
        r, after = got[i, fingerprints.of_texts([t])[0]], rows[(k + 1) % len(rows)][1]
        if (i, t) in [x for j, x in enumerate(rows) if j != k]:
            continue  # one of two equal rows: which of them is read here is not fixed
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(fingerprints.edited(t, after).encode()).hexdigest()
        assert abs(r.near_next - fingerprints.likeness([r.fingerprint], fingerprints.of_texts([after]))[0]) < 1e-12


def test_keys_travel_packed_and_are_counted_by_groups(spark):
    """However many keys a task finds, it sends a row a group of keys; counts and filters stay exact."""
    found = np.random.default_rng(5).integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2)
    keys = np.concatenate([found, found[:1000], found[:1000], np.zeros(5, np.uint64), np.full(3, 2**64 - 1, np.uint64)])
    sent = pa.Table.from_batches(phrases._summed(iter([keys[:2500], keys[2500:]]), 7))
    assert sent.num_rows == 7 and sent.column("dealt").to_pylist() == list(range(7))
    assert np.array_equal(np.frombuffer(b"".join(sent.column("keys").to_pylist()), np.uint64), np.unique(keys))
    docs = spark.createDataFrame([(k, "x", "en") for k in range(40)], "doc_id long, text string, lang string").repartition(3)
    often = phrases._often(docs, lambda batches: (keys for b in batches for _ in range(b.num_rows)), 120)
    want = np.unique(np.concatenate([found[:1000], np.array([0, 2**64 - 1], np.uint64)]))
    got = np.array([r.key for r in often.collect()], np.int64)
    assert np.array_equal(np.sort(got.view(np.uint64)), want)
    chosen = phrases.gathered(often)
    assert chosen.has(want).all() and not chosen.has(found[1000:]).any()
    ones = sum(int(b).bit_count() for b in chosen.bits)
    assert ones == len(np.unique(phrases.Filter.places(want)))


@pytest.mark.parametrize("spread", [1 << 64, 50])
def test_words_are_kept_by_bytes_in_a_small_table(monkeypatch, spread):
    """A cache of 64 places, full at once, and hashes that many words share: the ids stay the library's."""
    real = common.span_hashes
    monkeypatch.setattr(packing, "span_hashes", lambda *a: np.array([int(x) % spread for x in real(*a)], np.uint64))
    monkeypatch.setattr(packing, "CACHE_PLACES", 64)
    monkeypatch.setattr(packing, "CACHE_WORDS", 150)
    encoding, lib = packing.WordEncoding(queries.WORD_TOKENIZER), library()
    words = [f"{a}{b}{c}" for a in ("The", "straße", "x1", "né!") for b in ("house", "of", "ünder", "don't") for c in ("", "s.", "##", "ing")]
    for k in range(6):
        texts = [" ".join(words[k * 7 : k * 7 + n]) for n in (0, 3, 20, 40)] + [" ".join(words) * (k == 3), " ".join(t for _, t in ODD if t)]
        ids, begin = encoding.encode(*common.buffers(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(begin.tolist())] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert encoding.cache.placed <= 48
