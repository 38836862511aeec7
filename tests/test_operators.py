"""Operators on literal rows."""

import datetime as dt
import glob
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import fixed
from tidewater.functions import metrics as M
from tidewater.functions import text as X
from tidewater.operators import dedup as D
from tidewater.operators import features as A
from tidewater.operators import ranges
from tidewater.operators import records as R
from tidewater.operators import splits as S
from tidewater.operators import tasks as K
from tidewater.sources import tables
from tidewater.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_refang(spark):
    for raw, want in [("1.1.1[.]1", "1.1.1.1"), ("hxxp://evil[.]com/path", "http://evil.com/path"), ("a[DOT]b", "a.b"), ("clean.com", "clean.com")]:
        assert one(spark, X.refang(F.lit(raw))) == want


def test_observable_key_folds_values_of_types_without_case(spark):
    for value, kind, want in [("\tEvil.COM ", "domain", "evil.com::domain"), ("Evil.com", "Domain", "evil.com::domain"), ("http://A/B", "C2_Domain", "http://a/b::c2_domain"), ("ABC", "MD5", "ABC::md5"), ("Mutex", "mutex", "Mutex::mutex"), (None, None, "::")]:
        assert one(spark, X.observable_key(F.lit(value).cast("string"), F.lit(kind).cast("string"))) == want


def test_addresses(spark):
    for raw, want in [("from 10[.]0[.]0[.]1.", ["10[.]0[.]0[.]1"]), ("99921.2.3.45678", []), ("1.2.3.4 5.6.7.8", ["1.2.3.4", "5.6.7.8"]), ("v1.2.3", [])]:
        assert one(spark, X.extract_all(F.lit(raw), fixed.IP_PATTERN)) == want


def test_labels_read_whole_signs(spark):
    for tags, score, want in [(["Observed-in-the-Wild:Yes"], 0.0, 1), (["observed-in-the-wild:no"], 0.0, 0), (["exploited"], 0.1, 0), ([], 0.11, 1), (["was-zero-day:yes"], None, 1), ([], None, 0)]:
        made = F.array(*(F.lit(t) for t in tags)).cast("array<string>")
        assert one(spark, A.label(made, F.lit(score).cast("double"))) == want


def test_tags(spark):
    tags = F.array(*(F.lit(t) for t in ("PIR-1", "pirate", "apt29", "other")))
    assert one(spark, X.normalise_tags(tags, {"apt29": "cozy"})) == ["cozy", "other"]


def test_taxonomy_order_and_fallback(spark):
    entries = [("automotive", "Cars"), ("energy", "Energy"), ("automotive", "Transport"), ("financial services", "Finance")]
    for raw, want in [("Automotive", "Transport"), (" global financial services ", "Finance"), ("solar energy", "solar energy"), ("x", "x")]:
        assert one(spark, X.taxonomy(F.lit(raw), entries)) == want


def test_list_of(spark):
    for raw, want in [('["a","b"]', ["a", "b"]), ("[broken", ["[broken"]), ("plain", ["plain"]), ("", [])]:
        assert one(spark, X.list_of(F.lit(raw))) == want


def test_html(spark):
    html = '<div class="event x"><span class="date">2024-01-02</span><p>T1059.001 from 10[.]0[.]0[.]1</p></div>'
    row = X.timeline_events(spark.createDataFrame([(1, html)], "id int, html string")).first()
    assert (row.event_date, row.techniques, row.ioc) == ("2024-01-02", ["T1059.001"], "10.0.0.1")
    rows = "<table><tr><th>a</th></tr><tr><td>A</td><td>uses</td><td>B</td><td>Direct</td></tr><tr><td>A</td><td>uses</td><td>C</td><td>odd</td></tr></table>"
    got = X.parse(spark.createDataFrame([(1, rows)], "id int, html string"), "associations").orderBy("row_no").collect()
    assert [(r.target_ref, r.attribution_scope) for r in got] == [("B", "direct"), ("C", "unknown")]
    with pytest.raises(KeyError):
        X.parse(spark.range(1), "none")
    X.parser("own")(lambda pages: pages.select("id"))
    assert X.parse(spark.range(2), "own").count() == 2 and X.PARSERS.pop("own")


def test_canonical_merge(spark):
    rows = spark.createDataFrame([("a", "k", "f1", 5, 1), ("b", "k", "f2", 9, 2), ("c", "k", "f2", 9, 3), ("d", "z", "f1", None, 4)], "id string, k string, feed string, conf int, ord int")
    got = {r.dedup_key: r for r in D.canonical(rows, F.col("k"), "id", "feed", F.coalesce("conf", F.lit(0)), "ord", ["id", "feed"]).collect()}
    assert (got["k"].canonical_id, got["k"].source_feed_count, got["k"].distinct_event_count) == ("canonical-b", 2, 3)
    assert sorted((r.dedup_key, r.id) for r in D.members(rows, F.col("k"), "id").collect()) == [("k", "a"), ("k", "b"), ("k", "c"), ("z", "d")]
    assert round(got["k"].corroboration_score, 3) == 0.477
    assert (got["z"].dedup_status, got["z"].corroboration_score, got["z"].canonical_id) == ("singleton", 0.0, None)
    assert sum(r.distinct_event_count for r in got.values()) == 4


def test_story_bands(spark):
    df = spark.createDataFrame([(0.97,), (0.87,), (0.5,), (None,)], "s double").select(D.story_band(F.col("s")).alias("b"))
    assert [r.b for r in df.collect()] == ["merged", "possible_duplicate", "distinct", "quarantined_pair"]


def test_shingles_read_whole_texts(spark):
    text = " ".join(f"w{k}" for k in range(100))
    assert one(spark, X.shingles(F.lit(text))) == text.split() and len(one(spark, X.shingles(F.lit(text), head=200))) < 60
    assert one(spark, X.shingles(F.lit("A b  a b c"), 2)) == ["a b", "b a", "b c"] and one(spark, X.shingles(F.lit("a"), 2)) == []


def test_story_links_have_no_cap_and_whole_texts(spark):
    base = [f"w{k}" for k in range(60)]
    texts = {i: " ".join(base) for i in range(30)}  # copies: more than 20 hold each word
    texts |= {100 + i: " ".join([*base, f"x{i}"]) for i in range(30)}
    texts |= {200: " ".join([f"head{k}" for k in range(6)] + base), 201: " ".join(base[:40] + [f"y{k}" for k in range(300)]), 202: " ".join(base[:40] + [f"z{k}" for k in range(300)]), 300: "", 301: None}
    docs = spark.createDataFrame(sorted(texts.items()), "id int, text string")
    members, sets = D.story_classes(docs, "id", X.shingles(F.col("text")))
    assert {r.id: r.class_id for r in members.collect()} == {i: 0 if i < 30 else i for i in texts}
    words = {i: set((t or "").split()) for i, t in texts.items() if t and (i == 0 or i >= 30)}
    want = {(a, b, len(words[a] & words[b])) for a in words for b in words if a < b and 100 * len(words[a] & words[b]) >= 82 * len(words[a] | words[b])}
    for block in (1000, 7):
        got = [(r.left_id, r.right_id, r.n_shared) for r in D.story_links(sets, block=block).collect()]
        assert sorted(got) == sorted(want)
    assert (0, 129, 60) in want and (0, 200, 60) in want and not any(201 in p or 202 in p for p in want)


def test_story_links_move_sets_little(spark):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(4000)]
    texts = [rng.sample(words, 300) for _ in range(150)]
    near = [[w for w in texts[0] if rng.random() > 0.04] + [f"own{k}"] for k in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + near)], "id int, text string")
    folder = spark.conf.get("spark.checkpoint.dir")
    size = lambda found: sum(os.path.getsize(f) for d in found for f in glob.glob(f"{d}/*.parquet"))
    before = set(glob.glob(f"{folder}/*"))
    _, sets = D.story_classes(docs, "id", X.shingles(F.col("text")))
    classes = set(glob.glob(f"{folder}/*")) - before
    links = D.story_links(sets).collect()
    other = set(glob.glob(f"{folder}/*")) - before - classes
    assert len(links) > 500 and size(other) < 0.25 * size(classes)  # no copy of the sets


def test_story_pairs_meet_once_and_sketches_lose_none(spark):
    sets = [np.sort(np.random.default_rng(i // 8).integers(-(2**63), 2**63, 200 + 37 * (i // 8))) for i in range(24)]
    sets = [np.sort(np.concatenate([s[np.random.default_rng(99 + i).random(len(s)) > 0.04], np.random.default_rng(500 + i).integers(-(2**63), 2**63, 5)])) for i, s in enumerate(sets)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(24), pa.int64()), pa.array(sets)], names=["class_id", "h"])
    want = {(a, b) for a in range(24) for b in range(a + 1, 24) if 100 * len(x := np.intersect1d(sets[a], sets[b])) >= 82 * (len(sets[a]) + len(sets[b]) - len(x))}
    entries = pa.Table.from_batches(D._prefixes(iter([rows]), 82, np.full(1 << D.BUCKET_BITS, 50, np.uint8), 255)).drop_columns(["heavy"])
    for k in ("block", "j", "i"):
        entries = entries.add_column(1, k, pa.array(np.zeros(len(entries), np.int32)))
    met = pa.Table.from_batches(D._pairs(iter(entries.sort_by([("token", "ascending"), ("at", "ascending")]).to_batches()), 82)).to_pydict()
    pairs = list(zip(met["left_id"], met["right_id"], strict=True))
    assert want <= set(pairs) and len(pairs) < 1.3 * len(set(pairs)) and len(want) > 60
    sketches = pa.Table.from_batches(D._sketched(iter([rows]))).to_pylist()
    homes = [{"g": 0, "i": 0, "j": 0, "id": r["class_id"], "other": None, "n": r["n"], "sketch": r["sketch"]} for r in sketches]
    asked = [{"g": 0, "i": 0, "j": 0, "id": a, "other": b, "n": None, "sketch": None} for a in range(24) for b in range(a + 1, 24)]
    kind = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("id", pa.int64()), ("other", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary())])
    near = pa.Table.from_batches(D._near(iter(pa.Table.from_pylist(homes + asked, kind).to_batches(max_chunksize=10)), 82)).to_pydict()
    kept = set(zip(near["left_id"], near["right_id"], strict=True))
    assert want <= kept and len(kept) < 100


def test_sector_trends_take_every_sector(spark):
    rows = [(1, "a", "2024-01-01"), (1, "b", "2024-01-08"), (1, "b", "2024-01-09"), (2, "c", "2024-01-15"), (None, "a", "2024-01-01"), (1, "a", None)]
    got = A.sector_trends(spark.createDataFrame(rows, "s int, t string, d string"), "s", "t", F.to_date("d"), 1).collect()
    assert sorted((r.s, r.t, str(r.week_start), r.n) for r in got) == [(1, "b", "2024-01-01", 0), (1, "b", "2024-01-08", 2), (2, "c", "2024-01-15", 1)]


def test_upsert_adds_columns(spark):
    old = spark.createDataFrame([("a", 1, 1)], "k string, c int, o int")
    new = spark.createDataFrame([("a", 2, 2, "n"), ("b", 1, 3, "m")], "k string, c int, o int, extra string")
    assert {(r.k, r.c, r.extra) for r in D.upsert(old, new, ["k"], F.col("c"), F.col("o")).collect()} == {("a", 2, "n"), ("b", 1, "m")}


def test_tfidf_of_a_common_tool_is_zero(spark):
    df = spark.createDataFrame([("s1", "t"), ("s2", "t"), ("s2", "u"), ("s2", "")], "sector string, tool string")
    got = {(r.sector, r.tool): r.tfidf for r in A.tfidf(df, "sector", "tool").collect()}
    assert got[("s1", "t")] == 0 and round(got[("s2", "u")], 4) == 0.6931 and len(got) == 3


def test_tiers(spark):
    df = spark.createDataFrame([(1, None), (2, "OBSERVED"), (3, "DERIVED")], "i int, tier string")
    assert {r.i for r in A.tier_filter(df, ["OBSERVED"]).collect()} == {1, 2}
    with pytest.raises(ValueError):
        A.tier_filter(df, ["NONE"])


def test_cross_explode(spark):
    df = spark.createDataFrame([(1, ["a", "b"], []), (2, [], ["t"])], "i int, s array<string>, t array<string>")
    assert {(r.i, r.sector, r.tool) for r in A.cross_explode(df, "s", "t").collect()} == {(1, "a", ""), (1, "b", "")}


def test_persistence_needs_eight_weeks(spark):
    weeks = [("a", dt.date(2024, 1, 1) + dt.timedelta(7 * i), i) for i in range(8)] + [("b", dt.date(2024, 1, 1) + dt.timedelta(7 * i), 1) for i in range(7)]
    got = A.persistence(spark.createDataFrame(weeks, "s string, week_start date, n int"), "s").collect()
    assert [(r.s, r.mae) for r in got] == [("a", 2.5)]


def test_average_precision_and_edges(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)], "y int, p double")
    assert abs(M.average_precision(df, "y", "p").first()[0] - 0.8333333) < 1e-6
    assert M.average_precision(df.where("y = 1"), "y", "p").first()[0] == 0.0
    bins = M.calibration_bins(spark.createDataFrame([(1, 1.0), (1, 0.3), (0, 0.2999)], "y int, p double"), "y", "p").collect()
    assert sorted((r.bin, r.n) for r in bins) == [(2, 2)]  # 0.3 lies under the third edge, 1.0 in no bin
    assert M.top_k_accuracy(df, "y", "p", 2).first()[0] == 0.5
    assert M.mean_absolute_error(df.limit(0), "y", "p").first()[0] == 0.0


def test_time_split(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-02-15",), ("2024-03-01",), ("bad",)], "ts string")
    got = {r.ts: r.part for r in S.time_split(df, X.day(F.col("ts")), 30).collect()}
    assert got == {"2024-01-01": "train", "2024-02-15": "test", "2024-03-01": "test"}


def test_stratified_smaller_and_larger_quota(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "k string, v int")
    quota = spark.createDataFrame([("a", 2), ("b", 9)], "stratum string, quota int")
    assert sorted((r.stratum, r.v) for r in S.stratified(df, F.col("k"), quota, [F.col("v").desc()]).collect()) == [("a", 3), ("a", 4), ("b", 1)]


def test_date_slices_keep_the_tail():
    got = tables.date_slices("2024-01-01", "2024-01-11", 3)
    assert got[0][0] == "2024-01-01" and got[-1][1] == "2024-01-11" and all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "n": 2}\nnot json\n[{"id": "2", "n": 3}, {"id": "3"}]\n')
    good, bad = tables.json_records(spark, str(tmp_path / "a.json"), T.StructType.fromDDL("id string, n int"))
    assert sorted((r.id, r.n) for r in good.collect()) == [("1", 2), ("2", 3), ("3", None)] and bad.count() == 1
    (tmp_path / "v.csv").write_text("id,score\na,0.5\nb,x\n")
    assert [(r.id, r.score) for r in tables.csv_records(spark, str(tmp_path / "v.csv"), {"score": "double"}).collect()] == [("a", 0.5), ("b", None)]
    tables.write_batch(good, str(tmp_path / "raw"), "b1", "actor")
    assert spark.read.parquet(str(tmp_path / "raw")).where("batch_id = 'b1' and record_type = 'actor'").count() == 3


def test_json_records_lose_nothing(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n  {"id": "1",\n   "n": 2},\n  {"id": "2"}, 5\n]\n')
    (tmp_path / "b.json").write_text('42\n"abc"\n{"id": "3", "n": 1}\n\n{"id": "4"\n[{"id": "5"}]\n')
    (tmp_path / "c.json").write_text('[{"id": "6"}]\n[{"id": "7"}]\n')
    (tmp_path / "d.json").write_text('[\n{"id": "8"},\n')
    good, bad = tables.json_records(spark, str(tmp_path), T.StructType.fromDDL("id string, n int"))
    assert sorted((r.id, r.n) for r in good.collect()) == [("1", 2), ("2", None), ("3", 1), ("5", None), ("6", None), ("7", None)]
    assert sorted(r.reason.strip() for r in bad.collect()) == ['malformed json: [\n{"id": "8"},', 'malformed json: {"id": "4"', 'no object: "abc"', "no object: 42", "no object: 5"]


def test_sources(spark, tmp_path):
    folder = str(tmp_path / "f")
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 3)], "id string, n int, ord int")
    assert tables.write_rows(rows, f"{folder}/t") and not tables.write_rows(rows.limit(0), f"{folder}/t") and spark.read.parquet(f"{folder}/t").count() == 3
    tables.merge_table(spark.createDataFrame([("b", 4, 9), ("c", 1, 4)], "id string, n int, ord int"), f"{folder}/t", ["id"], F.col("n"), F.col("ord"))
    assert sorted((r.id, r.n) for r in spark.read.parquet(f"{folder}/t").collect()) == [("a", 2), ("b", 5), ("c", 1)]
    tables.upsert_json(rows, f"{folder}/j", "id", "ord")
    tables.upsert_json(spark.createDataFrame([("b", 7, 1)], "id string, n int, ord int"), f"{folder}/j", "id", "ord")
    got = spark.read.schema("id string, n int").option("recursiveFileLookup", "true").json(f"{folder}/j")
    assert sorted((r.id, r.n) for r in got.collect()) == [("a", 2), ("b", 7)]
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "x.json").write_text('{"id": "x", "n": 1}')
    (raw / "bad.json").write_text('{"id": ')
    assert {r.id for r in tables.checkpoints(spark, str(raw), T.StructType.fromDDL("id string, n int")).collect()} == {"x"}
    import shutil

    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"id": ["y"], "n": pa.array([2], pa.int32())}), raw / "bulk.parquet")
    (raw / "bad.json").unlink()
    assert {r.id for r in tables.raw_store(spark, str(raw), T.StructType.fromDDL("id string, n int")).collect()} == {"x", "y"}
    import hashlib

    want = [("x.json", hashlib.sha256((raw / "x.json").read_bytes()).hexdigest().upper()), ("bulk.parquet", "0")]
    assert {r.path.rpartition("/")[2]: r.ok for r in tables.verified(spark, str(raw), spark.createDataFrame(want, "name string, sha256 string")).collect()} == {"x.json": True, "bulk.parquet": False}
    (tmp_path / "n").mkdir()
    for name in ("Attack_Patterns.json", "sizing.json", "odd.json"):
        shutil.copy(raw / "x.json", tmp_path / "n" / name)
    kinds = spark.read.text(str(tmp_path / "n")).select(tables.record_type().alias("t")).collect()
    assert sorted(str(r.t) for r in kinds) == ["None", "_sizing", "attackpattern"]
    for k in (1, 2):
        (tmp_path / "frozen" / f"b{k}").mkdir(parents=True)
        (tmp_path / "frozen" / f"b{k}" / "manifest.json").write_text(f'{{"run_id": "r{k}", "rows": {k}}}')
    assert [r.run_id for r in tables.manifests(spark, str(tmp_path / "frozen"), T.StructType.fromDDL("run_id string, rows int")).collect()] == ["r2", "r1"]
    assert tables.batch_id("0123456789", {"a": 1, "b": 2}) == "01234567-" + tables.config_digest({"b": 2, "a": 1}) and len(tables.config_digest({})) == 12
    assert {r.name: r.n for r in tables.row_counts(spark, "/root/testdata/sf0.001", ["region", "orders"]).collect()} == {"region": 5, "orders": 1500}
    tables.write_report(spark.createDataFrame([("b1", 3)], "batch string, n int"), f"{folder}/r")
    assert spark.read.json(f"{folder}/r").first().n == 3


def test_running_sums_and_splits_over_ranges(spark):
    rows = spark.createDataFrame([(i, i % 7, 1 if i % 3 else 0) for i in range(500)], "i int, v int, k int")
    got = {r.i: (r.total, r.number) for r in ranges.numbered(ranges.running_sums(rows, [F.col("i")], {"total": "v"}), [F.col("i").desc()]).collect()}
    total = 0
    for i in range(500):
        total += i % 7
        assert got[i] == (total, 500 - i)
    split = S.fraction_split(rows, ["i"], F.col("k")).groupBy("k", "split").agg(F.count("*").alias("n"), F.max("i").alias("m"), F.min("i").alias("l")).collect()
    sides = {(r.k, r.split): r for r in split}
    assert sides[(1, "train")].n == 333 * 3 // 4 and sides[(1, "train")].m < sides[(1, "test")].l and sides[(0, "train")].n == 167 * 3 // 4
    assert S.fraction_split(rows.limit(0), ["i"]).count() == 0


def test_records(spark):
    raw = spark.createDataFrame([("1", "evil[.]com", "domain", "", "f", 5, "2024", ["PIR-1", "beacon", "", "x"]), (None, "a", "url", "s", None, 1, None, []), ("3", None, "url", "s", None, 1, None, None)],
                                "id string, value string, itype string, source string, source_feed string, confidence int, created_ts string, tags array<string>")
    good, bad = R.clean_observables(raw, "r1")
    row = good.collect()[0]
    assert (row.entity_id, row.value, row.source_feed, row.tags, row.provenance.tier) == ("1", "evil.com", "f", ["Cobalt Strike", "x"], "OBSERVED")
    assert sorted((r.record_id, r.reason) for r in bad.collect()) == [("3", "no value"), ("?", "no id")]
    a = spark.createDataFrame([("1", "2024-01-02T03"), ("2", ""), ("3", "2024-05-05")], "id string, ts string")
    b = spark.createDataFrame([("1", "2023-01-01"), ("3", None)], "id string, ts string")
    assert {r.entity_id: r.created_ts for r in R.day_lookup([a, b], "id", "ts").collect()} == {"1": "2023-01-01", "3": "2024-05-05"}


def test_tasks(spark):
    with pytest.raises(ValueError):
        K.task("t9", spark.range(1))
    few = spark.createDataFrame([("s", "t", "2024-01-01", 1)], "industry string, tool string, created_ts string, ord int")
    assert K.task("t2-industry", few).evaluate().first().status == "insufficient_data"
    rows = [("s", "a", f"2024-01-{d:02}", d, "DERIVED") for d in range(1, 21)] + [("s", "b", "2024-01-20", 99, "UNVALIDATED")]
    out = K.task("t2-industry", spark.createDataFrame(rows, "industry string, tool string, created_ts string, ord int, tier string")).evaluate().first()
    assert (out.split, out.holdout_start, out.train_rows, out.holdout_rows, out.accuracy) == ("time", "2024-01-13", 12, 8, 1.0)
    plain = K.task("t2-industry", spark.createDataFrame([(*r[:2], None, r[3]) for r in rows[:8]], "industry string, tool string, created_ts string, ord int")).evaluate().first()
    assert (plain.split, plain.train_rows, plain.holdout_rows) == ("fraction", 6, 2)
    flat = K.task("t2", spark.createDataFrame([("a",), ("a",), ("",)], "tool string")).predict().collect()
    assert [(r.tool, r.total, r.trending_up) for r in flat] == [("a", 2, False)]
    vulnerabilities = spark.createDataFrame([((i % 7) / 10, 5.0 * (i % 5 > 2) + i % 2, 1, int(i % 5 > 2), f"2024-0{1 + i // 20}-{1 + i % 20:02}", i) for i in range(60)], "epss_score double, cvss_score double, tag_count int, exploited int, first_seen string, ord int")
    got = K.task("t1", vulnerabilities.where("ord < 30")).evaluate().first()
    assert got.status == "ok" and got.train_size + got.test_size == 30 and got.pr_auc >= 0.9 and abs(got.lift - (got.pr_auc - got.baseline_pr_auc)) < 1e-9
    assert K.task("t1", vulnerabilities.limit(3)).evaluate().first().status == "insufficient_data"
    assert K.task("t3", spark.createDataFrame([("c",), ("",)], "company_name string")).predict().first().status == "not_supported"


def test_story_groups(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (20, 30), (5, 6), (6, 7), (7, 8), (8, 11)], "left_id long, right_id long")
    assert {r.class_id: r.group_id for r in D.story_groups(links).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 30: 20, 5: 5, 6: 5, 7: 5, 8: 5, 11: 5}


def test_stream_goes_on_from_its_folder(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    inside = tmp_path / "in" / "t.parquet"
    inside.mkdir(parents=True)
    pq.write_table(pa.table({"k": [1, 2], "v": [1.0, 5.0]}), inside / "a.parquet")
    run = lambda: jobs.drained(jobs.stream_of(spark, str(inside)), str(tmp_path / "job"))
    assert run().count() == 2 and run().count() == 2
    pq.write_table(pa.table({"k": [1], "v": [7.0]}), inside / "b.parquet")
    assert run().count() == 3
    best = jobs.drained(jobs.best(jobs.stream_of(spark, str(inside)), ["k"], F.col("v"), F.col("k"), ["v"]), str(tmp_path / "best"), "complete")
    assert {r.k: r.v for r in best.collect()} == {1: 7.0, 2: 5.0}


def test_html_blocks_as_a_parser_finds_them(spark):
    """Every event block of the pages against the standard library's HTML parser."""
    from html.parser import HTMLParser

    class Blocks(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found, self.open = [], None

        def handle_starttag(self, tag, attrs):
            if tag == "div" and "event" in (dict(attrs).get("class") or ""):
                self.open = [] if self.open is None else self.open

        def handle_endtag(self, tag):
            if tag == "div" and self.open is not None:
                self.found.append(" ".join("".join(self.open).split()))
                self.open = None

        def handle_data(self, data):
            if self.open is not None:
                self.open.append(data + " ")

    pages = spark.createDataFrame([(i, "".join(f'<div class="{"event" if (i + k) % 3 else "other"} x"><b>2024-0{1 + k}-0{1 + i % 9}</b> T10{k}{i % 10} <i>at 10[.]0[.]{k}[.]{i}</i></div><p>between</p>' for k in range(4))) for i in range(30)], "page_id int, html string")
    got = {}
    for r in X.parse(pages, "timeline").orderBy("page_id", "event_no").collect():
        got.setdefault(r.page_id, []).append(r.raw_text)
        assert r.event_date in r.raw_text and r.ioc.replace(".", "[.]") in r.raw_text and all(t in r.raw_text for t in r.techniques)
    for r in pages.collect():
        p = Blocks()
        p.feed(r.html)
        assert got.get(r.page_id, []) == p.found
