"""Fuzzy names, shortlists, clusters, forests, series, trust, patterns and committed tables against plain versions."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import metrics as M
from tidewater.functions import text as X
from tidewater.operators import density, fuzzy, graph, isolation, patterns, series, shortlist, trust
from tidewater.plans import mining, registry
from tidewater.sources import tables, versions

FOLDER = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("percent", [80, 88, 95])
def test_all_near_names_are_found(spark, percent):
    rng = random.Random(percent)
    names = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 24))) for _ in range(60)] + ["hehehehehehe", "ehehehehehe", "hehehehe", "a" * 20, "a" * 22]
    for n in list(names):
        for _ in range(2):
            at = rng.randrange(len(n))
            names.append(rng.choice([n[:at] + n[at + 1 :], n[:at] + "x" + n[at:], n[:at] + "y" + n[at + 1 :]]))
    df = spark.createDataFrame([(n,) for n in [*names, *names[:9], "", None]], "name string")
    distinct = sorted({n for n in names if n})
    want = {(a, b, k) for i, a in enumerate(distinct) for b in distinct[i + 1 :] for k in [edits(a, b)] if 100 * k <= (100 - percent) * max(len(a), len(b))}
    assert {tuple(r) for r in fuzzy.name_links(df, "name", percent).collect()} == want and len(want) > 20
    found = {r.name: r.cluster for r in fuzzy.name_clusters(df, "name", percent).collect()}
    assert set(found) == {*distinct, ""} and all(found[a] == found[b] <= min(a, b) for a, b, _ in want)
    with pytest.raises(ValueError, match="80 percent"):
        fuzzy.name_links(df, "name", 70)


def test_names_of_one_edit_are_not_compared_with_others(spark):
    rng = random.Random(8)
    names = {"".join(rng.choice("ab") for _ in range(11)) + "tion" for _ in range(300)}  # all share grams
    names |= {"aabbaabbccc", "aabbaabbcc", "abbaabbccc", "naïveté€漢字abc", "naïveté€漢字ab", "naïveté€漢字xbc"}
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("len", F.length("name"))
    pairs = [tuple(r) for r in fuzzy._one_edit(df, 88).collect()]
    allowed = lambda a, b: edits(a, b) <= 1 and 100 <= 12 * max(len(a), len(b)) < 200
    want = {(a, b) for a in names for b in names if a < b and allowed(a, b)}
    assert len(pairs) == len(want) and {(min(p), max(p)) for p in pairs} == want and len(want) > 50
    assert {(r.left_name, r.right_name) for r in fuzzy.name_links(df, "name").where("distance = 1").collect()} >= want
    assert fuzzy.name_links(df, "name", 100).count() == 0


def test_clusters_read_names_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([("abcdefghij",), ("abcdefghix",), ("abcdefghiy",), ("zzzzzzzzzz",), (None,)], "name string").mapInArrow(read, "name string")
    assert {r.name: r.cluster for r in fuzzy.name_clusters(df, "name").collect()} == {"abcdefghij": "abcdefghij", "abcdefghix": "abcdefghij", "abcdefghiy": "abcdefghij", "zzzzzzzzzz": "zzzzzzzzzz"}
    assert seen.value == 5


def test_components_of_strings(spark):
    edges = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "b"), ("x", "y"), (None, "z")], "a string, b string")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {"b": "b", "c": "b", "d": "b", "x": "x", "y": "x"}


def test_shortlists_find_nine_in_ten(spark, monkeypatch):
    monkeypatch.setattr(shortlist, "BLOCK", 40)  # cells of many rows are dealt out
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    odd = spark.createDataFrame([(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] * 64, 1), (None, [1.0] * 64, 1)], vectors.schema)
    queries = vectors.where("vec_id % 50 = 0")
    rows = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in vectors.collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    best = {}
    for q in ids[ids % 50 == 0]:
        c = x @ rows[q]
        c[ids == q] = -2
        best[int(q)] = [int(i) for i in ids[np.lexsort([ids, -c])[:10]]]
    got = shortlist.shortlist(vectors.unionByName(odd), queries, "vec_id", "embedding").collect()
    hits = sum(r.id in best[r.query_id] for r in got)
    assert hits >= 0.9 * 10 * len(best) and all(abs(r.cosine - float(rows[r.id] @ rows[r.query_id])) < 1e-9 for r in got)
    exact = shortlist.shortlist(vectors, queries, "vec_id", "embedding", probes=99, cells=5).collect()
    assert {(r.query_id, r["rank"]): r.id for r in exact} == {(q, i + 1): v for q, ids_ in best.items() for i, v in enumerate(ids_)}
    assert shortlist.shortlist(vectors.limit(0), queries, "vec_id", "embedding").count() == 0


def brute_dbscan(points, eps, least):
    ids = [p[0] for p in points]
    x = np.array([p[1:] for p in points], float)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in np.flatnonzero(core):
        for j in np.flatnonzero(near[i] & core):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    label = lambda i: ids[find(i)]
    return {ids[i]: (bool(core[i]), label(i) if core[i] else min((label(j) for j in np.flatnonzero(near[i] & core)), default=None)) for i in range(len(ids))}


@pytest.mark.parametrize(("eps", "least", "few"), [(0.3, 5, 8), (0.25, 12, 4096)])
def test_dbscan_as_by_all_pairs(spark, monkeypatch, eps, least, few):
    monkeypatch.setattr(density, "FEW", few)  # dense cells are halved again and again
    rng = random.Random(3)
    points = [(i, rng.gauss(rng.choice([0, 3, 6]), 0.6), rng.gauss(rng.choice([0, 4]), 0.6)) for i in range(300)]
    points += [(500 + i, 1.0, 1.0) for i in range(60)] + [(600 + i, 1.0 + 0.3 * (i % 2) + i * 1e-7, 1.0) for i in range(80)] + [(700 + i, 20 + i * 0.29, 5.0) for i in range(12)]
    df = spark.createDataFrame([*points, (9998, None, 1.0), (9999, float("nan"), 1.0), (None, 0.0, 0.0)], "id long, x double, y double")
    assert {r.id: (r.core, r.cluster) for r in density.dbscan(df, "id", ["x", "y"], eps, least).collect()} == brute_dbscan(points, eps, least)


def test_dbscan_of_one_coordinate_and_no_rows(spark):
    points = [(i, i * 0.4 if i < 20 else 100.0 + i * 3) for i in range(30)]
    df = spark.createDataFrame(points, "id long, x double")
    assert {r.id: (r.core, r.cluster) for r in density.dbscan(df, "id", ["x"], 1.0, 3).collect()} == brute_dbscan(points, 1.0, 3)
    assert density.dbscan(df.limit(0), "id", ["x"], 1.0, 3).count() == 0


def test_isolation_forest_by_a_plain_walk(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(0, 1, 3))) for i in range(400)] + [(1000, 9.0, -9.0, 9.0), (1001, None, 0.0, 0.0), (1002, float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    forest = isolation.fit(df, "id", ["a", "b", "c"], trees=25, sample=64)
    again = isolation.fit(df.repartition(7), "id", ["a", "b", "c"], trees=25, sample=64)
    assert (forest.threshold == again.threshold).all() and forest.rows == 64
    got = {r.id: r.anomaly for r in forest.judge(df).collect()}
    for i, *x in rows[:401]:
        paths = []
        for f, t, p in zip(forest.feature, forest.threshold, forest.path, strict=True):
            node = 0
            while f[node] >= 0:
                node = 2 * node + (1 if x[f[node]] < t[node] else 2)
            paths.append(p[node])
        assert abs(got[i] - 2 ** (-np.mean(paths) / float(isolation.expected_path(64)))) < 1e-12
    assert got[1001] is None and got[1002] is None and max((v, k) for k, v in got.items() if v is not None)[1] == 1000
    assert isolation.fit(df.limit(0), "id", ["a"]).judge(df.limit(0)).count() == 0


def test_arima_as_least_squares(spark):
    rng = np.random.default_rng(7)
    y = [10.0, 12.0]
    for _ in range(200):
        y.append(y[-1] + 0.5 * (y[-1] - y[-2]) + 0.3 + rng.normal(0, 0.2))
    beta, w, e = series.fit_arima(np.array(y), 1, 1, 0)
    slope, const = np.polyfit(w[:-1], w[1:], 1)
    assert np.allclose(beta, [const, slope]) and abs(beta[1] - 0.5) < 0.15 and np.allclose(e[1:], w[1:] - const - slope * w[:-1])
    out, error = series.forecast_arima(np.array(y), 1, 1, 0, 3)
    by_hand, last, at = [], w[-1], y[-1]
    for _ in range(3):
        last = const + slope * last
        at += last
        by_hand.append(at)
    assert np.allclose(out, by_hand) and (np.diff(error) > 0).all()
    # A moving average is found again, and its term matters.
    shocks = rng.normal(0, 1, 3000)
    found = series.fit_arima(5 + shocks[1:] + 0.6 * shocks[:-1], 0, 0, 1)[0]
    assert abs(found[1] - 0.6) < 0.1 and abs(found[0] - 5) < 0.2
    assert series.fit_arima(np.arange(3.0), 1, 1, 1) is None and series.forecast_arima(np.array([4.0, 6.0]), 1, 1, 1, 2)[0].tolist() == [6.0, 6.0]
    rows = spark.createDataFrame([("long", i, float(v)) for i, v in enumerate(y)] + [("short", 0, 4.0), ("short", 1, None)], "name string, at int, y double")
    got = {(r.name, r.step): r for r in series.arima(rows, "name", "at", "y", 1, 1, 0, 3).collect()}
    assert np.allclose([got["long", k].forecast for k in (1, 2, 3)], by_hand) and got["short", 1].forecast == 0.0 and (got["short", 1].lower is None or math.isnan(got["short", 1].lower))
    test = {r.name: r for r in series.arima_backtest(rows, "name", "at", "y", 1, 1, 0).collect()}
    assert test["long"].mae < test["long"].persistence_mae


def test_daily_series_have_days_of_none(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-03"), ("a", "2024-01-03"), ("b", None), (None, "2024-01-01")], "k string, d string")
    assert sorted((str(r.day), r.n) for r in series.daily(df, "k", F.to_date("d")).collect()) == [("2024-01-01", 1), ("2024-01-02", 0), ("2024-01-03", 2)]


def test_density_bounds_hold_their_rank_error(spark):
    df = spark.range(200_000).select(F.lit("s").alias("k"), F.pmod(F.col("id") * 7919, F.lit(200_000)).cast("double").alias("v"))
    r = series.density_bounds(df, "k", "v", 0.01, 1000).first()
    assert abs(r.low + 1 - 2000) <= 200_000 / 1000 and abs(r.high + 1 - 198_000) <= 200_000 / 1000  # the rank of v is v + 1
    few = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("a", None), (None, 5.0)], "k string, v double")
    got = series.density_outliers(few, "k", "v", 0.05).collect()
    assert {r.v for r in got if r.outlier} == {0.0, 1.0, 2.0, 3.0, 95.0, 96.0, 97.0, 98.0, 99.0} - ({95.0} if [r.high for r in got if r.k][0] >= 95 else set()) and len(got) == 102


def test_density_bounds_are_exact_beyond_a_sketch(spark):
    values = sorted((i * 7919 % 50_021) / 100 for i in range(50_000))
    df = spark.range(50_000).select(F.lit("a").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(50_021)) / 100).alias("v"))
    odd = [("b", 1.0), ("b", float("nan")), ("b", None), ("c", None), (None, 3.0), (None, 3.0), (None, -2.0)]
    rows = df.unionByName(spark.createDataFrame(odd, "k string, v double"))
    got = {r.k: (r.n, r.low, r.high) for r in series.density_bounds(rows, "k", "v").collect()}
    assert got["a"] == (50_000, values[499], values[49_499]) and got[None] == (3, -2.0, 3.0) and set(got) == {"a", "b", None}
    assert got["b"][:2] == (2, 1.0) and math.isnan(got["b"][2])
    out = series.density_outliers(rows, "k", "v").groupBy("k").agg(F.count("*").alias("n"), F.count_if("outlier").alias("o")).collect()
    assert {r.k: (r.n, r.o) for r in out} == {"a": (50_000, 999), "b": (3, 0), "c": (1, 0), None: (3, 0)}


def test_auc_and_isotonic_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3 + 0.4 * k / 300)) for k in range(300)]
    rows = [(s, int(rng.random() < s)) for s, _ in rows]
    df = spark.createDataFrame([*rows, (None, 1), (0.5, None)], "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(M.roc_auc(df, "y", "s").first()[0] - want) < 1e-12
    assert M.roc_auc(df.where("y = 1"), "y", "s").first()[0] is None and M.roc_auc(df.limit(0), "y", "s").first()[0] is None
    blocks = []  # pool adjacent violators, one by one
    for s in sorted({s for s, _ in rows}):
        own = [y for t, y in rows if t == s]
        blocks.append([sum(own), len(own), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            p, n, at = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + n, blocks[-1][2] + at]
    pooled = {s: p / n for p, n, at in blocks for s in at}
    got = M.calibrated(df, "y", "s").collect()
    assert all(abs(r.calibrated - pooled[r.s]) < 1e-9 for r in got if r.s is not None) and [r.calibrated for r in got if r.s is None] == [None] and len(got) == 302
    assert M.calibrated(df.limit(0), "y", "s").count() == 0


def test_scores_are_rounded_as_in_sql(spark):
    sql = "SELECT i, round(i / 5000.0, 2)::DOUBLE AS r FROM range(-30000, 30000) t(i)"
    want = dict(duckdb.sql(sql).fetchall())
    got = spark.range(-30_000, 30_000).select("id", M.rounded(F.col("id") / 5000.0, 2).alias("r")).collect()
    assert {r.id: r.r for r in got} == want and want[725] == 0.14


def test_isotonic_calibration_of_halves_as_in_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, n, int(rng.random() < n / 6000)) for i, n in enumerate([*range(25, 6000, 50)] * 3)]  # halves of a hundredth
    spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = mining.isotonic_calibration(spark, str(tmp_path)).select("score", "n", "calibrated").collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(f"SELECT score, n, calibrated FROM ({registry.ORACLES['isotonic_calibration']})").fetchall())


def test_trust_settles_on_the_better_feeds(spark):
    said = [("a", "v1", "good"), ("a", "v1", "fair"), ("a", "v2", "bad"), ("b", "w1", "good"), ("b", "w2", "bad"), ("c", "u1", "good"), ("c", "u1", "fair"), ("c", "u2", "bad"), ("c", "u2", None), ("d", None, "bad"), ("a", "v2", "bad")]
    winners, feeds = trust.settled(spark.createDataFrame(said, "k string, v string, f string"), ["k"], "v", "f")
    held = {r.f: r.trust for r in feeds.collect()}
    assert {r.k: r.v for r in winners.collect()} == {"a": "v1", "b": "w1", "c": "u1"} and held["fair"] > held["good"] > held["bad"]
    weight, claims = dict.fromkeys(("good", "fair", "bad"), trust.START), {(k, v, f) for k, v, f in said if v and f}
    for _ in range(trust.ROUNDS):
        support = {(k, v): sum(weight[g] for a, b, g in claims if (a, b) == (k, v)) for k, v, _ in claims}
        belief = {(k, v): s / sum(t for (a, _), t in support.items() if a == k) for (k, v), s in support.items()}
        weight = {f: np.mean([belief[k, v] for k, v, g in claims if g == f]) for f in weight}
    assert all(abs(weight[f] - held[f]) < 1e-12 for f in weight)


def test_patterns_as_one_by_one(spark):
    table = ["beta", "alpha", "", "ta a", "alpha", "gam", "漢字"]
    texts = ["alphabeta", "xx gamma", "none", "", None, "beta alpha", "a漢字b", "alalpha"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {i: None if t is None else min((k for k, p in enumerate(table) if p and p in t), default=None) for i, t in enumerate(texts)}
    assert {r.i: r.m for r in df.select("i", patterns.first_match(F.col("t"), table).alias("m")).collect()} == want
    counts = {r.i: r.m for r in df.select("i", patterns.all_matches(F.col("t"), table).alias("m")).collect()}
    assert counts[4] is None and [tuple(x) for x in counts[5]] == [(0, 1), (1, 1), (3, 1)] and counts[2] == []
    assert df.select(patterns.first_match(F.col("t"), []).alias("m")).where("m is not null").count() == 0
    entries = [("financial services", "Finance"), ("bank", "Bank"), ("health care", "Health"), ("government", "Government"), ("bank", "Banking")]
    labels = spark.createDataFrame([(x,) for x in ("Bank", "local government office", " Health Care ", "banking", None, "the financial services of government")], "c string")
    both = labels.select(patterns.taxonomy_of(F.col("c"), entries).alias("a"), X.taxonomy(F.col("c"), entries).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] == ["Banking", "Government", "Health", "banking", None, "Finance"]


def test_committed_tables_survive_a_failed_write(spark, tmp_path):
    root, kind = str(tmp_path / "t"), "id string, n int, ord int"
    assert versions.merge(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 3)], kind), root, ["id"], F.col("n"), F.col("ord")) == 1
    assert versions.merge(spark.createDataFrame([("b", 4, 9), ("c", 1, 4)], kind), root, ["id"], F.col("n"), F.col("ord")) == 2
    rows = lambda df: sorted((r.id, r.n) for r in df.collect())
    assert rows(versions.read_version(spark, root)) == [("a", 2), ("b", 5), ("c", 1)] and rows(versions.read_version(spark, root, 1)) == [("a", 2), ("b", 5)]
    broken = spark.createDataFrame([("d", 1, 1)], kind).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        versions.commit(broken, root)
    assert rows(versions.read_version(spark, root)) == [("a", 2), ("b", 5), ("c", 1)]
    with pytest.raises(FileExistsError):
        versions.commit(spark.createDataFrame([("z", 1, 1)], kind), root, seen=1)  # another writer was faster
    assert versions.versions(spark, root) == [1, 2]
    assert versions.consolidate({"x": spark.createDataFrame([(1,)], "p int"), "y": spark.createDataFrame([("q",)], "s string")}, root) == 3
    assert sorted((r.record_type, r.p, r.s) for r in versions.read_version(spark, root).collect()) == [("x", 1, None), ("y", None, "q")]
    assert versions.vacuum(spark, root, keep=1) >= 4 and versions.versions(spark, root) == [3] and versions.read_version(spark, root).count() == 2
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, root, 1)
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, str(tmp_path / "none"))


def test_merge_of_a_plain_table_loses_nothing(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "id string, n int, ord int"
    spark.createDataFrame([("a", 1, 1)], kind).write.parquet(path)
    broken = spark.createDataFrame([("b", 1, 1)], kind).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        tables.merge_table(broken, path, ["id"], F.col("n"), F.col("ord"))
    assert [r.id for r in spark.read.parquet(path).collect()] == ["a"]
    (tmp_path / "t").rename(tmp_path / "t.before")  # as if a job had ended between its renames
    tables.merge_table(spark.createDataFrame([("b", 1, 1)], kind), path, ["id"], F.col("n"), F.col("ord"))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b"] and not (tmp_path / "t.before").exists()


def test_a_saved_forest_predicts_without_fitting(spark, tmp_path, monkeypatch):
    from tidewater.operators import tasks as K

    rows = spark.createDataFrame([((i % 7) / 10, 5.0 * (i % 5 > 2) + i % 2, 1, int(i % 5 > 2), i) for i in range(60)], "epss_score double, cvss_score double, tag_count int, exploited int, ord int")
    monkeypatch.setattr(K.ExploitTask, "trees", 7)
    task = K.ExploitTask(rows)
    first = {r.ord: r.score for r in task.predict().collect()}
    assert task.save(str(tmp_path)) == 1 and task.save(str(tmp_path)) == 2
    monkeypatch.setattr(K.ExploitTask, "_train", None)  # from here on nothing may be fitted
    other = K.ExploitTask.load(rows.where("ord < 9"), str(tmp_path))
    assert {r.ord: r.score for r in other.predict().collect()} == {i: s for i, s in first.items() if i < 9}
    assert {r.ord: r.score for r in other.predict(rows.where("ord > 50")).collect()} == {i: s for i, s in first.items() if i > 50}
    told = other.explain().collect()
    assert {r.feature for r in told} == set(K.ExploitTask.inputs) and abs(sum(r.normalised for r in told) - 1) < 1e-9 and told == task.explain().collect()
    with pytest.raises(FileNotFoundError):
        K.ExploitTask.load(rows, str(tmp_path / "none"))


def test_saved_tables_of_tasks(spark, tmp_path):
    from tidewater.operators import tasks as K

    rows = spark.createDataFrame([("s", "a", "2024-01-01", 1), ("s", "b", "2024-01-02", 2), ("r", "a", "2024-01-03", 3)], "industry string, tool string, created_ts string, ord int")
    task = K.task("t2-industry", rows)
    assert task.save(str(tmp_path)) == 1
    assert sorted(map(tuple, task.saved(str(tmp_path)).collect())) == sorted(map(tuple, task.fit().collect()))


def test_whole_forecast_states(spark):
    from tidewater.operators import tasks as K

    rows = spark.createDataFrame([("s", t, i) for i, t in enumerate("aabbbcdefg")] + [("r", "a", 99), ("", "a", 1), ("q", None, 1)], "sector string, tool string, o int")
    report = spark.createDataFrame([("ok", 0.7, 0.5, True)], "status string, accuracy double, baseline double, passes_gate boolean")
    out = {r.sector: r for r in K.whole_forecast(rows, report, "sector", "tool").collect()}
    assert set(out) == {"s", "r"} and out["s"].status == "ok" and out["r"].status == "sparse" and abs(out["s"].lift - 0.2) < 1e-12
    assert abs(out["s"].coverage - 10 / 11) < 1e-12 and [p.tool for p in out["s"].prediction] == ["b", "c", "d"] and len(out["s"].contributions) == 5
    assert {r.status for r in K.whole_forecast(rows, None, "sector", "tool").collect()} == {"no_model"}
    bad = report.withColumn("status", F.lit("insufficient_data"))
    assert {r.status for r in K.whole_forecast(rows, bad, "sector", "tool").collect()} == {"insufficient_data"}
    named = K.company_forecast(spark.createDataFrame([("c",), ("c",), ("",), (None,)], "company string"), "company").collect()
    assert [(r.company, r.status) for r in named] == [("c", "not_supported")]


def test_clean_observables_keep_all_fields(spark):
    from tidewater.operators import records as R

    raw = spark.createDataFrame([("1", "evil[.]com", "domain", "", "f", 5, "2024", [("beacon",), ("PIR-1",), (None,)], "2025", "high")], "id string, value string, itype string, source string, source_feed string, confidence int, created_ts string, tags array<struct<name string>>, modified_ts string, severity string")
    r = R.clean_observables(raw, "run")[0].first()
    assert (r.tags, r.modified_ts, r.severity, r.first_seen, r.observable.value, r.observable.type, r.indicator_type, r.confidence, r.created_ts) == (["Cobalt Strike"], "2025", "high", None, "evil.com", "domain", "domain", 5, "2024")


def test_stream_of_changes_is_cleared_and_goes_on(spark, tmp_path):
    from tidewater.streaming import best, jobs

    kind = "user string, value double, id bigint, what string, ts timestamp"
    day = lambda n: __import__("datetime").datetime(2024, 1, 1) + __import__("datetime").timedelta(days=n)
    batches = [
        [("a", 1.0, 1, "x", day(0)), ("a", 3.0, 2, "y", day(1)), ("a", 3.0, 1, "z", day(1)), ("b", None, 5, "n", day(1))],
        [("a", 2.0, 7, "low", day(2)), ("b", 0.5, 6, "up", day(2)), ("c", 1.0, 8, "c", day(100))],
        [("d", 1.0, 9, "d", day(101))],
        [("a", 1.5, 10, "anew", day(102)), ("c", 2.0, 11, "more", day(102))],
    ]
    seen, sizes = [], []
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):  # each time the job goes on from its folder
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        query = best.best_changes(stream, ["user"], "value", "id", ["what"], "ts", "1 day", 30).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
        every = sorted((r.user, r.value, r.id, r.what) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        seen.append([x for x in every if x not in sum(seen, [])])
        sizes.append(max(p["stateOperators"][0]["numRowsTotal"] for p in [query.lastProgress]))
    assert seen[0] == [("a", 3.0, 1, "z"), ("b", 0.0, 5, "n")] and seen[1] == [("b", 0.5, 6, "up"), ("c", 1.0, 8, "c")] and seen[2] == [("d", 1.0, 9, "d")]
    assert seen[3] == [("a", 1.5, 10, "anew"), ("c", 2.0, 11, "more")]  # a's state had gone, c's had not
    assert sizes[2] < sizes[1] + sizes[0] and jobs  # two keys were cleared


def test_json_fields_of_another_type_are_quarantined_whole(spark, tmp_path):
    from pyspark.sql.types import StructType

    long = '{"id": "3", "n": "' + "x" * 500 + '"}'
    (tmp_path / "a.json").write_text('{"id": "1", "n": 2}\n{"id": "2", "n": "abc"}\n' + long + '\n{"id": "4"}\n')
    (tmp_path / "b.json").write_text('[\n{"id": "5", "n": 1},\n{"id": "6", "n": [1]}]\n')
    good, bad = tables.json_records(spark, str(tmp_path), StructType.fromDDL("id string, n int"))
    assert sorted((r.id, r.n) for r in good.collect()) == [("1", 2), ("4", None), ("5", 1)]
    assert good.columns == ["id", "n"] and sorted(r.record for r in bad.collect()) == sorted(['{"id": "2", "n": "abc"}', long, '{"id":"6","n":[1]}'])
    assert all(r.reason.startswith("field of another type: ") for r in bad.collect())


def test_upserted_records_lie_in_few_folders(spark, tmp_path):
    path, kind = str(tmp_path / "j"), "id string, n int, ord int"
    tables.upsert_json(spark.createDataFrame([(f"k{i}", i, 1) for i in range(300)], kind), path, "id", "ord", 8)
    tables.upsert_json(spark.createDataFrame([("k7", 70, 1), ("k7", 71, 2), ("new", 1, 1)], kind), path, "id", "ord", 8)
    got = {r.id: r.n for r in spark.read.schema("id string, n int").option("recursiveFileLookup", "true").json(path).collect()}
    assert got == {f"k{i}": i for i in range(300)} | {"k7": 71, "new": 1} and len([p for p in (tmp_path / "j").iterdir() if p.name.startswith("bucket=")]) == 8
