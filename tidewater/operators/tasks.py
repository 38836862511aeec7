"""Forecasting tasks over feature tables: fit, predict, explain and evaluate are DataFrames."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.text import day, truthy
from ..sources import versions
from . import features as A
from .ranges import written
from .splits import fraction_split, time_split

LEAST_ROWS, LEAST_DATED = 5, 10


def summed_scores(rows: DataFrame, sector: str, tool: str) -> DataFrame:
    """sector, tool, tf and score: each row carries its pair's TF-IDF to four places, and a pair's rows are summed; plain counts if all of them are 0."""
    pairs = written(A.tfidf(rows, sector, tool), "pairs")
    each = F.round("tfidf", 4)
    told = pairs.agg(F.coalesce(F.max(each), F.lit(0.0)).alias("most"))
    return pairs.crossJoin(F.broadcast(told)).select(sector, tool, "tf", F.when(F.col("most") > 0, F.col("tf") * each).otherwise(F.col("tf").cast("double")).alias("score"))  # one row


def flat_totals(rows: DataFrame, tool: str) -> DataFrame:
    """Counts of tools in the form of a trend, for want of weeks: no slope, one point."""
    return rows.where(truthy(F.col(tool).cast("string"))).groupBy(tool).agg(F.count("*").alias("total")).select(tool, F.lit(0.0).alias("slope"), F.col("total").alias("last_n"), "total", F.lit(1).alias("n_points"), F.lit(False).alias("trending_up"))


def held_out(split: DataFrame, sector: str, tool: str, k: int = 3) -> DataFrame:
    """One row of metrics of the k most frequent tools of each sector, from rows with `part` train or test.

    Sectors that are on both sides count. accuracy is hits over predictions, baseline that of the k tools that are most
    frequent over all; the others are means over sectors. Ties go to the smaller name.
    """
    counts = written(split.where(truthy(F.col(sector).cast("string")) & truthy(F.col(tool).cast("string"))).groupBy("part", sector, tool).agg(F.count("*").alias("n")), "counts")
    train, held = counts.where("part = 'train'").drop("part"), counts.where("part = 'test'").select(sector, tool, F.col("n").alias("gain"))
    both = train.select(sector).distinct().join(held.select(sector).distinct(), sector)
    predicted = A.top_k(train.join(both, sector, "left_semi"), [sector], [F.col("n").desc(), F.col(tool)], k)
    best = train.groupBy(tool).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), tool).limit(k).select(tool)
    by_sector = M.ranking(predicted, held, sector, tool, "gain", k).join(held.join(F.broadcast(best), tool).groupBy(sector).agg(F.count("*").alias("base")), sector, "left")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    sums = by_sector.agg(
        F.count("*").alias("sectors"), F.coalesce(F.sum("hits") / F.sum("n_predicted"), F.lit(0.0)).alias("accuracy"), F.coalesce(F.sum("base") / (k * F.count("*")), F.lit(0.0)).alias("baseline"),
        mean("precision").alias("precision"), mean("recall").alias("recall"), mean("f1").alias("f1"), mean("average_precision").alias("map_score"), mean("ndcg").alias("ndcg"),
    )
    sides = split.agg(F.count_if(F.col("part") == "train").alias("train_rows"), F.count_if(F.col("part") == "test").alias("holdout_rows"))
    return sides.crossJoin(sums)  # one row each


def sector_report(rows: DataFrame, sector: str, tool: str, dated: Column, order: list[str], k: int = 3) -> DataFrame:
    """One row: status, how rows were split, metrics, and whether the gate is passed (accuracy above the baseline).

    Under 5 rows with a tool: insufficient_data. With 10 dated rows or more the last week is held out, the boundary day
    in it; else, and where that leaves one side empty, the last quarter in order.
    """
    full = written(rows.where(truthy(F.col(tool).cast("string"))).withColumn("_day", dated), "rows")
    seen = full.agg(F.count("*").alias("n"), F.count("_day").alias("dated"), F.date_sub(F.max("_day"), 7).alias("start"), F.min("_day").alias("first")).first()
    if seen["n"] < LEAST_ROWS:
        kind = "status string, split string, holdout_start string, train_rows bigint, holdout_rows bigint, sectors bigint, accuracy double, baseline double, precision double, recall double, f1 double, map_score double, ndcg double, passes_gate boolean"
        return rows.sparkSession.createDataFrame([("insufficient_data", *([None] * 13))], kind)
    by_time = seen["dated"] >= LEAST_DATED and seen["first"] < seen["start"]
    split = time_split(full, F.col("_day"), 8) if by_time else fraction_split(full, order).withColumnRenamed("split", "part")
    out = held_out(split.select("part", sector, tool), sector, tool, k)
    start = F.lit(str(seen["start"]) if by_time else None).cast("string")
    return out.select(F.lit("ok").alias("status"), F.lit("time" if by_time else "fraction").alias("split"), start.alias("holdout_start"), *out.columns, (F.col("accuracy") > F.col("baseline")).alias("passes_gate"))


def forecast(scores: DataFrame, report: DataFrame | None, sector: str, tool: str, k: int = 3) -> DataFrame:
    """A row for each sector: status, its k best tools in order, and the report's accuracy and gate; no report: no_model."""
    top = A.top_k(scores, [sector], [F.col("score").desc(), F.col(tool)], k)
    listed = top.groupBy(sector).agg(F.array_sort(F.collect_list(F.struct("rank", tool, "score"))).alias("prediction"))  # k elements at most
    if report is None:
        return listed.select(sector, F.lit("no_model").alias("status"), "prediction")
    told = F.broadcast(report.select("status", "accuracy", "passes_gate", "holdout_start"))  # one row
    return listed.crossJoin(told).select(sector, "status", "prediction", F.col("accuracy").alias("confidence"), "passes_gate", "holdout_start")


def contributions(weights: DataFrame, group: list[str], item: str, weight: str, most: int = 5) -> DataFrame:
    """The `most` heaviest items of each group: rank, item, weight and its share of the group's whole weight (of 1 where that is 0)."""
    whole = weights.groupBy(*group).agg(F.sum(weight).alias("_whole"))
    top = A.top_k(weights, group, [F.col(weight).desc(), F.col(item)], most)
    joined = top.join(whole, group) if group else top.crossJoin(whole)  # one row without groups
    return joined.select(*group, "rank", item, weight, (F.col(weight) / F.when(F.col("_whole") == 0, 1.0).otherwise(F.col("_whole"))).alias("normalised"))


def whole_forecast(rows: DataFrame, report: DataFrame | None, sector: str, tool: str, k: int = 3) -> DataFrame:
    """A row for each sector: status, prediction, contributions, coverage and what the report says of accuracy, baseline and lift.

    status: `no_model` without a report, the report's own if it is not ok, else `sparse` for a sector of under LEAST_ROWS
    rows, else `ok`. coverage is the sector's share of all rows with a tool; contributions are the five heaviest scores.
    """
    full = written(rows.where(truthy(F.col(sector).cast("string")) & truthy(F.col(tool).cast("string"))).select(sector, tool), "forecast-rows")
    scores = written(summed_scores(full, sector, tool), "forecast-scores")
    counts = full.groupBy(sector).agg(F.count("*").alias("evidence"))
    total = counts.agg(F.sum("evidence").alias("all_rows"))
    top = A.top_k(scores, [sector], [F.col("score").desc(), F.col(tool)], k).groupBy(sector).agg(F.array_sort(F.collect_list(F.struct("rank", tool, "score"))).alias("prediction"))  # k elements at most
    parts = contributions(scores, [sector], tool, "score").groupBy(sector).agg(F.array_sort(F.collect_list(F.struct("rank", tool, "normalised"))).alias("contributions"))  # five at most
    base = counts.crossJoin(F.broadcast(total)).join(top, sector).join(parts, sector)  # one row
    said = base.select(sector, "evidence", (F.col("evidence") / F.col("all_rows")).alias("coverage"), "prediction", "contributions")
    if report is None:
        none = [F.lit(None).cast("double").alias(c) for c in ("confidence", "baseline", "lift")]
        return said.select(sector, F.lit("no_model").alias("status"), *said.columns[1:], *none, F.lit(None).cast("boolean").alias("passes_gate"))
    told = F.broadcast(report.select(F.col("status").alias("_status"), F.col("accuracy").alias("confidence"), "baseline", (F.col("accuracy") - F.col("baseline")).alias("lift"), "passes_gate"))  # one row
    status = F.when(F.col("_status") != "ok", F.col("_status")).when(F.col("evidence") < LEAST_ROWS, "sparse").otherwise("ok")
    return said.crossJoin(told).select(sector, status.alias("status"), *said.columns[1:], "confidence", "baseline", "lift", "passes_gate")


def company_forecast(companies: DataFrame, company: str) -> DataFrame:
    """Companies have no forecast of their own: a row for each, `not_supported` and why."""
    reason = "signals of single companies are too sparse; the sector's forecast stands for them"
    return companies.where(truthy(F.col(company).cast("string"))).select(company).distinct().select(company, F.lit("not_supported").alias("status"), F.lit(reason).alias("reason"))


def note_start(note: Column) -> Column:
    """The day after `holdout_start=` in a note; null without one."""
    return F.nullif(F.regexp_extract(note, r"holdout_start=(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def previous_period(weekly: DataFrame, series: str) -> DataFrame:
    """weekly with `previous`: the count of the week before, of the same series; 0 where it had none."""
    before = weekly.select(series, F.date_add("week_start", 7).alias("week_start"), F.col("n").alias("previous"))
    return weekly.join(before, [series, "week_start"], "left").withColumn("previous", F.coalesce("previous", F.lit(0)))


class Task(ABC):
    """A forecast: what it may read, and what it gives back as DataFrames."""

    name: str
    accepted_tiers: list[str]
    metric: str
    horizon: str

    def __init__(self, rows: DataFrame) -> None:
        self.rows = A.tier_filter(rows, self.accepted_tiers) if "tier" in rows.columns else rows

    def save(self, root: str) -> int:
        """Commit what was fitted as a new version below `root`; returns the version."""
        return versions.commit(self.fit(), f"{root}/{self.name}")

    def saved(self, root: str, version: int | None = None) -> DataFrame:
        """What was fitted and saved last, or in an earlier version."""
        return versions.read_version(self.rows.sparkSession, f"{root}/{self.name}", version)

    @abstractmethod
    def fit(self) -> DataFrame: ...

    @abstractmethod
    def predict(self) -> DataFrame: ...

    @abstractmethod
    def explain(self) -> DataFrame: ...

    @abstractmethod
    def evaluate(self) -> DataFrame: ...


class SectorTask(Task):
    """Tools of a sector; rows: industry, tool, created_ts, and ord for their order."""

    name, accepted_tiers, metric, horizon = "t2-industry", ["OBSERVED", "DERIVED", "LLM_EXTRACTED"], "top_k_accuracy", "90d"

    def fit(self) -> DataFrame:
        return summed_scores(self.rows, "industry", "tool")

    def predict(self) -> DataFrame:
        return A.top_k(self.fit(), ["industry"], [F.col("score").desc(), F.col("tool")], 3)

    def explain(self) -> DataFrame:
        return A.top_k(self.fit(), ["industry"], [F.col("score").desc(), F.col("tool")], 5)

    def evaluate(self) -> DataFrame:
        return sector_report(self.rows, "industry", "tool", day(F.col("created_ts")), ["ord"])


class TrendTask(Task):
    """Which tools rise; rows: tool, week_start, n, or tool alone, for totals without a trend."""

    name, accepted_tiers, metric, horizon = "t2", ["OBSERVED", "DERIVED", "LLM_EXTRACTED"], "mae", "4w"

    def fit(self) -> DataFrame:
        return A.slopes(self.rows, "tool") if "week_start" in self.rows.columns else flat_totals(self.rows, "tool")

    def predict(self) -> DataFrame:
        return self.fit().orderBy(F.col("trending_up").desc(), F.col("slope").desc(), F.col("total").desc(), "tool").limit(10)

    def explain(self) -> DataFrame:
        return self.fit().where("trending_up")

    def evaluate(self) -> DataFrame:
        return A.persistence(self.rows, "tool").agg(F.coalesce(F.avg("mae"), F.lit(0.0)).alias("mae"), F.count("*").alias("n_tools"))


class ExploitTask(Task):
    """Whether a vulnerability will be exploited; rows: epss_score, cvss_score, tag_count, exploited, first_seen, ord."""

    name, accepted_tiers, metric, horizon = "t1", ["OBSERVED"], "pr_auc", "30d"
    inputs = ("epss_score", "cvss_score", "tag_count")
    trees, depth = 100, 12

    def __init__(self, rows: DataFrame, model: object | None = None) -> None:
        super().__init__(rows)
        self._fitted = model

    def _train(self, rows: DataFrame) -> object:
        from pyspark.ml.classification import RandomForestClassifier

        return RandomForestClassifier(labelCol="exploited", numTrees=self.trees, maxDepth=self.depth, seed=42).fit(self._vectors(rows))

    @property
    def model(self) -> object:
        """The forest: fitted on the task's rows once, or loaded."""
        if self._fitted is None:
            self._fitted = self._train(self.rows)
        return self._fitted

    def _vectors(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=list(self.inputs), outputCol="features").transform(rows.na.fill(0, list(self.inputs)))

    def _scored(self, model: object, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return model.transform(self._vectors(rows)).withColumn("score", F.coalesce(F.get(vector_to_array("probability"), 1), F.lit(0.0))).drop("features", "rawPrediction", "probability", "prediction")

    def save(self, root: str) -> int:
        """Save the forest as a new version below `root`, which is seen once it is whole; returns the version."""
        return versions.commit_with(self.rows.sparkSession, f"{root}/{self.name}", lambda folder: self.model.write().save(folder))

    @classmethod
    def load(cls, rows: DataFrame, root: str, version: int | None = None) -> ExploitTask:
        """The task over other rows with a saved forest, which is not fitted again."""
        from pyspark.ml.classification import RandomForestClassificationModel

        return cls(rows, RandomForestClassificationModel.load(versions.folder_of(rows.sparkSession, f"{root}/{cls.name}", version)))

    def fit(self) -> DataFrame:
        """What the model says of its own rows."""
        return self._scored(self.model, self.rows)

    def predict(self, rows: DataFrame | None = None) -> DataFrame:
        """Scores of rows, of the task's own by default."""
        return self._scored(self.model, self.rows if rows is None else rows)

    def explain(self) -> DataFrame:
        """Each input's weight in the forest, with its share of all."""
        weights = self.model.featureImportances.toArray().tolist()
        table = self.rows.sparkSession.createDataFrame(list(zip(self.inputs, weights, strict=True)), "feature string, importance double")
        return contributions(table, [], "feature", "importance").select("feature", "importance", "normalised")

    def evaluate(self) -> DataFrame:
        """One row: average precision of the model and of the plain score, lift, calibration error, sizes and the gate.

        The last 30 days are held out, or the last fifth in order if no row is that late; under 10 rows: insufficient_data.
        """
        rows = written(self.rows, "rows")
        n = rows.count()
        if n < 10:
            return rows.sparkSession.createDataFrame([("insufficient_data", n)], "status string, sample_size bigint")
        split = time_split(rows, day(F.col("first_seen")), 30)
        if split.where("part = 'test'").isEmpty() or split.where("part = 'train'").isEmpty():
            split = fraction_split(rows, ["ord"], fraction=0.8).withColumnRenamed("split", "part")
        split = written(split, "split")
        scored = written(self._scored(self._train(split.where("part = 'train'")), split.where("part = 'test'")), "scored")
        own = M.average_precision(scored, "exploited", "score").withColumnRenamed("average_precision", "pr_auc")
        plain = M.average_precision(scored, "exploited", "epss_score").withColumnRenamed("average_precision", "baseline_pr_auc")
        error = M.calibration_bins(scored, "exploited", "score").agg(F.coalesce(F.sum("gap"), F.lit(0.0)).alias("ece"))
        sizes = split.agg(F.count_if(F.col("part") == "train").alias("train_size"), F.count_if(F.col("part") == "test").alias("test_size"))
        out = own.crossJoin(plain).crossJoin(error).crossJoin(sizes)  # one row each
        return out.select(F.lit("ok").alias("status"), "*", (F.col("pr_auc") - F.col("baseline_pr_auc")).alias("lift"), (F.col("pr_auc") > F.col("baseline_pr_auc")).alias("passes_gate"))


class CompanyTask(Task):
    """Companies: no forecast, only whether enough rows name one; rows: company_name."""

    name, accepted_tiers, metric, horizon = "t3", ["OBSERVED", "DERIVED", "LLM_EXTRACTED"], "coverage", "90d"

    def fit(self) -> DataFrame:
        return self.evaluate()

    def predict(self) -> DataFrame:
        return self.evaluate().select(F.lit("not_supported").alias("status"), "coverage")

    def explain(self) -> DataFrame:
        return self.evaluate()

    def evaluate(self) -> DataFrame:
        named = F.count_if(truthy(F.col("company_name")))
        return self.rows.agg(named.alias("n_companies"), F.when(named >= 20, "sufficient").otherwise("sparse").alias("coverage"))


#: Tasks by name.
TASKS: dict[str, Callable[[DataFrame], Task]] = {t.name: t for t in (ExploitTask, TrendTask, SectorTask, CompanyTask)}


def task(name: str, rows: DataFrame) -> Task:
    """The task of a name over its feature rows."""
    if name not in TASKS:
        raise ValueError(f"no task {name!r}; known: {sorted(TASKS)}")
    return TASKS[name](rows)
