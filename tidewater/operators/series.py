"""Forecasts of many series, each in a group of its own: ARIMA by least squares, rolling evaluation, density thresholds."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_sums


def daily(df: DataFrame, series: str, day: Column) -> DataFrame:
    """series, day and n: counts of every day from a series' first to its last, 0 where it has none."""
    counts = df.where(F.col(series).isNotNull()).select(series, day.alias("day")).where("day is not null").groupBy(series, "day").agg(F.count("*").alias("n"))
    span = counts.groupBy(series).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.join(counts, [series, "day"], "left").select(series, "day", F.coalesce("n", F.lit(0)).alias("n"))


def _lagged(w: np.ndarray, lags: int, first: int) -> np.ndarray:
    return np.stack([w[first - k : len(w) - k] for k in range(1, lags + 1)], axis=1) if lags else np.zeros((len(w) - first, 0))


def fit_arima(y: np.ndarray, p: int, d: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Constant, AR and MA terms of the d times differenced series, its values and residuals; None if it is too short.

    Least squares in two steps: a long autoregression gives residuals, which stand for the shocks when the series is put
    on its own lags and on those.
    """
    w = np.diff(np.asarray(y, float), n=d)
    long = max(p, q) + 2 if q else 0
    first = max(p, long + q)
    if len(w) - first < p + q + 2:
        return None
    shocks = np.zeros(len(w))
    if q:
        design = np.column_stack([np.ones(len(w) - long), _lagged(w, long, long)])
        shocks[long:] = w[long:] - design @ np.linalg.lstsq(design, w[long:], rcond=None)[0]
    design = np.column_stack([np.ones(len(w) - first), _lagged(w, p, first), _lagged(shocks, q, first)])
    beta = np.linalg.lstsq(design, w[first:], rcond=None)[0]
    own = np.zeros(len(w))
    own[first:] = w[first:] - design @ beta
    return beta, w, own


def forecast_arima(y: np.ndarray, p: int, d: int, q: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts of the next steps and their standard errors; a series that is too short goes on as it ended."""
    y = np.asarray(y, float)
    fitted = fit_arima(y, p, d, q)
    if fitted is None:
        return np.full(steps, y[-1] if len(y) else np.nan), np.full(steps, np.nan)
    beta, w, e = fitted
    const, ar, ma = beta[0], beta[1 : p + 1], beta[p + 1 :]
    wide, shocks = list(w), list(e)
    for _ in range(steps):
        wide.append(const + sum(a * wide[-1 - k] for k, a in enumerate(ar)) + sum(m * shocks[-1 - k] for k, m in enumerate(ma)))
        shocks.append(0.0)
    out = np.array(wide[len(w) :])
    # Weights of past shocks in each step: those of the ARMA part, summed once for each difference.
    psi = np.zeros(steps)
    psi[0] = 1
    for j in range(1, steps):
        psi[j] = sum(a * psi[j - 1 - k] for k, a in enumerate(ar) if j - 1 - k >= 0) + (ma[j - 1] if j <= q else 0)
    for level in range(d - 1, -1, -1):
        out = np.diff(y, n=level)[-1] + np.cumsum(out)
        psi = np.cumsum(psi)
    first = max(p, max(p, q) + 2 + q if q else 0)
    sigma = (e[first:] ** 2).sum() / max(1, len(w) - first - len(beta))
    return out, np.sqrt(sigma * np.cumsum(psi**2))


def arima(counts: DataFrame, series: str, order: Column | str, value: str, p: int = 1, d: int = 1, q: int = 1, steps: int = 7) -> DataFrame:
    """series, step, forecast, lower and upper (95 %), n_points of each series; bands are null for series that are too short.

    A group is one series' points, as many as it has days or weeks. Points without a value count as 0.
    """
    kind = counts.schema[series].dataType.simpleString()
    rows = counts.select(F.col(series).alias("series"), (F.col(order) if isinstance(order, str) else order).alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("at")["y"].to_numpy()
        out, error = forecast_arima(y, p, d, q, steps)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "step": np.arange(1, steps + 1), "forecast": out, "lower": out - 1.96 * error, "upper": out + 1.96 * error, "n_points": len(y)})

    return rows.groupBy("series").applyInPandas(run, f"series {kind}, step int, forecast double, lower double, upper double, n_points bigint").withColumnRenamed("series", series)


def arima_backtest(counts: DataFrame, series: str, order: str, value: str, p: int = 1, d: int = 1, q: int = 1, held: int = 5) -> DataFrame:
    """series, n_points, mae and persistence_mae: errors of one-step forecasts of the last `held` points, each from all before it."""
    kind = counts.schema[series].dataType.simpleString()
    rows = counts.select(F.col(series).alias("series"), F.col(order).alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("at")["y"].to_numpy()
        at = range(max(1, len(y) - held), len(y))
        own = [abs(forecast_arima(y[:k], p, d, q, 1)[0][0] - y[k]) for k in at]
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "n_points": [len(y)], "mae": [float(np.mean(own)) if own else 0.0], "persistence_mae": [float(np.mean([abs(y[k - 1] - y[k]) for k in at])) if own else 0.0]})

    return rows.groupBy("series").applyInPandas(run, f"series {kind}, n_points bigint, mae double, persistence_mae double").withColumnRenamed("series", series)


def _exact_bounds(df: DataFrame, series: str, value: str, share: float) -> DataFrame:
    """What density_bounds gives, by ranks: equal values are counted first, counts are summed over ranges of series and values."""
    least = Fraction(str(share))
    place = lambda q: F.greatest(F.lit(1), F.expr(f"(_all * {q.numerator} + {q.denominator - 1}) div {q.denominator}"))
    counts = df.select(F.col(series).alias("_of"), F.col(value).alias("_value")).where("_value is not null").groupBy("_of", "_value").agg(F.count("*").alias("_n"))
    run = running_sums(counts, [F.col("_of"), F.col("_value")], {"_upto": "_n"})
    spans = run.groupBy("_of").agg(F.min(F.col("_upto") - F.col("_n")).alias("_before"), F.sum("_n").alias("_all"))
    spans = spans.select(F.col("_of").alias(series), "_before", F.col("_all").alias("n"), (F.col("_before") + place(least)).alias("_low"), (F.col("_before") + place(1 - least)).alias("_high"))
    at = lambda c: F.max(F.when((F.col(c) <= F.col("_upto")) & (F.col(c) > F.col("_upto") - F.col("_n")), F.col("_value")))
    return run.join(spans, F.col("_of").eqNullSafe(spans[series])).groupBy(series, "n").agg(at("_low").alias("low"), at("_high").alias("high"))


def density_bounds(df: DataFrame, series: str, value: str, share: float = 0.01, accuracy: int | None = None) -> DataFrame:
    """series, n, low and high: the values that `share` of a series' values at most lie below, and above.

    Exact: the values of ranks ceil(share * n) and ceil((1 - share) * n), 1 at least, NaN as the largest. With `accuracy`
    they come from a mergeable sketch that is built in each task instead, and are off by n / accuracy ranks at most. Null
    values do not count.
    """
    if accuracy is None:
        return _exact_bounds(df, series, value, share)
    at = F.percentile_approx(value, [share, 1 - share], accuracy)
    return df.where(F.col(value).isNotNull()).groupBy(series).agg(F.count("*").alias("n"), at.alias("q")).select(series, "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def density_outliers(df: DataFrame, series: str, value: str, share: float = 0.01, accuracy: int | None = None) -> DataFrame:
    """df with low, high and outlier: whether a row's value lies outside its series' bounds (null without a value)."""
    bounds = density_bounds(df, series, value, share, accuracy).drop("n").withColumnRenamed(series, "_series")
    joined = df.join(bounds, df[series].eqNullSafe(bounds["_series"]), "left").drop("_series")
    return joined.withColumn("outlier", (F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def rolling_origin(df: DataFrame, key: str, day: Column, first: str, last: str, train: int = 60, test: int = 30, every: int = 30, k: int = 3) -> DataFrame:
    """A row for each origin: n_train, n_test, n_keys, mae, persistence_mae and hits of the k most frequent keys.

    All origins from first to last are one dimension of one plan: each day's counts go to the origins whose train or test
    days hold it, so that a key has a row an origin. The forecast of a key is its rate in the train days; persistence is its
    count in the last `test` days of them. Origins without train or test rows have no row.
    """
    counts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.datediff(day, F.lit(first)).alias("x")).where("x is not null").groupBy("key", "x").agg(F.count("*").alias("n"))
    low = F.greatest(F.lit(0), F.floor((F.col("x") - test) / every) + 1)  # the first origin o * every with x < origin + test
    high = F.least(F.floor(F.datediff(F.lit(last), F.lit(first)) / every), F.floor((F.col("x") + train) / every))
    dealt = counts.where(low <= high).withColumn("origin", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    at = F.col("x") - F.col("origin") * every
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sides = dealt.groupBy("origin", "key").agg(total(at < 0).alias("train"), total(at >= 0).alias("test"), total((at < 0) & (at >= -test)).alias("recent"))
    guess = F.col("train") * test / train
    best = lambda c: F.row_number().over(Window.partitionBy("origin").orderBy(F.col(c).desc(), "key"))
    ranked = sides.withColumns({"by_train": best("train"), "by_test": best("test")})
    hit = (F.col("by_train") <= k) & (F.col("by_test") <= k) & (F.col("train") > 0) & (F.col("test") > 0)
    out = ranked.groupBy("origin").agg(
        F.sum("train").alias("n_train"), F.sum("test").alias("n_test"), F.count("*").alias("n_keys"), F.avg(F.abs(guess - F.col("test"))).alias("mae"), F.avg(F.abs(F.col("recent") - F.col("test"))).alias("persistence_mae"), F.count_if(hit).alias("hits"),
    )
    return out.where("n_train > 0 and n_test > 0").select(F.date_add(F.lit(first).cast("date"), (F.col("origin") * every).cast("int")).alias("origin"), "n_train", "n_test", "n_keys", "mae", "persistence_mae", "hits")
