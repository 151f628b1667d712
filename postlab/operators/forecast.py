"""Forecasting (FOR-01..07, WIN-03/04).

All series are forecast at once: the daily table is unpivoted to (metric, analysis_date, value) and
each series is one group. A daily series is small (one row per day), so a grouped pandas function
fits it; the grouping scales to many series (metric x platform x topic, ...) across executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlab.schema import DAILY_METRICS

FORECAST_SCHEMA = "metric string, analysis_date date, yhat double, yhat_lower double, yhat_upper double, is_future boolean"


def long_series(daily: DataFrame, metrics: list[str] = DAILY_METRICS, series_cols: list[str] | None = None) -> DataFrame:
    """Unpivot the daily table and drop null points (FOR-04)."""
    ids = ["analysis_date"] + (series_cols or [])
    long = daily.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ids, metrics, "metric", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def time_index(long: DataFrame, group: str = "metric") -> DataFrame:
    """WIN-04: 0..n-1 per series in date order."""
    w = Window.partitionBy(group).orderBy("analysis_date")
    return long.withColumn("time_index", (F.row_number().over(w) - 1).cast("int"))


def _design(t: np.ndarray, dow: np.ndarray, cps: np.ndarray, order: int = 3) -> np.ndarray:
    cols = [np.ones_like(t), t]
    cols += [np.maximum(t - c, 0.0) for c in cps]
    for k in range(1, order + 1):
        cols += [np.sin(2 * np.pi * k * dow / 7.0), np.cos(2 * np.pi * k * dow / 7.0)]
    return np.column_stack(cols)


def _fit_one(pdf: pd.DataFrame, periods: int, n_changepoints: int, ridge: float, z: float) -> pd.DataFrame:
    pdf = pdf.sort_values("analysis_date")
    dates = pd.to_datetime(pdf["analysis_date"]).to_numpy()
    y = pdf["value"].to_numpy(dtype=np.float64)
    start = dates[0]
    span = max((dates[-1] - start) / np.timedelta64(1, "D"), 1.0)
    future = pd.date_range(pd.Timestamp(dates[-1]) + pd.Timedelta(days=1), periods=periods, freq="D").to_numpy()
    all_dates = np.concatenate([dates, future])
    t_all = ((all_dates - start) / np.timedelta64(1, "D")) / span
    dow_all = pd.DatetimeIndex(all_dates).dayofweek.to_numpy().astype(np.float64)
    n = len(y)
    k = min(n_changepoints, max(0, int(0.8 * n) - 1))
    cps = np.quantile(t_all[:n][: max(int(0.8 * n), 1)], np.linspace(0, 1, k + 2)[1:-1]) if k > 0 else np.array([])
    x_all = _design(t_all, dow_all, cps)
    x = x_all[:n]
    pen = np.zeros(x.shape[1])
    pen[2:2 + len(cps)] = ridge
    pen[2 + len(cps):] = ridge * 1e-3
    beta = np.linalg.solve(x.T @ x + np.diag(pen) + 1e-9 * np.eye(x.shape[1]), x.T @ y)
    fit = x_all @ beta
    sigma = float(np.std(y - fit[:n])) if n else 0.0
    return pd.DataFrame({
        "metric": pdf["metric"].iloc[0],
        "analysis_date": pd.DatetimeIndex(all_dates).date,
        "yhat": fit, "yhat_lower": fit - z * sigma, "yhat_upper": fit + z * sigma,
        "is_future": np.arange(len(all_dates)) >= n,
    })


def seasonal_forecast(long: DataFrame, periods: int = 30, n_changepoints: int = 25, ridge: float = 1.0,
                      z: float = 1.96, group: str = "metric") -> DataFrame:
    """FOR-01 (re-aimed): trend with changepoint hinges + weekly Fourier terms, ridge least squares per
    series, interval = yhat +- z * population std of the residuals. History plus ``periods`` days."""
    def fn(pdf):
        return _fit_one(pdf.rename(columns={group: "metric"}), periods, n_changepoints, ridge, z)
    return long.select(F.col(group).alias("metric"), "analysis_date", "value").groupBy("metric").applyInPandas(
        fn, FORECAST_SCHEMA)


def linear_trend_forecast(long: DataFrame, periods: int = 30, z: float = 1.96) -> DataFrame:
    """Trend-only forecast with JVM aggregates (regr_slope / regr_intercept on days since the first
    date), interval from the population std of residuals; history plus ``periods`` future days."""
    t = F.datediff("analysis_date", F.col("__d0")).cast("double")
    first = long.groupBy("metric").agg(F.min("analysis_date").alias("__d0"), F.max("analysis_date").alias("__d1"))
    fitted = long.join(first, "metric").withColumn("__t", t)
    coef = fitted.groupBy("metric", "__d0", "__d1").agg(
        F.regr_slope("value", "__t").alias("__b"), F.regr_intercept("value", "__t").alias("__a"))
    coef = coef.withColumns({"__b": F.coalesce("__b", F.lit(0.0)),
                             "__a": F.coalesce("__a", F.lit(None).cast("double"))})
    resid = (fitted.join(coef.select("metric", "__a", "__b"), "metric")
             .groupBy("metric").agg(F.stddev_pop(F.col("value") - (F.col("__a") + F.col("__b") * F.col("__t")))
                                    .alias("__s"),
                                    F.avg(F.col("value")).alias("__mean")))
    coef = coef.join(resid, "metric").withColumn("__a", F.coalesce("__a", F.col("__mean")))
    hist = long.select("metric", "analysis_date", F.lit(False).alias("is_future"))
    fut = coef.select("metric", F.explode(F.sequence(F.date_add("__d1", 1), F.date_add("__d1", periods)))
                      .alias("analysis_date"), F.lit(True).alias("is_future"))
    allp = hist.unionByName(fut).join(coef, "metric")
    yhat = F.col("__a") + F.col("__b") * F.datediff("analysis_date", "__d0").cast("double")
    return allp.select("metric", "analysis_date", yhat.alias("yhat"),
                       (yhat - z * F.col("__s")).alias("yhat_lower"),
                       (yhat + z * F.col("__s")).alias("yhat_upper"), "is_future")


def forest_forecast(long: DataFrame, periods: int = 30, num_trees: int = 180, seed: int = 42,
                    z: float = 1.96) -> DataFrame:
    """FOR-02: random-forest fallback on the time index; flat after the last index; future dates
    continue from the last observed date (defect D11 fixed). One Spark ML fit per metric."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    indexed = time_index(long)
    metrics = [r[0] for r in indexed.select("metric").distinct().collect()]  # series names only
    parts = []
    for m in metrics:
        s = indexed.where(F.col("metric") == m)
        va = VectorAssembler(inputCols=["time_index"], outputCol="features")
        train = va.transform(s.withColumn("time_index", F.col("time_index").cast("double")))
        model = RandomForestRegressor(numTrees=num_trees, seed=seed, labelCol="value").fit(train)
        last = s.agg(F.max("time_index").alias("n"), F.max("analysis_date").alias("d")).first()
        fut = s.sparkSession.range(1, periods + 1).select(
            F.lit(m).alias("metric"), F.date_add(F.lit(last["d"]), F.col("id").cast("int")).alias("analysis_date"),
            (F.lit(last["n"]) + F.col("id")).cast("double").alias("time_index"), F.lit(None).cast("double").alias("value"))
        allp = train.select("metric", "analysis_date", "time_index", "value").unionByName(fut)
        pred = model.transform(va.transform(allp))
        sigma = pred.where(F.col("value").isNotNull()).agg(F.stddev_pop(F.col("value") - F.col("prediction"))).first()[0]
        parts.append(pred.select("metric", "analysis_date", F.col("prediction").alias("yhat"),
                                 (F.col("prediction") - z * (sigma or 0.0)).alias("yhat_lower"),
                                 (F.col("prediction") + z * (sigma or 0.0)).alias("yhat_upper"),
                                 F.col("value").isNull().alias("is_future")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Fewest points of a series for the seasonal fit; shorter ones get the forest.
MIN_SEASONAL_POINTS = 10


def method_choice(long: DataFrame) -> DataFrame:
    """FOR-01/02: (metric, points, method), one row per series."""
    return long.groupBy("metric").agg(F.count("value").alias("points")).withColumn(
        "method", F.when(F.col("points") >= MIN_SEASONAL_POINTS, "seasonal").otherwise("forest"))


def forecast_series(long: DataFrame, periods: int = 30) -> DataFrame:
    """Every series by its method."""
    methods = {r["metric"]: r["method"] for r in method_choice(long).collect()}  # one row per series
    parts = []
    for method, fit in (("seasonal", seasonal_forecast), ("forest", forest_forecast)):
        mine = [m for m, x in methods.items() if x == method]
        if mine:
            parts.append(fit(long.where(F.col("metric").isin(mine)), periods).select(
                "metric", F.col("analysis_date").cast("date").alias("analysis_date"), "yhat", "yhat_lower", "yhat_upper", "is_future"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def directions(long: DataFrame, forecast: DataFrame, periods: int = 30, recent: int = 7) -> DataFrame:
    """FOR-05/06/07 per metric, one column per definition (they can disagree):

    - ``direction_vs_recent``: mean of the next ``periods`` yhat vs mean of the last ``recent`` actuals
    - ``direction_in_horizon``: last vs first of the ``periods`` forecast rows (``stable`` if absent)
    - ``direction_whole_series``: last vs first yhat of the whole fitted + forecast series
    """
    w_recent = Window.partitionBy("metric").orderBy(F.desc("analysis_date"))
    rec = (long.withColumn("__r", F.row_number().over(w_recent)).where(F.col("__r") <= recent)
           .groupBy("metric").agg(F.avg("value").alias("recent_mean")))
    fut = forecast.where(F.col("is_future")).groupBy("metric").agg(
        F.avg("yhat").alias("forecast_mean"), F.min_by("yhat", "analysis_date").alias("__f0"),
        F.max_by("yhat", "analysis_date").alias("__f1"))
    whole = forecast.groupBy("metric").agg(F.min_by("yhat", "analysis_date").alias("__w0"),
                                           F.max_by("yhat", "analysis_date").alias("__w1"))
    out = whole.join(rec, "metric", "left").join(fut, "metric", "left")
    return out.select(
        "metric", "recent_mean", "forecast_mean",
        F.when(F.col("forecast_mean") > F.col("recent_mean"), "increase").otherwise("decline").alias("direction_vs_recent"),
        F.when(F.col("__f0").isNull(), "stable").when(F.col("__f1") > F.col("__f0"), "upward")
        .otherwise("downward").alias("direction_in_horizon"),
        F.when(F.col("__w1") > F.col("__w0"), "upward").otherwise("downward").alias("direction_whole_series"))
