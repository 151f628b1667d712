import datetime as dt
import math

from pyspark.sql import functions as F

from postlab.operators import forecast


def _line_week(spark):
    start = dt.date(2025, 1, 1)
    rows = [("m", start + dt.timedelta(days=i), 2.0 + 0.5 * i + 3.0 * math.sin(2 * math.pi * (start + dt.timedelta(days=i)).weekday() / 7))
            for i in range(60)]
    return spark.createDataFrame(rows, "metric string, analysis_date date, value double")


def test_seasonal_forecast_recovers_line_and_week(spark):
    fc = forecast.seasonal_forecast(_line_week(spark), periods=30).toPandas()
    assert len(fc) == 90 and fc["is_future"].sum() == 30
    hist = fc[~fc["is_future"]]
    assert (hist["yhat_upper"] - hist["yhat_lower"]).max() < 1.0


def test_linear_trend_exact_on_a_line(spark):
    start = dt.date(2025, 1, 1)
    df = spark.createDataFrame([("m", start + dt.timedelta(days=i), 1.0 + 2.0 * i) for i in range(10)],
                               "metric string, analysis_date date, value double")
    fc = forecast.linear_trend_forecast(df, periods=5)
    last = fc.where(F.col("analysis_date") == dt.date(2025, 1, 15)).first()
    assert last["yhat"] == 29.0 and last["yhat_lower"] == 29.0
    d = forecast.directions(df, fc).first()
    assert d["direction_vs_recent"] == "increase" and d["direction_in_horizon"] == "upward"
