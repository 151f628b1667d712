"""Calendar operators (CAL-01..03) and the daily series (AGG-06, AGG-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlab.functions.exprs import bounded_broadcast, month_number
from postlab.schema import MONTH_NAMES, WEEKDAY_NAMES

# bound for the broadcast of the "first 27 posts of each month" table
SEQ_DAY_BROADCAST_ROWS = 5_000_000


def calendar_frame(spark: SparkSession, kind: str) -> DataFrame:
    """CAL-03: the ordered calendar categories (12 months or 7 weekdays); a fixed-size table."""
    names = MONTH_NAMES if kind == "month" else WEEKDAY_NAMES
    return spark.createDataFrame([(n, i) for i, n in enumerate(names, start=1)], f"{kind} string, {kind}_ord int")


def with_month_year(df: DataFrame, default_year: int | None = None) -> DataFrame:
    """CAL-01: month name -> number (unknown -> 1); unparsable year -> ``default_year``
    (the current year when not given, as the wall clock is not reproducible)."""
    year = F.expr("try_cast(year as int)")
    fallback = F.lit(default_year) if default_year is not None else F.year(F.current_date())
    return df.withColumns({"__y": F.coalesce(year, fallback), "__m": month_number("month")})


def with_analysis_date(df: DataFrame, order_by: str = "post_id", default_year: int | None = None,
                       cap: int = 28) -> DataFrame:
    """CAL-02: synthetic day = running number of the post inside its (year, month), capped at ``cap``.

    Ranking whole months would put a month into one task. Only the first ``cap - 1`` posts of each
    month get a day below ``cap``: the ``row_number() <= cap - 1`` filter lets Spark keep a
    per-task top-k before the shuffle (window group limit), so at most (cap-1) rows per month and
    task move. Every other post gets day ``cap`` through a left join on ``order_by``.
    """
    base = with_month_year(df, default_year)
    w = Window.partitionBy("__y", "__m").orderBy(order_by)
    early = (base.select("__y", "__m", order_by)
             .withColumn("__rn", F.row_number().over(w))
             .where(F.col("__rn") <= cap - 1)
             .select(order_by, "__rn"))
    early = bounded_broadcast(early, SEQ_DAY_BROADCAST_ROWS)
    out = base.join(early, order_by, "left")
    day = F.coalesce(F.col("__rn"), F.lit(cap))
    return out.withColumn("analysis_date", F.make_date("__y", "__m", day)).drop("__y", "__m", "__rn")


def daily_metrics(df: DataFrame, date_col: str = "analysis_date") -> DataFrame:
    """AGG-06: per-day means of three measures and the post volume; null dates are dropped."""
    return (df.where(F.col(date_col).isNotNull())
            .groupBy(F.col(date_col).alias("analysis_date"))
            .agg(F.avg("engagement_velocity").alias("engagement_velocity"),
                 F.avg("misinformation_probability").alias("misinformation_probability"),
                 F.avg("credibility_score").alias("credibility_score"),
                 F.count("post_id").alias("post_volume"))
            .orderBy("analysis_date"))


def synthetic_daily_metrics(silver: DataFrame, default_year: int | None = None) -> DataFrame:
    return daily_metrics(with_analysis_date(silver, default_year=default_year))


def real_daily_metrics(silver: DataFrame, ts_col: str = "event_ts") -> DataFrame:
    """AGG-07: the same daily series on the real post date."""
    return daily_metrics(silver.withColumn("analysis_date", F.to_date(ts_col)))


def calendar_summary(df: DataFrame, kind: str) -> DataFrame:
    """AGG-03 / AGG-04: posts and two means per month or weekday; empty categories kept (0 posts)."""
    agg = df.groupBy(kind).agg(F.count("post_id").alias("posts"),
                               F.avg("misinformation_probability").alias("avg_misinformation"),
                               F.avg("engagement_velocity").alias("avg_engagement"))
    cal = calendar_frame(df.sparkSession, kind)
    return (F.broadcast(cal).join(agg, kind, "left")
            .select(kind, f"{kind}_ord", F.coalesce("posts", F.lit(0)).cast("bigint").alias("posts"),
                    "avg_misinformation", "avg_engagement")
            .orderBy(f"{kind}_ord"))
