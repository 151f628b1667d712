"""Exploratory aggregates (AGG-01..05, AGG-09..16) and top-k helpers (TOP-01..05).

All are single-pass aggregates: partial HashAggregate -> Exchange -> final HashAggregate, with the
scan pruned to the columns used. Many-column operators unpivot first so one shuffle serves all
columns instead of one job per column.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlab.functions.exprs import finite, safe_corr
from postlab.operators.stats import exact_quantiles

ENGAGEMENT_COLUMNS = ["likes", "shares", "comments", "engagement_velocity", "impressions_estimate", "reach_estimate"]
RISK_COLUMNS = ["misinformation_probability", "credibility_score", "uncertainty_index", "subjectivity_score",
                "toxicity_score", "sentiment_score"]
ACCOUNT_COLUMNS = ["follower_count", "following_count", "account_age_days", "cascade_depth"]
CORR_COLUMNS = ENGAGEMENT_COLUMNS + RISK_COLUMNS + ACCOUNT_COLUMNS
VALUE_COUNT_COLUMNS = ["platform", "crisis_phase", "topic", "sentiment_label", "emotion", "stance_label",
                       "claim_type", "source_type", "region", "language"]
CATEGORY_PLOT_COLUMNS = ["platform", "crisis_phase", "topic", "claim_type", "sentiment_label", "emotion",
                         "stance_label"]
SCATTER_VIEWS = [
    ("misinformation_vs_credibility", "misinformation_probability", "credibility_score", "sentiment_label"),
    ("toxicity_vs_misinformation", "toxicity_score", "misinformation_probability", "stance_label"),
    ("misinformation_vs_engagement", "misinformation_probability", "engagement_velocity", "platform"),
]


def platform_engagement(df: DataFrame) -> DataFrame:
    """AGG-01."""
    return (df.groupBy("platform")
            .agg(F.count("post_id").alias("posts"),
                 F.avg("engagement_velocity").alias("avg_engagement_velocity"),
                 F.avg("misinformation_probability").alias("avg_misinformation"),
                 F.avg("credibility_score").alias("avg_credibility"))
            .orderBy(F.desc("avg_engagement_velocity"), "platform"))


def topic_risk(df: DataFrame, top: int | None = 15, order: str = "avg_misinformation") -> DataFrame:
    """AGG-02: topic risk table sorted by ``order`` desc (head 15 in the report, top 10 per chart)."""
    out = (df.groupBy("topic")
           .agg(F.count("post_id").alias("posts"),
                F.avg("misinformation_probability").alias("avg_misinformation"),
                F.avg("credibility_score").alias("avg_credibility"),
                F.avg("toxicity_score").alias("avg_toxicity"))
           .orderBy(F.desc(order), "topic"))
    return out.limit(top) if top else out


def share_summary(df: DataFrame) -> DataFrame:
    """AGG-05: original vs shared posts; label 0/1 -> text, any other value -> the value as text."""
    agg = (df.groupBy("is_share")
           .agg(F.count("post_id").alias("posts"),
                F.avg("engagement_velocity").alias("avg_engagement"),
                F.avg("misinformation_probability").alias("avg_misinformation"),
                F.avg("credibility_score").alias("avg_credibility"),
                F.avg("toxicity_score").alias("avg_toxicity")))
    label = (F.when(F.col("is_share") == 0, "Original posts").when(F.col("is_share") == 1, "Shared posts")
             .otherwise(F.col("is_share").cast("string")))
    return agg.withColumn("post_type", label).orderBy("is_share")


def feature_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-09: one-row table of column means."""
    return df.agg(*[F.avg(finite(F.col(c).cast("double"))).alias(c) for c in columns])


def feature_quantile_row(df: DataFrame, columns: list[str], p: float = 0.95) -> dict:
    """AGG-10 (driver scalars): exact p-quantile of each column."""
    q = exact_quantiles(df, columns, [p])
    return {c: q[(c, p)] for c in columns}


def feature_quantiles(df: DataFrame, columns: list[str], p: float = 0.95) -> DataFrame:
    """AGG-10 as a one-row table."""
    vals = feature_quantile_row(df, columns, p)
    return df.sparkSession.createDataFrame([tuple(None if vals[c] is None else float(vals[c])
                                                  for c in columns)],
                                           ", ".join(f"{c} double" for c in columns))


def _unpivot(df: DataFrame, columns: list[str], value_type: str = "string") -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(value_type).alias("value")) for c in columns])
    return df.select(F.explode(arr).alias("p")).select("p.column", "p.value")


def value_counts(df: DataFrame, columns: list[str], k: int = 10, dropna: bool = False) -> DataFrame:
    """PRF-05 / AGG-12: top-k values per column by count (ties: smaller value first; null kept unless dropna).

    One unpivot and one shuffle for all columns; the ``rank <= k`` filter gives a per-task top-k.
    """
    long = _unpivot(df, columns)
    if dropna:
        long = long.where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_first("value"))
    return (counts.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= k).orderBy("column", "rank"))


def correlation_matrix(df: DataFrame, columns: list[str] = CORR_COLUMNS, at_once: int = 40) -> DataFrame:
    """AGG-11: pairwise-complete Pearson matrix in long form (x, y, r); a constant column gives null.

    Plain aggregates over the pruned columns, ``at_once`` pairs per scan; no row is multiplied."""
    pairs = list(combinations(columns, 2))
    vals = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    out = [(c, c, 1.0) for c in columns]
    for i in range(0, len(pairs), at_once):
        row = vals.agg(*[safe_corr(a, b).alias(f"{a}__{b}") for a, b in pairs[i:i + at_once]]).first()
        for a, b in pairs[i:i + at_once]:
            out += [(a, b, row[f"{a}__{b}"]), (b, a, row[f"{a}__{b}"])]
    return df.sparkSession.createDataFrame(out, "x string, y string, r double")  # k x k values: bounded by the column list


def histogram(df: DataFrame, columns: list[str], bins: int = 20, log1p: bool = False) -> DataFrame:
    """AGG-13 / AGG-14: equal-width histogram per column (column, bucket, lo, hi, n), last bin closed.

    min/max come from a per-column aggregate (one row per column, broadcast), so the whole
    histogram is two map-side combined aggregates.
    """
    long = _unpivot(df, columns, "double")
    v = finite(F.log1p("value") if log1p else F.col("value"))
    long = long.select("column", v.alias("v")).where(F.col("v").isNotNull())
    rng = long.groupBy("column").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    width = (F.col("mx") - F.col("mn")) / bins
    bucket = F.when(F.col("mx") == F.col("mn"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("v") - F.col("mn")) / (F.col("mx") - F.col("mn")) * bins) + 1, F.lit(bins)))
    out = (long.join(F.broadcast(rng), "column")
           .withColumn("bucket", bucket.cast("int"))
           .groupBy("column", "bucket", "mn", "mx")
           .agg(F.count(F.lit(1)).alias("n")))
    return (out.select("column", "bucket",
                       (F.col("mn") + (F.col("bucket") - 1) * width).alias("lo"),
                       (F.col("mn") + F.col("bucket") * width).alias("hi"), "n")
            .orderBy("column", "bucket"))


def scatter_bins(df: DataFrame, views=SCATTER_VIEWS, bins: int = 20) -> DataFrame:
    """AGG-15: 2-D binned counts per scatter view and hue (never the raw points)."""
    points = F.array(*[F.struct(F.lit(view).alias("view"), finite(F.col(x).cast("double")).alias("x"),
                                finite(F.col(y).cast("double")).alias("y"), F.col(hue).cast("string").alias("hue"))
                       for view, x, y, hue in views])
    long = df.select(F.explode(points).alias("p")).select("p.*")  # one scan for all views
    long = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    rng = long.groupBy("view").agg(F.min("x").alias("xmn"), F.max("x").alias("xmx"),
                                   F.min("y").alias("ymn"), F.max("y").alias("ymx"))

    def b(v, mn, mx):
        return F.when(F.col(mx) == F.col(mn), F.lit(1)).otherwise(
            F.least(F.floor((F.col(v) - F.col(mn)) / (F.col(mx) - F.col(mn)) * bins) + 1, F.lit(bins))).cast("int")

    return (long.join(F.broadcast(rng), "view")
            .groupBy("view", b("x", "xmn", "xmx").alias("xbin"), b("y", "ymn", "ymx").alias("ybin"), "hue")
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy("view", "xbin", "ybin", F.asc_nulls_first("hue")))


def top_k(df: DataFrame, order_cols: list, k: int) -> DataFrame:
    """TOP-01/03: ordered top-k (TakeOrderedAndProject: a per-task heap, no full sort)."""
    return df.orderBy(*order_cols).limit(k)


def top_k_per_group(df: DataFrame, group: str, order_cols: list, k: int, rank_col: str = "rank") -> DataFrame:
    """TOP-03 per group: ``row_number() <= k`` (Spark inserts a per-task window group limit)."""
    w = Window.partitionBy(group).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w).cast("bigint")).where(F.col(rank_col) <= k)


def best_by_ranking(df: DataFrame) -> DataFrame:
    """TOP-04: mark the best clustering row: silhouette desc, Davies-Bouldin asc, Calinski-Harabasz desc,
    nulls last; no row is best when no silhouette exists."""
    w = Window.orderBy(F.desc_nulls_last("silhouette_score"), F.asc_nulls_last("davies_bouldin_index"),
                       F.desc_nulls_last("calinski_harabasz_score"), F.asc("model_name"))
    ranked = df.withColumn("__r", F.row_number().over(w))
    any_sil = F.max(F.col("silhouette_score").isNotNull().cast("int")).over(Window.partitionBy())
    return (ranked.withColumn("is_best", (F.col("__r") == 1) & (any_sil == 1) & F.col("silhouette_score").isNotNull())
            .drop("__r"))


def arg_max(df: DataFrame, value_col: str, by_col: str) -> DataFrame:
    """TOP-05: the ``value_col`` at the maximum of ``by_col``."""
    return df.agg(F.max_by(value_col, by_col).alias(value_col))
