"""Engineered features FEA-01..12: one projection, every expression JVM-side (whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab.functions.exprs import finite, safe_div

ENGINEERED = ["total_engagement", "share_comment_ratio", "like_rate", "share_rate", "comment_rate", "reach_rate",
              "audience_size", "follower_following_ratio", "log_followers", "log_impressions",
              "risk_minus_credibility", "toxicity_subjectivity_interaction"]
LEAKY = ["risk_minus_credibility"]


def feature_exprs() -> dict[str, F.Column]:
    c = F.col
    return {
        "total_engagement": F.coalesce(c("likes"), F.lit(0)) + F.coalesce(c("shares"), F.lit(0))
        + F.coalesce(c("comments"), F.lit(0)),
        "share_comment_ratio": safe_div("shares", c("comments") + 1),
        "like_rate": safe_div("likes", "impressions_estimate"),
        "share_rate": safe_div("shares", "impressions_estimate"),
        "comment_rate": safe_div("comments", "impressions_estimate"),
        "reach_rate": safe_div("reach_estimate", "impressions_estimate"),
        "audience_size": c("follower_count") + c("following_count"),
        "follower_following_ratio": safe_div("follower_count", c("following_count") + 1),
        "log_followers": finite(F.log1p(c("follower_count").cast("double"))),
        "log_impressions": finite(F.log1p(c("impressions_estimate").cast("double"))),
        "risk_minus_credibility": finite(c("misinformation_probability") - c("credibility_score")),
        "toxicity_subjectivity_interaction": finite(c("toxicity_score") * c("subjectivity_score")),
    }


def add_engineered_features(df: DataFrame) -> DataFrame:
    """CLN-09 + FEA-01..12: non-finite -> null, then the 12 derived columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    df = df.withColumns({n: finite(n) for n in floats}) if floats else df
    return df.withColumns(feature_exprs())


def feature_table(df: DataFrame) -> DataFrame:
    """The 12 features per post, in report form."""
    out = add_engineered_features(df)
    return out.select("post_id", *ENGINEERED)
