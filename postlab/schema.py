"""Fixed schema and fixed values of the post data model.

The column layout, targets, feature lists and report phrases below are fixed values that must equal
the behaviour being reproduced; they are stated here once, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Bronze layout (31 columns), in file order.
# ---------------------------------------------------------------------------------------------
RAW_SCHEMA = T.StructType([
    T.StructField("post_id", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("follower_count", T.LongType()),
    T.StructField("following_count", T.LongType()),
    T.StructField("account_age_days", T.LongType()),
    T.StructField("verified_flag", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("crisis_phase", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("emotion", T.StringType()),
    T.StructField("stance_label", T.StringType()),
    T.StructField("claim_type", T.StringType()),
    T.StructField("likes", T.LongType()),
    T.StructField("shares", T.LongType()),
    T.StructField("comments", T.LongType()),
    T.StructField("impressions_estimate", T.LongType()),
    T.StructField("reach_estimate", T.LongType()),
    T.StructField("engagement_velocity", T.DoubleType()),
    T.StructField("misinformation_probability", T.DoubleType()),
    T.StructField("credibility_score", T.DoubleType()),
    T.StructField("uncertainty_index", T.DoubleType()),
    T.StructField("subjectivity_score", T.DoubleType()),
    T.StructField("toxicity_score", T.DoubleType()),
    T.StructField("region", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("is_share", T.StringType()),
    T.StructField("parent_post_id", T.LongType()),
    T.StructField("cascade_depth", T.IntegerType()),
])
RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]
FLAG_COLUMNS = ["verified_flag", "is_share"]
ID_COLUMNS = ["post_id", "parent_post_id"]

# The two regression targets and their display labels.
TARGETS = ["misinformation_probability", "credibility_score"]
TARGET_LABELS = {
    "misinformation_probability": "Misinformation Probability",
    "credibility_score": "Credibility Score",
}

# The ten behaviour features shared by segmentation and anomaly detection.
CLUSTER_FEATURES = [
    "follower_count",
    "following_count",
    "account_age_days",
    "likes",
    "shares",
    "comments",
    "engagement_velocity",
    "credibility_score",
    "toxicity_score",
    "misinformation_probability",
]

# The metrics of the daily series, in forecasting order.
DAILY_METRICS = ["engagement_velocity", "misinformation_probability", "credibility_score", "post_volume"]

# Sampling limits and restart counts of the segmentation stage.
KMEANS_N_INIT_ROWS = 10_000
KMEANS_N_INIT_LARGE = 10
KMEANS_N_INIT_SMALL = 20

# Calendar names in calendar order (English, as written by month/weekday names).
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"]
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Star schema. Single-column dimensions (column, surrogate key), in build order.
SIMPLE_DIMENSIONS = [
    ("platform", "platform_id"),
    ("crisis_phase", "crisis_phase_id"),
    ("topic", "topic_id"),
    ("sentiment_label", "sentiment_id"),
    ("emotion", "emotion_id"),
    ("region", "region_id"),
    ("language", "language_id"),
]
USER_COLUMNS = ["follower_count", "following_count", "account_age_days", "verified_flag", "source_type"]
TIME_COLUMNS = ["year", "month", "day"]

# The 27 fact columns in order.
FACT_COLUMNS = [
    "post_id", "user_id", "platform_id", "crisis_phase_id", "topic_id", "sentiment_id", "emotion_id",
    "region_id", "language_id", "time_id", "stance_label", "claim_type", "likes", "shares", "comments",
    "impressions_estimate", "reach_estimate", "engagement_velocity", "misinformation_probability",
    "credibility_score", "uncertainty_index", "subjectivity_score", "toxicity_score", "sentiment_score",
    "is_share", "parent_post_id", "cascade_depth",
]

# Anomaly reason phrases, checked in this order against the 95th percentile.
ANOMALY_REASON_CHECKS = [
    ("engagement_velocity", "abnormal engagement spike"),
    ("misinformation_probability", "high misinformation probability"),
    ("toxicity_score", "high toxicity"),
    ("follower_count", "unusually large audience"),
]
ANOMALY_REASON_FALLBACK = "unusual multivariate behavior across account and post metrics"
NORMAL_REASON = "normal behavior"

# Segment narrative phrases (above / not above the global mean).
CLUSTER_TRAITS = [
    ("engagement_velocity", "high engagement", "lower engagement"),
    ("misinformation_probability", "elevated misinformation risk", "lower misinformation risk"),
    ("credibility_score", "above-average credibility", "weaker credibility"),
    ("toxicity_score", "higher toxicity", None),
]
CLUSTER_NARRATIVE_PREFIX = "Cluster contains accounts/posts with "

# Recommendation templates per target ({pos} / {neg} = strongest drivers).
RECOMMENDATION_TEMPLATES = {
    "misinformation_probability": (
        "Escalate review queues when {pos} rises, and use patterns like {neg} as lower-risk benchmarks."
    ),
    "credibility_score": (
        "Amplify credible content patterns connected to {pos}, and audit content conditions where "
        "{neg} suppresses credibility."
    ),
}

# Hyper-parameter space of the boosted-tree search (random draws from this grid).
GBT_DEFAULTS = {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.9,
                "colsample_bytree": 0.9}
GBT_SEARCH_SPACE = {
    "n_estimators": [120, 180, 240],
    "max_depth": [4, 5, 6],
    "learning_rate": [0.03, 0.05, 0.07],
    "subsample": [0.85, 0.9, 1.0],
    "colsample_bytree": [0.85, 0.9, 1.0],
    "reg_lambda": [0.5, 1.0],
    "reg_alpha": [0.0, 0.1],
}

# Names under which a ground-truth anomaly column may appear.
TRUTH_COLUMN_CANDIDATES = ["is_anomaly", "anomaly_ground_truth", "ground_truth_anomaly", "anomaly_true",
                           "ground_truth_label"]
