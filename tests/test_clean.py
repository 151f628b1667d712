import math

from pyspark.sql import functions as F

from postlab.operators import clean, features


def test_nonfinite_become_null(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "x double")
    out = [r[0] for r in clean.nonfinite_to_null(df).collect()]
    assert out == [1.0, None, None, None, None]


def test_date_parts_parse_and_bad_values(spark):
    df = spark.createDataFrame([(1, "2025-06-05 10:00:00"), (2, "not a date")], "post_id long, timestamp string")
    rows = {r["post_id"]: r for r in clean.add_date_parts(df).collect()}
    assert (rows[1]["year"], rows[1]["month"], rows[1]["day"]) == (2025, "June", "Thursday")
    assert rows[2]["year"] is None and rows[2]["month"] is None
    assert "timestamp" not in clean.add_date_parts(df).columns


def test_silver_fills(spark):
    rows = [(1, None, 0.0, "b", None), (2, 5, 4.0, "a", 10), (3, 7, 5.0, "b", 20), (4, 7, 7.0, "a", None),
            (4, 7, 7.0, "a", None), (5, 9, None, None, 30)]
    df = spark.createDataFrame(rows, "post_id long, likes long, v double, c string, parent_post_id long")
    df = df.withColumn("timestamp", F.lit("2025-01-01"))
    out = {r["post_id"]: r for r in clean.to_silver(df).collect()}
    assert len(out) == 5                        # exact duplicate removed
    assert out[5]["v"] == 4.5                   # median of 0,4,5,7
    assert out[1]["likes"] == 7                 # median of 5,7,7,9 = 7
    assert out[5]["c"] == "a"                   # tie a/b (2 each) -> smallest
    assert out[1]["parent_post_id"] == 0        # parent filled with 0, not a median


def test_engineered_features_zero_denominators(spark):
    df = spark.createDataFrame([(10, 2, 1, 0, 50, 100, 3, 0.4, 0.6, 0.5, 0.5)],
                               "likes long, shares long, comments long, impressions_estimate long, reach_estimate long, "
                               "follower_count long, following_count long, misinformation_probability double, "
                               "credibility_score double, toxicity_score double, subjectivity_score double")
    r = features.add_engineered_features(df).first()
    assert r["like_rate"] is None and r["reach_rate"] is None
    assert r["total_engagement"] == 13 and r["share_comment_ratio"] == 1.0
    assert math.isclose(r["log_followers"], math.log1p(100))
    assert r["log_impressions"] == 0.0
    assert math.isclose(r["risk_minus_credibility"], -0.2)


def test_silver_is_scanned_by_column_and_described_without_rows(spark):
    from postlab.operators import clean, profiling
    rows = spark.range(300).selectExpr("id AS post_id", "id % 7 AS likes", "IF(id % 5 = 0, NULL, id / 3) AS score", "timestamp'2025-01-02' AS timestamp")
    silver = clean.to_silver(rows, cache=True)
    plan = silver.select("likes")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "score" not in plan
    got = {r["column_name"]: r for r in profiling.describe(silver, ["post_id", "likes"]).collect()}
    assert (got["post_id"]["count"], got["post_id"]["p50"], got["likes"]["max"]) == (300, 149.5, 6.0)
    assert profiling.describe(silver.limit(0), ["likes"]).count() == 0
