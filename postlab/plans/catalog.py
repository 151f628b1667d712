"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` per inventory id, and the
DuckDB SQL oracle for the ids whose result is SQL-expressible.

Keys are ``<id>_<short name>``. Every query reads the driver tables (through the posts view and the
silver layer built from them), so its work grows with the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab.operators import calendar as cal
from postlab.functions.exprs import month_number, numeric_columns, text_columns
from postlab.operators import clean, eda, features, profiling, segment, star
from postlab.plans.sqltext import (SILVER_DOUBLE, SILVER_INTEGRAL, SILVER_TEXT, with_posts, with_silver,
                                   BRONZE_CTE)
from postlab.schema import (CLUSTER_FEATURES, FACT_COLUMNS, MONTH_NAMES, RAW_COLUMNS, SIMPLE_DIMENSIONS, TIME_COLUMNS,
                            USER_COLUMNS)
from postlab.session import ensure_checkpoint_dir, written
from postlab.sources.posts import bronze_posts, load_posts_csv, posts_view, read_tagged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SILVER_CACHE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver plan for a table folder (fill values are computed once per session and folder)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SILVER_CACHE:
        _SILVER_CACHE[key] = clean.to_silver(posts_view(spark, sf_dir), cache=True)
    return _SILVER_CACHE[key]


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_engineered_features(silver(spark, sf_dir))


def q(sql: str) -> str:
    return with_silver(sql)


MONTH_CASE = ("CASE month " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(
    ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
     "November", "December"], start=1)) + " ELSE 1 END")

# ---------------------------------------------------------------- sources / cleaning
register("src_04_posts_load", with_posts("SELECT * FROM posts"))(lambda s, d: posts_view(s, d))

register("cln_01_dedup", "WITH " + BRONZE_CTE + "\nSELECT DISTINCT * FROM bronze")(
    lambda s, d: clean.drop_exact_duplicates(bronze_posts(s, d)))

register("cln_02_date_parts", with_posts(
    'SELECT post_id, CAST(year("timestamp") AS INTEGER) AS year, monthname("timestamp") AS month, '
    'dayname("timestamp") AS day, "timestamp" AS event_ts FROM posts'))(
    lambda s, d: clean.add_date_parts(posts_view(s, d)).select("post_id", "year", "month", "day", "event_ts"))

register("cln_03_parent_fill", with_posts(
    "SELECT post_id, coalesce(parent_post_id, 0) AS parent_post_id FROM posts"))(
    lambda s, d: clean.fill_parent(posts_view(s, d)).select("post_id", "parent_post_id"))


def _fill_table_sql(kind: str) -> str:
    if kind == "median":
        parts = [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
                 f"(quantile_cont(CAST({c} AS DOUBLE), 0.5)) AS fill_value FROM dated"
                 for c in SILVER_INTEGRAL + SILVER_DOUBLE]
    else:
        parts = [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
                 f"(SELECT {c} FROM dated WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
                 f" AS fill_value FROM dated" for c in SILVER_TEXT]
    return q("SELECT column_name, CAST(nulls AS BIGINT) AS nulls, fill_value FROM (\n"
             + "\nUNION ALL\n".join(parts) + "\n) WHERE nulls > 0")


def _fill_table(spark, sf_dir, kind):
    p = clean.fill_parent(clean.add_date_parts(clean.drop_exact_duplicates(posts_view(spark, sf_dir))))
    # the columns in question as a table, so that the passes over them do not repeat the shuffles of the posts
    p = written(p.select(*(numeric_columns(p) if kind == "median" else text_columns(p))))
    if kind == "median":
        vals = clean.numeric_fill_values(p)
        rows = [(c, float(v) if v is not None else None) for c, v in vals.items()]
        schema = "column_name string, fill_value double"
    else:
        vals = clean.text_fill_values(p)
        rows = list(vals.items())
        schema = "column_name string, fill_value string"
    fills = spark.createDataFrame(rows, schema)  # one row per filled column: bounded
    nulls = profiling.null_count_table(p, [c for c, _ in rows])
    return nulls.join(fills, "column_name").select("column_name", "nulls", "fill_value")


register("cln_04_median_fill", _fill_table_sql("median"))(lambda s, d: _fill_table(s, d, "median"))
register("cln_05_mode_fill", _fill_table_sql("mode"))(lambda s, d: _fill_table(s, d, "mode"))
register("cln_silver_layer", q("SELECT * FROM silver"))(lambda s, d: silver(s, d))

register("cln_08_category_codes", q(
    "SELECT post_id, topic, CAST(dense_rank() OVER (ORDER BY topic) - 1 AS BIGINT) AS topic_code FROM silver"))(
    lambda s, d: clean.categorical_codes(silver(s, d).select("post_id", "topic"), "topic", "topic_code"))

# every 11th value is NaN, every 13th +inf, every 17th -inf before the filter
register("cln_09_nonfinite", q(
    "SELECT post_id, CASE WHEN post_id % 11 = 0 OR post_id % 13 = 0 OR post_id % 17 = 0 THEN NULL ELSE sentiment_score END "
    "AS planted FROM silver"))(
    lambda s, d: clean.nonfinite_to_null(silver(s, d).select(
        "post_id", F.when(F.col("post_id") % 11 == 0, F.lit(float("nan"))).when(F.col("post_id") % 13 == 0, F.lit(float("inf")))
        .when(F.col("post_id") % 17 == 0, F.lit(float("-inf"))).otherwise(F.col("sentiment_score")).alias("planted"))))


def _through_csv(spark, sf_dir):
    """The posts written as CSV text, with unreadable flags planted, and read by the typed loader."""
    path = f"{ensure_checkpoint_dir(spark)}/posts-csv-{uuid.uuid4().hex}"
    text = posts_view(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in RAW_COLUMNS])
    text = text.withColumn("verified_flag", F.when(F.col("post_id").cast("long") % 7 == 0, "yes").otherwise(F.col("verified_flag")))
    text.write.option("header", True).csv(path)
    return load_posts_csv(spark, path)


register("src_01_csv_load", with_posts("SELECT post_id, follower_count, CASE WHEN post_id % 7 = 0 THEN NULL ELSE verified_flag END AS verified_flag, "
                                       "platform, sentiment_score, likes, credibility_score, is_share, parent_post_id FROM posts"))(
    lambda s, d: _through_csv(s, d).select("post_id", "follower_count", "verified_flag", "platform", "sentiment_score", "likes",
                                           "credibility_score", "is_share", "parent_post_id"))


def _tagged(spark, sf_dir):
    """Posts written in one file per share flag and read back by glob, tagged from the path."""
    base = f"{ensure_checkpoint_dir(spark)}/posts-tagged-{uuid.uuid4().hex}"
    for flag in (0, 1):
        posts_view(spark, sf_dir).where(F.col("is_share") == flag).select("post_id", "is_share").write.parquet(f"{base}/share_{flag}")
    return read_tagged(spark, f"{base}/share_*", tag="tag", pattern=r"share_(\d)/", of="file_path").select("post_id", "is_share", "tag")


register("src_05_tagged_read", with_posts("SELECT post_id, is_share, CAST(is_share AS VARCHAR) AS tag FROM posts"))(_tagged)

# unknown month names and years outside the table
register("cal_01_month_fallback", with_posts(
    "SELECT post_id, CASE WHEN post_id % 3 = 0 THEN 1 WHEN post_id % 3 = 1 THEN 1 ELSE 1 + CAST(post_id % 12 AS INTEGER) END AS month_number FROM posts"))(
    lambda s, d: posts_view(s, d).select("post_id", month_number(
        F.when(F.col("post_id") % 3 == 0, F.lit("Smarch")).when(F.col("post_id") % 3 == 1, F.lit(None).cast("string"))
        .otherwise(F.element_at(F.lit(MONTH_NAMES), (F.col("post_id") % 12 + 1).cast("int")))).cast("int").alias("month_number")))

register("top_03_posts_per_topic", q(
    "SELECT topic, post_id, rank FROM (SELECT topic, post_id, row_number() OVER (PARTITION BY topic ORDER BY reach_estimate DESC, post_id) AS rank "
    "FROM silver) WHERE rank <= 3"))(
    lambda s, d: eda.top_k_per_group(silver(s, d), "topic", [F.desc("reach_estimate"), F.asc("post_id")], 3).select("topic", "post_id", "rank"))

_BEST_FROM = ("(SELECT topic AS model_name, avg(credibility_score) AS silhouette_score, avg(toxicity_score) AS davies_bouldin_index, "
              "avg(reach_estimate) AS calinski_harabasz_score FROM silver GROUP BY topic)")
register("top_04_best_model", q(
    f"SELECT model_name, row_number() OVER (ORDER BY silhouette_score DESC, davies_bouldin_index, calinski_harabasz_score DESC, model_name) = 1 AS is_best FROM {_BEST_FROM}"))(
    lambda s, d: eda.best_by_ranking(silver(s, d).groupBy(F.col("topic").alias("model_name")).agg(
        F.avg("credibility_score").alias("silhouette_score"), F.avg("toxicity_score").alias("davies_bouldin_index"),
        F.avg("reach_estimate").alias("calinski_harabasz_score"))).select("model_name", "is_best"))

register("top_05_best_k", q(
    "SELECT k AS best_k FROM (SELECT cascade_depth + 2 AS k, round(avg(uncertainty_index), 9) AS s FROM silver GROUP BY ALL) ORDER BY s DESC, k LIMIT 1"))(
    lambda s, d: s.createDataFrame([(segment.best_k(silver(s, d).groupBy((F.col("cascade_depth") + 2).alias("k")).agg(
        F.round(F.avg("uncertainty_index"), 9).alias("silhouette_score"))),)], "best_k int"))

register("cln_10_valid_target_rows", with_posts(
    "SELECT post_id, misinformation_probability FROM posts WHERE misinformation_probability IS NOT NULL "
    "AND NOT isnan(misinformation_probability)"))(
    lambda s, d: clean.valid_target_rows(posts_view(s, d), "misinformation_probability")
    .select("post_id", "misinformation_probability"))

register("cln_11_drop_id_and_target", q(
    "SELECT * EXCLUDE (post_id, parent_post_id, credibility_score, event_ts) FROM silver"))(
    lambda s, d: clean.drop_id_and_target(silver(s, d), "credibility_score").drop("event_ts"))

register("cln_12_behaviour_columns", with_posts("SELECT " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in CLUSTER_FEATURES) + " FROM posts"))(
    lambda s, d: clean.coerce_behaviour_columns(posts_view(s, d), CLUSTER_FEATURES + ["not_a_column"]))

# ---------------------------------------------------------------- features
FEATURE_SQL = """
SELECT post_id,
  coalesce(likes, 0) + coalesce(shares, 0) + coalesce(comments, 0) AS total_engagement,
  (shares / nullif(comments + 1, 0)) AS share_comment_ratio,
  (likes / nullif(impressions_estimate, 0)) AS like_rate,
  (shares / nullif(impressions_estimate, 0)) AS share_rate,
  (comments / nullif(impressions_estimate, 0)) AS comment_rate,
  (reach_estimate / nullif(impressions_estimate, 0)) AS reach_rate,
  follower_count + following_count AS audience_size,
  (follower_count / nullif(following_count + 1, 0)) AS follower_following_ratio,
  (CASE WHEN follower_count > -1 THEN ln(1 + follower_count) END) AS log_followers,
  (CASE WHEN impressions_estimate > -1 THEN ln(1 + impressions_estimate) END) AS log_impressions,
  (misinformation_probability - credibility_score) AS risk_minus_credibility,
  (toxicity_score * subjectivity_score) AS toxicity_subjectivity_interaction
FROM silver"""
register("fea_01_12_engineered_features", q(FEATURE_SQL))(
    lambda s, d: features.feature_table(silver(s, d)))

# ---------------------------------------------------------------- calendar
register("cal_01_month_number", q(
    f"SELECT post_id, CAST(year AS INTEGER) AS year_num, CAST({MONTH_CASE} AS INTEGER) AS month_num FROM silver"))(
    lambda s, d: cal.with_month_year(silver(s, d), 2025).select(
        "post_id", F.col("__y").cast("int").alias("year_num"), F.col("__m").cast("int").alias("month_num")))

CAL02_SQL = f"""
SELECT post_id, make_date(year, {MONTH_CASE},
  least(row_number() OVER (PARTITION BY year, {MONTH_CASE} ORDER BY post_id), 28)) AS analysis_date
FROM silver"""
register("cal_02_analysis_date", q(CAL02_SQL))(
    lambda s, d: cal.with_analysis_date(silver(s, d), default_year=2025).select("post_id", "analysis_date"))

register("agg_03_monthly", q(f"""
SELECT c.month, c.month_ord, CAST(coalesce(a.posts, 0) AS BIGINT) AS posts, a.avg_misinformation, a.avg_engagement
FROM (SELECT * FROM (VALUES {", ".join(f"('{m}', {i})" for i, m in enumerate(
    ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
     "November", "December"], start=1))}) t(month, month_ord)) c
LEFT JOIN (SELECT month, count(post_id) AS posts, avg(misinformation_probability) AS avg_misinformation,
           avg(engagement_velocity) AS avg_engagement FROM silver GROUP BY month) a ON a.month = c.month"""))(
    lambda s, d: cal.calendar_summary(silver(s, d), "month"))

register("agg_04_weekday", q(f"""
SELECT c.day, c.day_ord, CAST(coalesce(a.posts, 0) AS BIGINT) AS posts, a.avg_misinformation, a.avg_engagement
FROM (SELECT * FROM (VALUES {", ".join(f"('{m}', {i})" for i, m in enumerate(
    ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"], start=1))}) t(day, day_ord)) c
LEFT JOIN (SELECT day, count(post_id) AS posts, avg(misinformation_probability) AS avg_misinformation,
           avg(engagement_velocity) AS avg_engagement FROM silver GROUP BY day) a ON a.day = c.day"""))(
    lambda s, d: cal.calendar_summary(silver(s, d), "day"))

DAILY_SQL = """
SELECT analysis_date, avg(engagement_velocity) AS engagement_velocity,
       avg(misinformation_probability) AS misinformation_probability,
       avg(credibility_score) AS credibility_score, count(post_id) AS post_volume
FROM ({inner}) WHERE analysis_date IS NOT NULL GROUP BY analysis_date"""
register("agg_06_daily_metrics", q(DAILY_SQL.format(inner=f"""
SELECT *, make_date(year, {MONTH_CASE},
  least(row_number() OVER (PARTITION BY year, {MONTH_CASE} ORDER BY post_id), 28)) AS analysis_date FROM silver""")))(
    lambda s, d: cal.synthetic_daily_metrics(silver(s, d), default_year=2025))
register("agg_07_real_daily_metrics", q(DAILY_SQL.format(
    inner="SELECT *, CAST(event_ts AS DATE) AS analysis_date FROM silver")))(
    lambda s, d: cal.real_daily_metrics(silver(s, d)))

# ---------------------------------------------------------------- EDA aggregates
register("agg_01_platform_engagement", q("""
SELECT platform, count(post_id) AS posts, avg(engagement_velocity) AS avg_engagement_velocity,
       avg(misinformation_probability) AS avg_misinformation, avg(credibility_score) AS avg_credibility
FROM silver GROUP BY platform"""))(lambda s, d: eda.platform_engagement(silver(s, d)))

TOPIC_SQL = """
SELECT topic, count(post_id) AS posts, avg(misinformation_probability) AS avg_misinformation,
       avg(credibility_score) AS avg_credibility, avg(toxicity_score) AS avg_toxicity
FROM silver GROUP BY topic ORDER BY {order} DESC, topic LIMIT {k}"""
register("agg_02_topic_risk", q(TOPIC_SQL.format(order="avg_misinformation", k=15)))(
    lambda s, d: eda.topic_risk(silver(s, d), 15))
register("agg_02_topic_top_risk", q(TOPIC_SQL.format(order="avg_misinformation", k=10)))(
    lambda s, d: eda.topic_risk(silver(s, d), 10, "avg_misinformation"))
register("agg_02_topic_top_credibility", q(TOPIC_SQL.format(order="avg_credibility", k=10)))(
    lambda s, d: eda.topic_risk(silver(s, d), 10, "avg_credibility"))

register("agg_05_share_summary", q("""
SELECT is_share, count(post_id) AS posts, avg(engagement_velocity) AS avg_engagement,
       avg(misinformation_probability) AS avg_misinformation, avg(credibility_score) AS avg_credibility,
       avg(toxicity_score) AS avg_toxicity,
       CASE WHEN is_share = 0 THEN 'Original posts' WHEN is_share = 1 THEN 'Shared posts'
            ELSE CAST(is_share AS VARCHAR) END AS post_type
FROM silver GROUP BY is_share"""))(lambda s, d: eda.share_summary(silver(s, d)))

register("agg_09_feature_means", q("SELECT " + ", ".join(
    f"(avg(CAST({c} AS DOUBLE))) AS {c}" for c in CLUSTER_FEATURES) + " FROM silver"))(
    lambda s, d: eda.feature_means(silver(s, d), CLUSTER_FEATURES))

register("agg_10_p95_thresholds", q("SELECT " + ", ".join(
    f"(quantile_cont(CAST({c} AS DOUBLE), 0.95)) AS {c}" for c in CLUSTER_FEATURES) + " FROM silver"))(
    lambda s, d: eda.feature_quantiles(silver(s, d), CLUSTER_FEATURES, 0.95))


def _corr_sql(cols):
    from itertools import combinations
    pairs = list(combinations(cols, 2))
    sel = ", ".join(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c{i}" for i, (a, b) in enumerate(pairs))
    rows = [f"SELECT '{c}' AS x, '{c}' AS y, 1.0::DOUBLE AS r" for c in cols]
    for i, (a, b) in enumerate(pairs):
        rows.append(f"SELECT '{a}', '{b}', c{i} FROM cm")
        rows.append(f"SELECT '{b}', '{a}', c{i} FROM cm")
    # a query that adds its own CTE continues the WITH list of the silver CTEs
    return q(f", cm AS (SELECT {sel} FROM silver)\nSELECT x, y, r AS r FROM (\n"
             + "\nUNION ALL\n".join(rows) + ")")


register("agg_11_correlation_matrix", _corr_sql(eda.CORR_COLUMNS))(
    lambda s, d: eda.correlation_matrix(silver(s, d)))


def _value_counts_sql(cols, k, dropna):
    parts = [f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM silver" for c in cols]
    where = "WHERE value IS NOT NULL" if dropna else ""
    return q(f"""SELECT column_name AS "column", value, count, rank FROM (
  SELECT column_name, value, count, CAST(row_number() OVER (PARTITION BY column_name
         ORDER BY count DESC, value ASC NULLS FIRST) AS BIGINT) AS rank
  FROM (SELECT column_name, value, count(*) AS count FROM ({" UNION ALL ".join(parts)}) {where}
        GROUP BY column_name, value)) WHERE rank <= {k}""")


register("prf_05_value_counts", _value_counts_sql(eda.VALUE_COUNT_COLUMNS, 10, False))(
    lambda s, d: eda.value_counts(silver(s, d), eda.VALUE_COUNT_COLUMNS, 10, False))
register("agg_12_category_counts", _value_counts_sql(eda.CATEGORY_PLOT_COLUMNS, 12, True))(
    lambda s, d: eda.value_counts(silver(s, d), eda.CATEGORY_PLOT_COLUMNS, 12, True))


def _hist_sql(cols, bins, log1p):
    def v(c):
        return (f"CASE WHEN CAST({c} AS DOUBLE) > -1 THEN ln(1 + CAST({c} AS DOUBLE)) END" if log1p
                else f"CAST({c} AS DOUBLE)")
    parts = [f"SELECT '{c}' AS column_name, {v(c)} AS v FROM silver" for c in cols]
    return q(f"""SELECT column_name AS "column", bucket, (mn + (bucket - 1) * (mx - mn) / {bins}) AS lo,
       (mn + bucket * (mx - mn) / {bins}) AS hi, count(*) AS n
FROM (SELECT l.column_name, l.v, r.mn, r.mx,
        CAST(CASE WHEN r.mx = r.mn THEN 1 ELSE least(floor((l.v - r.mn) / (r.mx - r.mn) * {bins}) + 1, {bins}) END
             AS INTEGER) AS bucket
      FROM (SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE v IS NOT NULL) l
      JOIN (SELECT column_name, min(v) AS mn, max(v) AS mx FROM ({" UNION ALL ".join(parts)}) GROUP BY column_name) r
        ON l.column_name = r.column_name)
GROUP BY column_name, bucket, mn, mx""")


register("agg_13_log_engagement_hist", _hist_sql(eda.ENGAGEMENT_COLUMNS, 20, True))(
    lambda s, d: eda.histogram(silver(s, d), eda.ENGAGEMENT_COLUMNS, 20, True))
register("agg_14_risk_hist", _hist_sql(eda.RISK_COLUMNS, 20, False))(
    lambda s, d: eda.histogram(silver(s, d), eda.RISK_COLUMNS, 20, False))


def _scatter_sql(bins=20, views=None, source="silver"):
    parts = [f"SELECT '{v}' AS view, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, CAST({h} AS VARCHAR) AS hue "
             f"FROM {source}" for v, x, y, h in (views or eda.SCATTER_VIEWS)]
    u = " UNION ALL ".join(parts)

    def b(v, mn, mx):
        return (f"CAST(CASE WHEN r.{mx} = r.{mn} THEN 1 ELSE least(floor((l.{v} - r.{mn}) / (r.{mx} - r.{mn}) * {bins})"
                f" + 1, {bins}) END AS INTEGER)")
    return q(f"""SELECT view, xbin, ybin, hue, count(*) AS n FROM (
  SELECT l.view, l.hue, {b('x', 'xmn', 'xmx')} AS xbin, {b('y', 'ymn', 'ymx')} AS ybin
  FROM (SELECT * FROM ({u}) WHERE x IS NOT NULL AND y IS NOT NULL) l
  JOIN (SELECT view, min(x) AS xmn, max(x) AS xmx, min(y) AS ymn, max(y) AS ymx FROM ({u})
        WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY view) r ON l.view = r.view)
GROUP BY view, xbin, ybin, hue""")


register("agg_15_scatter_bins", _scatter_sql())(lambda s, d: eda.scatter_bins(silver(s, d)))

# ---------------------------------------------------------------- profiling
register("prf_01_preview", q("SELECT * FROM silver ORDER BY post_id LIMIT 20"))(
    lambda s, d: profiling.preview(silver(s, d), 20))
register("prf_02_describe", q(profiling.describe_sql(SILVER_INTEGRAL + SILVER_DOUBLE)))(
    lambda s, d: profiling.describe(silver(s, d)))
register("prf_03_schema_profile", q(profiling.schema_profile_sql()))(
    lambda s, d: profiling.schema_profile(silver(s, d)))

# ---------------------------------------------------------------- star schema
DIM_SPECS = [("dim_08_users", "dim_users", USER_COLUMNS, "user_id")] + [
    (f"dim_{i:02d}_{c}", f"dim_{c}", [c], k) for i, (c, k) in enumerate(SIMPLE_DIMENSIONS, start=1)] + [
    ("dim_09_time", "dim_time", TIME_COLUMNS, "time_id")]


def dim_sql_cte(name, cols, key):
    c = ", ".join(cols)
    return (f"{name} AS (SELECT {c}, CAST(row_number() OVER (ORDER BY first_seen) AS BIGINT) AS {key} "
            f"FROM (SELECT {c}, min(post_id) AS first_seen FROM silver GROUP BY {c}))")


for qname, tname, cols, key in DIM_SPECS:
    register(qname, q(f", {dim_sql_cte(tname, cols, key)}\nSELECT * FROM {tname}"))(
        (lambda cols_, key_: lambda s, d: star.make_dimension(silver(s, d), cols_, key_))(cols, key))


def fact_sql() -> str:
    ctes = ",\n".join(dim_sql_cte(t, cols, key) for _q, t, cols, key in DIM_SPECS)
    joins = []
    for _q, t, cols, key in DIM_SPECS:
        cond = " AND ".join(f"s.{c} IS NOT DISTINCT FROM {t}.{c}" for c in cols)
        joins.append(f"LEFT JOIN {t} ON {cond}")
    sel = ", ".join(f"{c}" if c.endswith("_id") and c not in ("post_id", "parent_post_id") else f"s.{c}"
                    for c in FACT_COLUMNS)
    return q(f",\n{ctes},\nfact AS (SELECT {sel} FROM silver s\n" + "\n".join(joins) + ")\n")


register("fct_03_fact_posts", fact_sql() + "SELECT * FROM fact")(
    lambda s, d: star.build_fact(silver(s, d), star.build_dimensions(silver(s, d))))
register("fct_04_star_checks", fact_sql() + """SELECT count(*) AS fact_rows,
  CAST(count(*) FILTER (WHERE user_id IS NULL OR platform_id IS NULL OR crisis_phase_id IS NULL OR topic_id IS NULL
    OR sentiment_id IS NULL OR emotion_id IS NULL OR region_id IS NULL OR language_id IS NULL OR time_id IS NULL)
    AS BIGINT) AS rows_with_null_key,
  count(DISTINCT post_id) AS distinct_post_ids, (SELECT count(*) FROM silver) AS silver_rows FROM fact""")(
    lambda s, d: star.star_checks(silver(s, d), star.build_fact(silver(s, d), star.build_dimensions(silver(s, d)))))

from postlab.plans import catalog_ml  # noqa: E402,F401  (registers the ML-stage queries)
