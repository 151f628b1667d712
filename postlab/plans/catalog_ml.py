"""Registered ML-stage queries.

``SQL+L`` oracles fix the stochastic part with the deterministic stand-ins of FIXTURES.md (cluster
label ``post_id % 3``, prediction ``0.9 * y + 0.01``, anomaly label ``-1`` when ``post_id % 10 = 0``,
anomaly score ``((post_id * 613) % 1000) / 1000 - 0.2``, truth flag ``post_id % 7 = 0``), so the
operator's formulas are checked exactly; fitted models get rows-only checks.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from postlab.operators import anomaly, contributions, density, eda, features, forecast, prep, segment, supervised
from postlab.operators import calendar as cal
from postlab.plans.catalog import MONTH_CASE, featured, q, register, silver
from postlab.plans.sqltext import cluster_metrics_cte, scaled_cte, with_posts
from postlab.sources.posts import posts_view
from postlab.session import cut_lineage, written
from postlab.schema import (ANOMALY_REASON_CHECKS, ANOMALY_REASON_FALLBACK, CLUSTER_FEATURES, NORMAL_REASON,
                            RECOMMENDATION_TEMPLATES)

Z = [f"z_{c}" for c in CLUSTER_FEATURES]
SCALED = scaled_cte(CLUSTER_FEATURES)
_SCALED_CACHE: dict = {}


def scaled(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCALED_CACHE:
        _SCALED_CACHE[key] = prep.scaled_matrix(silver(spark, sf_dir), CLUSTER_FEATURES)
    return _SCALED_CACHE[key]


def cached_scaled(spark, sf_dir, columns=None):
    """The scaled matrix, or some columns of it, as a written table, for operators that scan it many times."""
    return written(scaled(spark, sf_dir).select(*(columns or ["*"])))


def label3():
    return F.pmod(F.col("post_id"), F.lit(3)).cast("bigint")


def stand_score():
    return (F.pmod(F.col("post_id") * 613, F.lit(1000)).cast("double") / 1000 - 0.2)


def stand_label():
    return F.when(F.pmod(F.col("post_id"), F.lit(10)) == 0, F.lit(-1)).otherwise(F.lit(1))


def stand_truth():
    return F.when(F.pmod(F.col("post_id"), F.lit(7)) == 0, F.lit(1)).otherwise(F.lit(0))


SQL_SCORE = "(CAST((post_id * 613) % 1000 AS DOUBLE) / 1000 - 0.2)"
SQL_LABEL = "CASE WHEN post_id % 10 = 0 THEN -1 ELSE 1 END"
SQL_TRUTH = "CASE WHEN post_id % 7 = 0 THEN 1 ELSE 0 END"

# ---------------------------------------------------------------- preparation
register("mlp_05_scaled_matrix", q(SCALED + "\nSELECT post_id, " + ", ".join(
    [f"{c} AS {c}" for c in CLUSTER_FEATURES] + [f"z_{c} AS z_{c}" for c in CLUSTER_FEATURES])
    + " FROM scaled"))(
    lambda s, d: scaled(s, d).select("post_id", *CLUSTER_FEATURES, *Z))


def _split_frame(s, d, target="credibility_score"):
    return prep.feature_target_split(featured(s, d), target)[0]


def _split_sql(target="credibility_score"):
    from postlab.plans.catalog import FEATURE_SQL
    from postlab.plans.sqltext import SILVER_DOUBLE, SILVER_INTEGRAL, SILVER_TEXT
    keep_int = [c for c in SILVER_INTEGRAL if c not in ("post_id", "parent_post_id")]
    keep_dbl = [c for c in SILVER_DOUBLE if c != target]
    feats = [c for c in features.ENGINEERED if c not in features.LEAKY]
    cols = ([f"s.{c}" for c in keep_int] + [f"s.{c} AS {c}" for c in keep_dbl] + [f"s.{c}" for c in SILVER_TEXT]
            + [f"f.{c}" for c in feats])
    return q(f",\nfeats AS ({FEATURE_SQL})\nSELECT s.post_id, s.{target} AS label, " + ", ".join(cols)
             + f" FROM silver s JOIN feats f ON s.post_id = f.post_id WHERE s.{target} IS NOT NULL")


register("mlp_01_feature_target_split", _split_sql())(lambda s, d: _split_frame(s, d))
register("mlp_02_train_test_split")(lambda s, d: silver(s, d).select(
    "post_id", F.when(prep.hash_bucket("post_id", 42) < 20, "test").otherwise("train").alias("split")))
register("mlp_06_subsample")(lambda s, d: prep.subsample(silver(s, d), 1000, 42).select("post_id"))


def _preprocessed(s, d):
    frame, num, cat = prep.feature_target_split(featured(s, d), "credibility_score")
    model = prep.fit_pipeline(prep.preprocessing_stages(num, cat), frame)
    return model.transform(frame).select("post_id", vector_to_array("features").alias("features"))


register("mlp_03_preprocess")(_preprocessed)


FILL_COLUMNS = ["likes", "shares", "impressions_estimate", "credibility_score", "follower_count"]


def _filled(s, d):
    rows = posts_view(s, d).select("post_id", *[F.col(c).cast("double").alias(c) for c in FILL_COLUMNS])
    return prep.FillScale(FILL_COLUMNS).fit(rows).transform(rows)


def _filled_sql():
    imp = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM posts)) AS {c}" for c in FILL_COLUMNS)
    mom = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FILL_COLUMNS)
    z = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END AS {c}" for c in FILL_COLUMNS)
    return with_posts(f"SELECT post_id, {z} FROM (SELECT post_id, {imp} FROM posts), (SELECT {mom} FROM (SELECT {imp} FROM posts))")


register("mlp_03_numeric_fill_scale", _filled_sql())(_filled)


def _feature_names(s, d):
    frame, num, cat = prep.feature_target_split(featured(s, d), "credibility_score")
    out = prep.fit_pipeline(prep.preprocessing_stages(num, cat), frame).transform(frame.limit(1))
    names = prep.processed_feature_names(out)
    return s.createDataFrame(list(enumerate(names)), "position int, feature string")


register("mlp_04_feature_names")(_feature_names)

# ---------------------------------------------------------------- segmentation
CM_SQL = SCALED + ",\nlab AS (SELECT *, post_id % 3 AS cluster FROM scaled)" + cluster_metrics_cte(
    CLUSTER_FEATURES, "lab", "cluster")


def _metrics(s, d):
    return segment.cluster_metrics(scaled(s, d).withColumn("cluster", label3()), "cluster", Z)


register("clu_08_guarded_metrics", q(CM_SQL + "\nSELECT * FROM cm"))(_metrics)
register("clu_05_davies_bouldin", q(CM_SQL + "\nSELECT davies_bouldin_index FROM cm"))(
    lambda s, d: _metrics(s, d).select("davies_bouldin_index"))
register("clu_06_calinski_harabasz", q(CM_SQL + "\nSELECT calinski_harabasz_score FROM cm"))(
    lambda s, d: _metrics(s, d).select("calinski_harabasz_score"))
register("clu_07_inertia", q(CM_SQL + "\nSELECT inertia FROM cm"))(lambda s, d: _metrics(s, d).select("inertia"))

PROFILE_SQL = """
SELECT post_id % 3 AS cluster, count(*) AS cluster_size, avg(engagement_velocity) AS engagement_velocity,
       avg(misinformation_probability) AS misinformation_probability,
       avg(credibility_score) AS credibility_score, avg(toxicity_score) AS toxicity_score
FROM silver GROUP BY post_id % 3"""
register("agg_08_cluster_profile", q(PROFILE_SQL))(
    lambda s, d: segment.cluster_profile(silver(s, d).withColumn("cluster", label3())))


def _narr_sql():
    gm = ("SELECT " + ", ".join(f"avg({c}) AS g_{c}" for c in
                                ["engagement_velocity", "misinformation_probability", "credibility_score",
                                 "toxicity_score"]) + " FROM silver")
    from postlab.schema import CLUSTER_NARRATIVE_PREFIX, CLUSTER_TRAITS
    parts = []
    for c, above, below in CLUSTER_TRAITS:
        if below is None:
            parts.append(f"CASE WHEN round(p.{c}, 9) > round(g.g_{c}, 9) THEN '{above}' END")
        else:
            parts.append(f"CASE WHEN round(p.{c}, 9) > round(g.g_{c}, 9) THEN '{above}' ELSE '{below}' END")
    text = f"'{CLUSTER_NARRATIVE_PREFIX}' || concat_ws(', ', {', '.join(parts)}) || '.'"
    return q(f",\nprof AS ({PROFILE_SQL}),\ng AS ({gm})\nSELECT p.*, {text} AS interpretation FROM prof p, g")


register("clu_12_narrative", _narr_sql())(
    lambda s, d: segment.narrative(segment.cluster_profile(silver(s, d).withColumn("cluster", label3())),
                                   eda.feature_means(silver(s, d), ["engagement_velocity", "misinformation_probability",
                                                                     "credibility_score", "toxicity_score"])))
register("clu_01_k_scan")(lambda s, d: segment.k_scan(cached_scaled(s, d), Z))
register("clu_03_final_clusters")(
    lambda s, d: segment.final_clusters(cached_scaled(s, d), Z, 3).select("post_id", "cluster"))
def _silhouette_sql():
    mean = ", ".join(f"avg({z}) AS m_{z}" for z in Z)
    square = " + ".join(f"{z} * {z}" for z in Z)
    dot = " + ".join(f"l.{z} * st.m_{z}" for z in Z)
    return q(SCALED + f""",
lab AS (SELECT *, post_id % 3 AS cluster, {square} AS sq FROM scaled),
st AS (SELECT cluster AS c, count(*) AS n, avg(sq) AS q, {mean} FROM lab GROUP BY cluster),
pr AS (SELECT l.post_id, l.cluster = st.c AS own, st.n, greatest(l.sq + st.q - 2 * ({dot}), 0) AS dist FROM lab l, st),
per AS (SELECT post_id, max(CASE WHEN own THEN dist * n / greatest(n - 1, 1) END) AS a, min(CASE WHEN NOT own THEN dist END) AS b,
        max(CASE WHEN own THEN n END) AS own_n FROM pr GROUP BY post_id)
SELECT avg(CASE WHEN own_n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette_score FROM per""")


register("clu_04_silhouette", _silhouette_sql())(lambda s, d: s.createDataFrame(
    [(segment.silhouette(scaled(s, d).withColumn("cluster", label3()), "cluster", Z),)], "silhouette_score double"))
register("clu_09_model_comparison")(lambda s, d: segment.compare_models(cached_scaled(s, d, ["post_id", *Z, "features_scaled"]), Z))
register("clu_11_dbscan")(lambda s, d: density.dbscan(cached_scaled(s, d, ["post_id", *Z]), Z))
NEAR = " + ".join(f"(a.{z} - b.{z}) * (a.{z} - b.{z})" for z in Z)
register("clu_11_core_points", q(SCALED + f"""
SELECT a.post_id, count(*) AS n_near,
       count(*) >= least(greatest(3, CAST(floor((SELECT count(*) FROM scaled) * 0.02) AS BIGINT)), 50) AS is_core
FROM scaled a JOIN scaled b ON abs(a.{Z[0]} - b.{Z[0]}) <= 0.75 AND abs(a.{Z[1]} - b.{Z[1]}) <= 0.75 AND {NEAR} <= 0.5625
GROUP BY a.post_id"""))(lambda s, d: density.core_points(cached_scaled(s, d, ["post_id", *Z]), Z))
register("clu_11_density_cells", q(SCALED + f"""
SELECT CAST(floor({Z[0]} / 0.75) AS INTEGER) AS g0, CAST(floor({Z[1]} / 0.75) AS INTEGER) AS g1,
       CAST(floor({Z[2]} / 0.75) AS INTEGER) AS g2, count(*) AS n,
       count(*) >= least(greatest(3, CAST(floor((SELECT count(*) FROM scaled) * 0.02) AS BIGINT)), 50) AS dense
FROM scaled GROUP BY ALL"""))(lambda s, d: segment.density_cells(scaled(s, d), Z))

# ---------------------------------------------------------------- anomalies
def _forest(s, d):
    sc = scaled(s, d)
    nodes, psi = anomaly.fit_isolation_forest(sc, Z)
    return anomaly.score_isolation_forest(sc, Z, nodes, psi)


register("ano_02_score_from_path", q("""
SELECT post_id, 0.5 - pow(2, -path / c) AS anomaly_score, CASE WHEN 0.5 - pow(2, -path / c) < 0 THEN -1 ELSE 1 END AS anomaly_label,
       pow(2, -path / c) - 0.5 AS risk_score
FROM (SELECT post_id, 2.0::DOUBLE + ((post_id * 37) % 100) / 5.0::DOUBLE AS path, 2 * (ln(255) + 0.5772156649) - 2 * 255 / 256.0::DOUBLE AS c FROM silver)"""))(
    lambda s, d: anomaly.score_columns(silver(s, d).select(
        "post_id", (2.0 + F.pmod(F.col("post_id") * 37, F.lit(100)) / 5.0).alias("path")), "path", 256).drop("path"))
register("ano_01_02_isolation_forest")(
    lambda s, d: _forest(s, d).select("post_id", "anomaly_score", "anomaly_label", "risk_score"))


def _reason_sql():
    thr = ",\n".join(f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.95) FROM silver) AS t_{c}"
                     for c, _p in ANOMALY_REASON_CHECKS)
    parts = ", ".join(f"CASE WHEN CAST(s.{c} AS DOUBLE) > th.t_{c} THEN '{p}' END" for c, p in ANOMALY_REASON_CHECKS)
    return q(f""",
th AS (SELECT {thr}),
rs AS (SELECT s.post_id, {SQL_LABEL.replace('post_id', 's.post_id')} AS anomaly_label, concat_ws('; ', {parts}) AS j
       FROM silver s, th)
SELECT post_id, anomaly_label, CASE WHEN anomaly_label = -1 THEN (CASE WHEN j = '' THEN '{ANOMALY_REASON_FALLBACK}'
  ELSE j END) ELSE '{NORMAL_REASON}' END AS anomaly_reason FROM rs""")


def _reasons(s, d):
    sc = scaled(s, d).withColumn("anomaly_label", stand_label())
    return anomaly.reasons(sc, anomaly.reason_thresholds(scaled(s, d))).select("post_id", "anomaly_label",
                                                                              "anomaly_reason")


register("ano_03_reasons", _reason_sql())(_reasons)
register("agg_16_top_reasons", _reason_sql().replace(
    "\nSELECT post_id, anomaly_label, CASE", "\n, rr AS (SELECT post_id, anomaly_label, CASE", 1)
    + ") SELECT anomaly_reason, count(*) AS count FROM rr WHERE anomaly_label = -1 GROUP BY anomaly_reason "
      "ORDER BY count DESC, anomaly_reason LIMIT 10")(lambda s, d: anomaly.top_reasons(_reasons(s, d)))


def _stand_scored(s, d):
    return silver(s, d).select("post_id", stand_score().alias("anomaly_score"), stand_label().alias("anomaly_label"),
                               stand_truth().alias("truth"))


ANO_SUMMARY_SELECT = """SELECT CAST(count(*) FILTER (WHERE lb = -1) AS BIGINT) AS anomaly_count,
  CAST(count(*) AS BIGINT) AS total_records,
  round_even(count(*) FILTER (WHERE lb = -1) * 100.0 / count(*), 2)::DOUBLE AS anomaly_percentage,
  CAST(NULL AS DOUBLE) AS contamination_setting,
  round_even(count(*) FILTER (WHERE lb = -1) / count(*), 4)::DOUBLE AS anomaly_ratio,
  min(sc) AS score_min, max(sc) AS score_max, avg(sc) AS score_mean,
  quantile_cont(sc, 0.5) AS score_median, stddev_pop(sc) AS score_std,
  quantile_cont(sc, 0.25) AS score_p25, quantile_cont(sc, 0.75) AS score_p75 FROM st"""
STAND_CTE = f"""
, st AS (SELECT {SQL_SCORE} AS sc, {SQL_LABEL} AS lb FROM silver)"""

register("agg_17_anomaly_summary", q(STAND_CTE + "\n" + ANO_SUMMARY_SELECT))(
    lambda s, d: anomaly.summary(_stand_scored(s, d)))

SUP_ANO_CTE = f"""
, st AS (SELECT post_id, -{SQL_SCORE} AS risk, {SQL_TRUTH} AS y, CASE WHEN {SQL_LABEL} = -1 THEN 1 ELSE 0 END AS yp
         FROM silver),
bs AS (SELECT risk, sum(y) AS pos, sum(1 - y) AS neg FROM st GROUP BY risk),
cum AS (SELECT risk, pos, neg, sum(pos) OVER (ORDER BY risk DESC ROWS UNBOUNDED PRECEDING) AS cp,
               sum(neg) OVER (ORDER BY risk DESC ROWS UNBOUNDED PRECEDING) AS cn FROM bs),
tt AS (SELECT sum(pos) AS P, sum(neg) AS N FROM bs)"""


def _sup_ano(s, d):
    df = anomaly.normalise_labels(_stand_scored(s, d), "truth", "anomaly_label").withColumn(
        "risk_score", -F.col("anomaly_score"))
    return df


register("ano_05_supervised_metrics", q(SUP_ANO_CTE + """,
cnt AS (SELECT count(*) FILTER (WHERE y = 1 AND yp = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yp = 1) AS fp,
               count(*) FILTER (WHERE y = 1 AND yp = 0) AS fn, count(*) FILTER (WHERE y = 0 AND yp = 0) AS tn,
               count(DISTINCT risk) AS ns FROM st),
rk AS (SELECT sum(pos * ((N - cn) + 0.5 * neg)) AS auc_num,
              sum(CASE WHEN pos > 0 THEN (pos / P) * (cp / (cp + cn)) END) AS ap, max(P) AS P, max(N) AS N
       FROM cum, tt),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS prec,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rec FROM cnt, rk)
SELECT prec AS precision, rec AS recall,
  (CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END) AS f1_score,
  CASE WHEN P > 0 AND N > 0 AND ns > 1 THEN (auc_num / (P * N)) END AS roc_auc,
  CASE WHEN P > 0 AND N > 0 AND ns > 1 THEN ap END AS average_precision,
  CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM pr"""))(
    lambda s, d: anomaly.supervised_metrics(_sup_ano(s, d)))

register("ano_07_curves", q(SUP_ANO_CTE + """
SELECT risk AS threshold, CAST(cp AS BIGINT) AS tp, CAST(cn AS BIGINT) AS fp,
  (CASE WHEN P > 0 THEN cp / P END) AS tpr, (CASE WHEN N > 0 THEN cn / N END) AS fpr,
  (cp / (cp + cn)) AS precision, (CASE WHEN P > 0 THEN cp / P END) AS recall FROM cum, tt"""))(
    lambda s, d: anomaly.curves(_sup_ano(s, d)))

register("top_02_anomalies_sorted", q(
    f"\nSELECT post_id, {SQL_SCORE} AS anomaly_score FROM silver WHERE {SQL_LABEL} = -1"))(
    lambda s, d: anomaly.anomalies_sorted(_stand_scored(s, d)).select("post_id", F.col("anomaly_score")
                                                                      .alias("anomaly_score")))

# ---------------------------------------------------------------- forecasting
DAILY_LONG_SQL = f""",
ad AS (SELECT *, make_date(year, {MONTH_CASE},
  least(row_number() OVER (PARTITION BY year, {MONTH_CASE} ORDER BY post_id), 28)) AS analysis_date FROM silver),
daily AS (SELECT analysis_date, avg(engagement_velocity) AS engagement_velocity,
       avg(misinformation_probability) AS misinformation_probability,
       avg(credibility_score) AS credibility_score, CAST(count(post_id) AS DOUBLE) AS post_volume
  FROM ad WHERE analysis_date IS NOT NULL GROUP BY analysis_date),
lng AS (SELECT * FROM (UNPIVOT daily ON engagement_velocity, misinformation_probability, credibility_score, post_volume
        INTO NAME metric VALUE value) WHERE value IS NOT NULL AND NOT isnan(value))"""


def _long(s, d):
    return forecast.long_series(cal.synthetic_daily_metrics(silver(s, d), default_year=2025))


register("win_04_time_index", q(DAILY_LONG_SQL + """
SELECT metric, analysis_date, CAST(row_number() OVER (PARTITION BY metric ORDER BY analysis_date) - 1 AS INTEGER)
  AS time_index FROM lng"""))(lambda s, d: forecast.time_index(_long(s, d)).select("metric", "analysis_date", "time_index"))

register("win_03_recent_mean", q(DAILY_LONG_SQL + """
SELECT metric, avg(value) AS recent_mean FROM (SELECT *, row_number() OVER (PARTITION BY metric
  ORDER BY analysis_date DESC) AS r FROM lng) WHERE r <= 7 GROUP BY metric"""))(
    lambda s, d: eda.top_k_per_group(_long(s, d), "metric", [F.desc("analysis_date")], 7)
    .groupBy("metric").agg(F.avg("value").alias("recent_mean")))

TREND_SQL = DAILY_LONG_SQL + """,
f0 AS (SELECT metric, min(analysis_date) AS d0, max(analysis_date) AS d1 FROM lng GROUP BY metric),
fit AS (SELECT l.metric, l.value, CAST(date_diff('day', f0.d0, l.analysis_date) AS DOUBLE) AS t FROM lng l
        JOIN f0 ON l.metric = f0.metric),
cf AS (SELECT metric, coalesce(regr_slope(value, t), 0) AS b, coalesce(regr_intercept(value, t), avg(value)) AS a
       FROM fit GROUP BY metric),
rs AS (SELECT fit.metric, stddev_pop(fit.value - (cf.a + cf.b * fit.t)) AS sd FROM fit JOIN cf ON fit.metric = cf.metric
       GROUP BY fit.metric),
pts AS (SELECT metric, analysis_date, false AS is_future FROM lng
        UNION ALL
        SELECT f0.metric, CAST(f0.d1 + INTERVAL (g.i) DAY AS DATE), true FROM f0, range(1, 31) g(i)),
fc AS (SELECT p.metric, p.analysis_date, p.is_future,
         cf.a + cf.b * CAST(date_diff('day', f0.d0, p.analysis_date) AS DOUBLE) AS y, rs.sd
       FROM pts p JOIN cf ON p.metric = cf.metric JOIN f0 ON p.metric = f0.metric JOIN rs ON p.metric = rs.metric)"""

register("for_01_trend_forecast", q(TREND_SQL + """
SELECT metric, analysis_date, y AS yhat, (y - 1.96 * sd) AS yhat_lower,
       (y + 1.96 * sd) AS yhat_upper, is_future FROM fc"""))(
    lambda s, d: forecast.linear_trend_forecast(_long(s, d)))

register("for_03_future_frame", q(TREND_SQL + "\nSELECT metric, analysis_date, is_future FROM pts"))(
    lambda s, d: forecast.linear_trend_forecast(_long(s, d)).select("metric", "analysis_date", "is_future"))

register("for_05_07_directions", q(TREND_SQL + """,
rec AS (SELECT metric, avg(value) AS recent_mean FROM (SELECT *, row_number() OVER (PARTITION BY metric
        ORDER BY analysis_date DESC) AS r FROM lng) WHERE r <= 7 GROUP BY metric),
fut AS (SELECT metric, avg(y) AS forecast_mean, arg_min(y, analysis_date) AS f0,
        arg_max(y, analysis_date) AS f1 FROM fc WHERE is_future GROUP BY metric),
wh AS (SELECT metric, arg_min(y, analysis_date) AS w0, arg_max(y, analysis_date) AS w1
       FROM fc GROUP BY metric)
SELECT wh.metric, rec.recent_mean AS recent_mean, fut.forecast_mean AS forecast_mean,
  CASE WHEN fut.forecast_mean > rec.recent_mean THEN 'increase' ELSE 'decline' END AS direction_vs_recent,
  CASE WHEN fut.f0 IS NULL THEN 'stable' WHEN fut.f1 > fut.f0 THEN 'upward' ELSE 'downward' END AS direction_in_horizon,
  CASE WHEN wh.w1 > wh.w0 THEN 'upward' ELSE 'downward' END AS direction_whole_series
FROM wh LEFT JOIN rec ON wh.metric = rec.metric LEFT JOIN fut ON wh.metric = fut.metric"""))(
    lambda s, d: forecast.directions(_long(s, d), forecast.linear_trend_forecast(_long(s, d))))

register("for_01_seasonal_forecast")(lambda s, d: forecast.seasonal_forecast(_long(s, d)))
register("for_02_forest_forecast")(lambda s, d: forecast.forest_forecast(_long(s, d)))

# ---------------------------------------------------------------- supervised
REG_SQL = """
SELECT '{t}' AS target, (avg(abs(e))) AS mae, (sqrt(avg(e * e))) AS rmse,
       (CASE WHEN var_pop(y) * count(*) > 0 THEN 1 - sum(e * e) / (var_pop(y) * count(*)) END) AS r2
FROM (SELECT {t} AS y, (0.9 * {t} + 0.01) - {t} AS e FROM silver WHERE {t} IS NOT NULL)"""


def _reg_metrics(s, d, t):
    df = silver(s, d).where(F.col(t).isNotNull()).select(F.col(t).alias("label"),
                                                          (0.9 * F.col(t) + 0.01).alias("prediction"))
    return supervised.regression_metrics(df).select(F.lit(t).alias("target"), "*")


register("sup_03_regression_metrics", q(REG_SQL.format(t="credibility_score")))(
    lambda s, d: _reg_metrics(s, d, "credibility_score"))
register("set_01_union_metrics", q(REG_SQL.format(t="misinformation_probability") + "\nUNION ALL\n"
                                   + REG_SQL.format(t="credibility_score")))(
    lambda s, d: _reg_metrics(s, d, "misinformation_probability").unionByName(_reg_metrics(s, d, "credibility_score")))


def _train(s, d, target="credibility_score"):
    """The whole training as the pipeline does it: eight seeded draws, 2-fold CV + refit, five permutation repeats."""
    res = supervised.train_target(featured(s, d), target)
    return res["metrics"].drop("training_seconds")


register("sup_07_train_target")(_train)


class LinearStandIn:
    """``prediction = 0.9 * credibility_score + 0.01``: a model whose explanation SQL can repeat."""

    def transform(self, df):
        return df.withColumn("prediction", 0.9 * F.col("credibility_score") + 0.01)


DRIVER_NUM = ["follower_count", "sentiment_score", "toxicity_score", "credibility_score", "reach_estimate"]
DRIVER_CAT = ["topic", "region"]


def _drivers(s, d):
    """Importances rise by a tenth from feature to feature, the first one negative and so floored."""
    imp = s.createDataFrame([(c, i / 10 - 0.1) for i, c in enumerate(DRIVER_NUM + DRIVER_CAT)], "feature string, permutation_importance double")
    return supervised.signed_drivers(LinearStandIn(), silver(s, d), imp, DRIVER_NUM, DRIVER_CAT)


def _drivers_sql(before=""):
    codes = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN dense_rank() OVER (ORDER BY {c}) - 1 END AS code_{c}" for c in DRIVER_CAT)
    parts = [f"SELECT '{c}' AS feature, {i / 10 - 0.1!r}::DOUBLE AS permutation_importance, corr(CAST({v} AS DOUBLE), p) AS correlation, "
             f"{str(c in DRIVER_CAT).lower()} AS is_nominal FROM pr"
             for i, (c, v) in enumerate([(c, c) for c in DRIVER_NUM] + [(c, f"code_{c}") for c in DRIVER_CAT])]
    return q(before + f""",
pr AS (SELECT *, 0.9 * credibility_score + 0.01 AS p, {codes} FROM silver),
dr AS ({' UNION ALL '.join(parts)}),
drivers AS (SELECT *, greatest(permutation_importance, 0) * coalesce(sign(correlation), 0) AS directional_effect FROM dr)
""")


class MixedStandIn:
    """A fixed model of numbers and a text, with the same value for every missing one."""

    def transform(self, df):
        parts = [F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.25)) for c, w in MIXED_WEIGHTS.items()]
        return df.withColumn("prediction", sum(parts, F.lit(0.0)) + F.coalesce(F.length("topic"), F.lit(0)) * 0.01)


MIXED_WEIGHTS = {"sentiment_score": 0.4, "toxicity_score": -0.3, "misinformation_probability": 0.2, "engagement_velocity": 0.001}
MIXED_FEATURES = [*MIXED_WEIGHTS, "topic", "region"]


def _permutation(s, d):
    frame = silver(s, d).where(F.col("credibility_score").isNotNull()).select(
        "post_id", F.col("credibility_score").cast("double").alias("label"), *MIXED_FEATURES)
    return supervised.permutation_importance(MixedStandIn(), frame, MIXED_FEATURES, repeats=5)


def _permutation_sql():
    def predicted(swapped):
        side = {c: "p" if c == swapped else "d" for c in MIXED_FEATURES}
        parts = [f"{w!r}::DOUBLE * coalesce(CAST({side[c]}.{c} AS DOUBLE), 0.25e0)" for c, w in MIXED_WEIGHTS.items()]
        return " + ".join([*parts, f"coalesce(length({side['topic']}.topic), 0) * 0.01e0"])

    errors = " UNION ALL ".join(f"SELECT '{c}' AS feature, r, sqrt(avg(pow({predicted(c)} - d.y, 2))) AS rmse "
                                "FROM d, step JOIN d p ON p.i = (step.a * d.i + step.b) % step.n GROUP BY r".replace("FROM d, step JOIN d p ON", "FROM d CROSS JOIN step JOIN d p ON")
                                for c in MIXED_FEATURES)
    return q(f""",
d AS (SELECT CAST(row_number() OVER (ORDER BY post_id) - 1 AS BIGINT) AS i, CAST(credibility_score AS DOUBLE) AS y, * FROM silver WHERE credibility_score IS NOT NULL),
sizes AS (SELECT count(*) AS n FROM d),
step AS (SELECT r, n, (SELECT min(a) FROM (SELECT unnest(generate_series(1 + 7919 * r % n, 1 + 7919 * r % n + 1000)) AS a) WHERE gcd(a, n) = 1) AS a,
         104729 * r % n AS b FROM sizes, (SELECT unnest(generate_series(1, 5)) AS r)),
base AS (SELECT sqrt(avg(pow({predicted(None)} - d.y, 2))) AS rmse FROM d),
each AS ({errors})
SELECT feature, avg(each.rmse - base.rmse) AS permutation_importance FROM each, base GROUP BY feature""")


register("sup_05_permutation_importance", _permutation_sql())(_permutation)
TREND_AND_DRIVERS_SQL = _drivers_sql(TREND_SQL)
register("sup_06_signed_drivers", _drivers_sql() + "SELECT * FROM drivers")(_drivers)
register("sup_12_recommendation", _drivers_sql() + "SELECT '" + RECOMMENDATION_TEMPLATES["credibility_score"].replace("'", "''").replace(
    "{pos}", "' || (SELECT arg_max(feature, directional_effect) FROM drivers) || '").replace(
    "{neg}", "' || (SELECT arg_min(feature, directional_effect) FROM drivers) || '") + "' AS recommendation")(
    lambda s, d: s.createDataFrame([(supervised.recommendation("credibility_score", _drivers(s, d)),)], "recommendation string"))

# ---------------------------------------------------------------- explanation (SUP-09/10/11) and reports
_MODEL_CACHE: dict = {}


def small_model(s, d, target="credibility_score", trees=20):
    """A 20-tree boosted model of the target on the hash train split (explanation queries only)."""
    key = (s.sparkContext.applicationId, d, target, trees)
    if key not in _MODEL_CACHE:
        from pyspark.ml import Pipeline
        frame, num, cat = prep.feature_target_split(featured(s, d), target)
        train, _test = prep.train_test_split(frame)
        model = Pipeline(stages=prep.preprocessing_stages(num, cat) + [supervised.make_regressor(
            42, {"n_estimators": trees})]).fit(train)
        _MODEL_CACHE[key] = (model, frame, num + cat)
    return _MODEL_CACHE[key]


def _contributions(s, d):
    """Exact contributions of the fitted trees; computed once for both rows."""
    key = (s.sparkContext.applicationId, d, "contributions")
    if key not in _MODEL_CACHE:
        model, frame, _ = small_model(s, d)
        _MODEL_CACHE[key] = cut_lineage(contributions.tree_contributions(model, frame, n_rows=500, n_background=100))
    return _MODEL_CACHE[key]


def _shap(s, d):
    from postlab.operators import explain
    return explain.mean_abs_importance(_contributions(s, d))


def _dependence(s, d):
    from postlab.operators import explain
    contrib = _contributions(s, d)
    top = explain.mean_abs_importance(contrib).first()["feature"]
    return explain.dependence(contrib, None, top).withColumn("feature", F.lit(top))


def _tree_importance(s, d):
    """Importances of the processed features, summing to one."""
    model, frame, _ = small_model(s, d)
    return supervised.feature_importance(model, model.transform(frame))


register("sup_04_tree_importance")(_tree_importance)
register("sup_10_shapley_importance")(_shap)
register("sup_11_shapley_dependence")(_dependence)


def _avp_frame(s, d, t="credibility_score"):
    return silver(s, d).where(F.col(t).isNotNull()).select(
        F.col(t).alias("actual"), (0.9 * F.col(t) + 0.01).alias("predicted"), F.lit(t).alias("target"))


AVP_VIEW = [("actual_vs_predicted", "actual", "predicted", "target")]


def _avp_sql():
    from postlab.plans.catalog import _scatter_sql
    src = ("(SELECT credibility_score AS actual, 0.9 * credibility_score + 0.01 AS predicted, "
           "'credibility_score' AS target FROM silver WHERE credibility_score IS NOT NULL)")
    return _scatter_sql(views=AVP_VIEW, source=src)


register("sup_09_actual_vs_predicted_bins", _avp_sql())(
    lambda s, d: eda.scatter_bins(_avp_frame(s, d), AVP_VIEW))


CLUSTER_VIEWS = [("clusters_by_risk", "misinformation_probability", "engagement_velocity", "cluster")]
ANOMALY_VIEWS = [("anomalies_by_score", "anomaly_score", "toxicity_score", "anomaly_label")]


def _stand_view_sql(views):
    from postlab.plans.catalog import _scatter_sql
    return _scatter_sql(views=views, source=f"(SELECT *, post_id % 3 AS cluster, {SQL_SCORE} AS anomaly_score, {SQL_LABEL} AS anomaly_label FROM silver)")


def _stand_view(s, d):
    return silver(s, d).withColumns({"cluster": label3(), "anomaly_score": stand_score(), "anomaly_label": stand_label()})


register("agg_15_cluster_bins", _stand_view_sql(CLUSTER_VIEWS))(lambda s, d: eda.scatter_bins(_stand_view(s, d), CLUSTER_VIEWS))
register("agg_15_anomaly_bins", _stand_view_sql(ANOMALY_VIEWS))(lambda s, d: eda.scatter_bins(_stand_view(s, d), ANOMALY_VIEWS))


def _score_hist_sql():
    from postlab.plans.catalog import _hist_sql
    return _hist_sql(["anomaly_score"], 20, False).replace("FROM silver", f"FROM (SELECT {SQL_SCORE} AS anomaly_score FROM silver)")


register("agg_14_anomaly_hist", _score_hist_sql())(lambda s, d: eda.histogram(_stand_view(s, d), ["anomaly_score"], 20, False))

register("for_01_method_choice", q(DAILY_LONG_SQL + """
SELECT metric, count(*) AS points, CASE WHEN count(*) >= 10 THEN 'seasonal' ELSE 'forest' END AS method FROM lng GROUP BY metric"""))(
    lambda s, d: forecast.method_choice(_long(s, d)))


def _findings(s, d):
    from postlab.operators import report
    return report.findings(forecast.linear_trend_forecast(_long(s, d)), _drivers(s, d).withColumn("target", F.lit("credibility_score")))


register("rep_03_findings", TREND_AND_DRIVERS_SQL + """
SELECT 'mean_forecast' AS kind, metric AS subject, avg(y) AS value FROM fc WHERE is_future GROUP BY metric
UNION ALL SELECT 'positive_driver_of_credibility_score', arg_max(feature, directional_effect), max(directional_effect) FROM drivers
UNION ALL SELECT 'negative_driver_of_credibility_score', arg_min(feature, directional_effect), min(directional_effect) FROM drivers""")(_findings)


def _forecast_section(s, d):
    from postlab.operators import report
    return report.forecast_section(forecast.directions(_long(s, d), forecast.linear_trend_forecast(_long(s, d))))


register("rep_01_forecast_section", q(TREND_SQL + """,
rec AS (SELECT metric, avg(value) AS v FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY analysis_date DESC) AS r FROM lng)
        WHERE r <= 7 GROUP BY metric)
SELECT 'forecast' AS section, metric AS model, 'recent_mean' AS metric, round(v, 4) AS value FROM rec
UNION ALL SELECT 'forecast', metric, 'forecast_mean', round(avg(y), 4) FROM fc WHERE is_future GROUP BY metric"""))(_forecast_section)


def _rep01(s, d):
    from postlab.operators import report
    parts = [report.long_metrics("regression", t, _reg_metrics(s, d, t).drop("target"))
             for t in ("misinformation_probability", "credibility_score")]
    parts.append(report.long_metrics("anomaly", "isolation_forest", anomaly.summary(_stand_scored(s, d))))
    return report.union_all(parts)


def _rep01_sql():
    parts = []
    for t in ("misinformation_probability", "credibility_score"):
        for m in ("mae", "rmse", "r2"):
            parts.append(f"SELECT 'regression' AS section, '{t}' AS model, '{m}' AS metric, "
                         f"round(CAST({m} AS DOUBLE), 4) AS value FROM ({REG_SQL.format(t=t)})")
    for m in ("anomaly_count", "total_records", "anomaly_percentage", "contamination_setting", "anomaly_ratio",
              "score_min", "score_max", "score_mean", "score_median", "score_std", "score_p25", "score_p75"):
        parts.append(f"SELECT 'anomaly', 'isolation_forest', '{m}', round(CAST({m} AS DOUBLE), 4) FROM an")
    return q(STAND_CTE + f",\nan AS ({ANO_SUMMARY_SELECT})\n" + "\nUNION ALL\n".join(parts))


register("rep_01_metric_table", _rep01_sql())(_rep01)


def _bisecting(s, d):
    return segment.bisecting(cached_scaled(s, d), 4).select("post_id", "cluster")


def _anomaly_stage(s, d):
    sc = scaled(s, d)
    nodes, psi = anomaly.fit_isolation_forest(sc, Z)
    scored = anomaly.score_isolation_forest(sc, Z, nodes, psi, keep=CLUSTER_FEATURES)
    return anomaly.reasons(scored, anomaly.reason_thresholds(sc)).select(
        "post_id", "anomaly_score", "anomaly_label", "anomaly_reason")


register("clu_10_bisecting_kmeans")(_bisecting)
register("ano_08_anomaly_stage")(_anomaly_stage)
