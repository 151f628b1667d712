"""PIP-01: the whole analytics run as a sequence of Spark jobs.

load -> silver -> gold -> features -> boosted trees per target -> scaled matrix -> segments ->
anomalies -> forecasts -> report tables. Every stage writes its tables under ``out_dir`` (a shared
folder on a cluster) and later stages read them back, so lineage is cut at each stage boundary and
an executor loss only recomputes from the last written table. A failing stage is recorded in the
timings table and the later stages still run. With ``resume`` a stage whose input fingerprint and
parameters match the manifest is skipped (its tables are read back).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab.operators import anomaly, clean, contributions, eda, explain, features, forecast, prep, report, segment, star, supervised
from postlab.operators import calendar as cal
from postlab.schema import CLUSTER_FEATURES, TARGETS
from postlab.session import prepare_session
from postlab.sources import sinks
from postlab.sources.posts import posts_view

Z = [f"z_{c}" for c in CLUSTER_FEATURES]


def run_pipeline(spark: SparkSession, out_dir: str, sf_dir: str | None = None, bronze: DataFrame | None = None,
                 seed: int = 42, resume: bool = True, targets: list[str] = TARGETS, n_draws: int = 8, folds: int = 2,
                 permutation_repeats: int = 5, restarts: int | None = None, n_trees: int = 300, periods: int = 30,
                 default_year: int | None = None, skip: tuple = ()) -> dict:
    """Run every stage; returns {table name: DataFrame read back from ``out_dir``} plus ``timings``."""
    prepare_session(spark)
    timer = report.StageTimer()
    manifest = sinks.StageManifest(spark, out_dir)
    tables: dict[str, DataFrame] = {}
    facts: dict = {}
    params = dict(seed=seed, n_draws=n_draws, folds=folds, restarts=restarts, n_trees=n_trees, periods=periods,
                  targets=list(targets), permutation_repeats=permutation_repeats, default_year=default_year)

    def path(name):
        return os.path.join(out_dir, name)

    def put(name, df, partition_by=None):
        sinks.write_table(df, path(name), partition_by)
        tables[name] = spark.read.parquet(path(name))
        return tables[name]

    def unless_skipped(stage):
        if stage in skip:
            raise report.StageSkipped(stage)

    def reuse(stage, names, fp):
        if resume and fp is not None and manifest.is_fresh(stage, fp):
            for n in names:
                tables[n] = spark.read.parquet(path(n))
            return True
        return False

    with timer.stage("data_loading") as st:
        src = bronze if bronze is not None else posts_view(spark, sf_dir)
        fp = sinks.input_fingerprint(src, params)  # None for inputs without files: nothing is reused
        if reuse("silver", ["bronze", "silver"], fp):
            st["value"] = "reused"
        else:
            bronze_t = put("bronze", src)  # medallion bronze: the raw rows as a table
            put("silver", clean.to_silver(bronze_t, cache=True))
            manifest.mark("silver", fp, ["bronze", "silver"])
    silver = tables["silver"]

    with timer.stage("gold_star_schema") as st:
        unless_skipped("gold_star_schema")
        names = ["dim_users"] + [f"dim_{c}" for c in ("platform", "crisis_phase", "topic", "sentiment_label",
                                                      "emotion", "region", "language", "time")] + ["fact_posts"]
        if reuse("gold", names, fp):
            st["value"] = "reused"
        else:
            dims = star.build_dimensions(silver)
            for n, d in dims.items():
                put(n, d)
            fact = put("fact_posts", star.build_fact(silver, {k: tables[k] for k in dims}))
            facts["star_checks"] = star.star_checks(silver, fact).first().asDict()
            manifest.mark("gold", fp, names)

    with timer.stage("feature_engineering"):
        featured = features.add_engineered_features(silver)

    if "model_training" not in skip:
        with timer.stage("model_training") as st:
            outs = [f"model_{k}" for k in ("metrics", "importance", "drivers", "predictions")]
            if reuse("model_training", outs, fp):
                st["value"] = "reused"
            else:
                res, status = {}, {}
                for t in targets:  # SUP-08: one target failing does not stop the others
                    try:
                        r = supervised.train_target(featured, t, seed, n_draws, folds, True, permutation_repeats)
                        sinks.save_model(r["model"], path(f"models/gbt_{t}"))
                        facts[f"recommendation_{t}"] = r["recommendation"]
                        res[t], status[t] = r, "trained"
                    except Exception as exc:  # noqa: BLE001
                        status[t] = "failed"
                        facts[f"training_error_{t}"] = f"{type(exc).__name__}: {str(exc)[:200]}"
                        saved = sinks.load_model_result(spark, out_dir, t)
                        if saved is not None:  # fall back to the last saved result of this target
                            res[t], status[t] = saved, "reused"
                for k in sinks.RESULT_TABLES:
                    frames = [r[k] for r in res.values()]
                    if k == "metrics":
                        frames = [f.withColumn("status", F.lit(status[t])) for t, f in zip(res, frames)]
                    if frames:
                        put(f"model_{k}", report.union_all(frames), ["target"])
                # REP-02: top driver per target; REP-04: seconds of all targets together
                if res:
                    for r in report.top_drivers(report.union_all([r["drivers"] for r in res.values()])).collect():  # one row a target
                        facts[f"top_driver_{r['target']}"] = r["top_driver"]
                    facts["training_seconds_total"] = float(tables["model_metrics"].agg(F.sum("training_seconds")).first()[0] or 0.0)
                if all(v == "trained" for v in status.values()):
                    manifest.mark("model_training", fp, outs)

    if "model_training" not in skip and "explanation" not in skip:
        with timer.stage("explanation") as st:
            if reuse("explanation", ["shap_importance"], fp):
                st["value"] = "reused"
            else:
                parts = []
                for t in targets:
                    saved = sinks.load_model_result(spark, out_dir, t)
                    if saved is not None:
                        frame, num, cat = prep.feature_target_split(featured, t)
                        contrib = contributions.tree_contributions(saved["model"], frame, seed=seed)
                        parts.append(explain.mean_abs_importance(contrib).withColumn("target", F.lit(t)))
                if parts:
                    put("shap_importance", report.union_all(parts))
                    manifest.mark("explanation", fp, ["shap_importance"])

    with timer.stage("preprocessing"):
        scaled = put("scaled_matrix", prep.scaled_matrix(silver, CLUSTER_FEATURES,
                                                         keep=["engagement_velocity", "misinformation_probability",
                                                               "credibility_score", "toxicity_score"]))

    with timer.stage("clustering_training") as st:
        unless_skipped("clustering_training")
        outs = ["kmeans_scores", "clusters", "cluster_profile", "cluster_comparison"]
        if reuse("clustering", outs, fp):
            st["value"] = "reused"
        else:
            fits = segment.fit_kmeans(scaled, Z, segment.scan_range(scaled.count()), seed, restarts)
            scores = put("kmeans_scores", segment.k_scan(scaled, Z, seed, fits=fits))
            k = segment.best_k(scores) or 2
            clustered = put("clusters", segment.final_clusters(scaled, Z, k, seed, fits=fits)
                            .select("post_id", "cluster"))
            joined = silver.join(clustered, "post_id")
            profile = segment.cluster_profile(joined)
            put("cluster_profile", segment.narrative(profile, eda.feature_means(
                silver, ["engagement_velocity", "misinformation_probability", "credibility_score", "toxicity_score"])))
            put("cluster_comparison", segment.compare_models(scaled, Z, seed, fits=fits))
            manifest.mark("clustering", fp, outs)
        facts["cluster_count"] = tables["clusters"].select("cluster").distinct().count()

    with timer.stage("anomaly_detection") as st:
        unless_skipped("anomaly_detection")
        outs = ["forest_nodes", "anomaly_scores", "anomalies", "anomaly_metrics"]
        if reuse("anomaly", outs, fp):
            st["value"] = "reused"
        else:
            nodes, psi = anomaly.fit_isolation_forest(scaled, Z, n_trees, 256, seed)
            nodes = put("forest_nodes", nodes)
            scored = anomaly.score_isolation_forest(scaled, Z, nodes, psi, keep=CLUSTER_FEATURES)
            scored = anomaly.reasons(scored, anomaly.reason_thresholds(scaled))
            scored = put("anomaly_scores", scored.drop(*CLUSTER_FEATURES))
            put("anomalies", anomaly.anomalies_sorted(scored))
            put("anomaly_metrics", anomaly.summary(scored))
            truth = anomaly.find_truth_column(silver.columns)
            if truth:
                ev = anomaly.normalise_labels(scored.join(silver.select("post_id", truth), "post_id"),
                                              truth, "anomaly_label")
                put("anomaly_supervised_metrics", anomaly.supervised_metrics(ev))
                put("anomaly_curves", anomaly.curves(ev))
            manifest.mark("anomaly", fp, outs)
        facts["anomaly_count"] = tables["anomaly_metrics"].first()["anomaly_count"]

    with timer.stage("forecasting") as st:
        unless_skipped("forecasting")
        outs = ["daily_metrics", "forecasts", "forecast_directions"]
        if reuse("forecasting", outs, fp):
            st["value"] = "reused"
        else:
            daily = put("daily_metrics", cal.synthetic_daily_metrics(silver, default_year))
            long = forecast.long_series(daily)
            fc = put("forecasts", forecast.forecast_series(long, periods), ["metric"])
            put("forecast_directions", forecast.directions(long, fc, periods))
            manifest.mark("forecasting", fp, outs)
        for r in tables["forecast_directions"].collect():  # one row per metric
            facts[f"direction_{r['metric']}"] = r["direction_in_horizon"]

    with timer.stage("insights_reporting"):
        parts = []
        if "anomaly_metrics" in tables:
            parts.append(report.long_metrics("anomaly", "isolation_forest", tables["anomaly_metrics"]))
        if "cluster_comparison" in tables:
            cc = tables["cluster_comparison"]
            for r in cc.select("model_name").collect():  # three model rows
                parts.append(report.long_metrics("clustering", r[0], cc.where(F.col("model_name") == r[0])
                                                 .select("silhouette_score", "davies_bouldin_index",
                                                         "calinski_harabasz_score", "inertia")))
        if "model_metrics" in tables:
            mm = tables["model_metrics"]
            for t in targets:
                parts.append(report.long_metrics("regression", t, mm.where(F.col("target") == t)
                                                 .select("mae", "rmse", "r2", "best_cv_rmse")))
        if "anomaly_supervised_metrics" in tables:
            parts.append(report.long_metrics("classification", "isolation_forest", tables["anomaly_supervised_metrics"]))
        if "forecast_directions" in tables:
            parts.append(report.forecast_section(tables["forecast_directions"]))
        if "forecasts" in tables and "model_drivers" in tables:
            put("report_findings", report.findings(tables["forecasts"], tables["model_drivers"]))
        if parts:
            put("report_metrics", report.union_all(parts))
        put("executive_facts", report.executive_facts(spark, {k: v for k, v in facts.items()
                                                              if not isinstance(v, dict)}))

    tables["timings"] = timer.table(spark)
    sinks.write_table(tables["timings"], path("timings"))
    return tables
