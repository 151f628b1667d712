import tempfile

from pyspark.sql import functions as F

from postlab.operators import supervised
from postlab.plans.pipeline import run_pipeline
from postlab.sources import sinks
from postlab.sources.posts import posts_view

SF = "/root/testdata/sf0.001"
SMALL = dict(n_trees=20, restarts=1, default_year=2025)


def _status(tables):
    return {r["stage"]: r["status"] for r in tables["timings"].collect()}


def test_pipeline_runs_and_resumes(spark):
    out = tempfile.mkdtemp(prefix="pipe-")
    first = run_pipeline(spark, out, sf_dir=SF, skip=("model_training",), **SMALL)
    assert all(v == "ok" for v in _status(first).values()), _status(first)
    assert _status(first)["forecasting"] == "ok"
    for name in ("silver", "fact_posts", "clusters", "anomaly_scores", "forecasts", "report_metrics", "executive_facts"):
        assert first[name].count() > 0
    assert first["fact_posts"].count() == first["silver"].count()
    again = _status(run_pipeline(spark, out, sf_dir=SF, skip=("model_training",), **SMALL))
    assert again["data_loading"] == "reused" and again["clustering_training"] == "reused"


def test_fingerprint_needs_files_and_holds_every_argument(spark):
    posts = posts_view(spark, SF)
    rows = spark.createDataFrame(posts.limit(30).collect(), posts.schema)
    assert sinks.input_fingerprint(rows, {"a": 1}) is None
    assert sinks.input_fingerprint(posts, {"targets": ["x"]}) != sinks.input_fingerprint(posts, {"targets": ["y"]})
    manifest = sinks.StageManifest(spark, tempfile.mkdtemp(prefix="man-"))
    manifest.mark("silver", "f1", ["silver"])
    assert manifest.is_fresh("silver", "f1") and not manifest.is_fresh("silver", "f2")
    manifest.mark("silver", None, ["silver"])  # an input without identity leaves nothing to reuse
    assert not manifest.is_fresh("silver", "f1")


def test_failing_target_and_saved_result(spark, monkeypatch):
    draw = {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0}
    monkeypatch.setattr(supervised, "draw_params", lambda *a, **k: [draw])
    out = tempfile.mkdtemp(prefix="pipe-")
    args = dict(sf_dir=SF, n_draws=1, permutation_repeats=1, skip=("gold_star_schema", "clustering_training", "anomaly_detection", "forecasting"), **SMALL)
    first = run_pipeline(spark, out, targets=["credibility_score", "no_such_target"], **args)
    facts = first["executive_facts"].first().asDict()
    assert {r["target"] for r in first["shap_importance"].collect()} == {"credibility_score"}
    assert first["shap_importance"].agg(F.max("mean_abs_shap")).first()[0] > 0
    assert "training_error_no_such_target" in facts and "recommendation_credibility_score" in facts
    assert isinstance(facts["training_seconds_total"], float) and facts["training_seconds_total"] > 0
    assert facts["top_driver_credibility_score"] in {r["feature"] for r in first["model_drivers"].collect()}
    assert {(r["target"], r["status"]) for r in first["model_metrics"].collect()} == {("credibility_score", "trained")}
    saved = sinks.load_model_result(spark, out, "credibility_score")
    assert saved["predictions"].count() > 0 and saved["model"] is not None
    assert sinks.load_model_result(spark, out, "no_such_target") is None

    def broken(*a, **k):
        raise RuntimeError("no training today")

    monkeypatch.setattr(supervised, "train_target", broken)
    second = run_pipeline(spark, out, targets=["credibility_score"], **args)
    assert {(r["target"], r["status"]) for r in second["model_metrics"].collect()} == {("credibility_score", "reused")}
    assert second["model_predictions"].count() == saved["predictions"].count()
