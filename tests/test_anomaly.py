import numpy as np
import pytest
from pyspark.sql import functions as F

from postlab.operators import anomaly


def test_anomaly_eval_fixture_all_ones(spark):
    rows = list(zip(range(6), [0, 0, 0, 1, 1, 1], [.1, .2, .15, .8, .75, .9], [0, 0, 0, 1, 1, 1]))
    df = spark.createDataFrame(rows, "post_id long, label int, score double, prediction int")
    ev = anomaly.normalise_labels(df, "label", "prediction").withColumn("risk_score", F.col("score"))
    r = anomaly.supervised_metrics(ev).first()
    for k in ("precision", "recall", "f1_score", "roc_auc", "average_precision"):
        assert r[k] == 1.0
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (3, 0, 0, 3)


def test_auc_with_ties_matches_mann_whitney(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    s = rng.integers(0, 10, 200).astype(float) + y
    df = spark.createDataFrame([(int(a), float(b), int(a)) for a, b in zip(y, s)], "y_true int, risk_score double, y_pred int")
    r = anomaly.supervised_metrics(df).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-6)


def test_metrics_of_more_pairs_than_an_integer_counts(spark):
    df = spark.range(120_000).selectExpr("int(id % 2) y_true", "double(id % 2) risk_score", "int(id % 2) y_pred")
    r = anomaly.supervised_metrics(df).first()
    assert (r["roc_auc"], r["average_precision"], r["tp"], r["tn"]) == (1.0, 1.0, 60_000, 60_000)


def test_planted_outliers_score_lowest(spark):
    rng = np.random.default_rng(7)
    normal = rng.normal(0, 1, size=(1000, 10))
    far = rng.normal(8, 1, size=(10, 10))
    x = np.vstack([normal, far])
    cols = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "post_id long, " +
                               ", ".join(f"{c} double" for c in cols))
    nodes, psi = anomaly.fit_isolation_forest(df, cols, n_trees=100)
    scored = anomaly.score_isolation_forest(df, cols, nodes, psi)
    lowest = [r["post_id"] for r in scored.orderBy("anomaly_score").limit(10).collect()]
    assert set(lowest) == set(range(1000, 1010))
    assert scored.where("anomaly_label = -1 and post_id >= 1000").count() == 10


def test_reasons_and_summary_without_anomalies(spark):
    df = spark.createDataFrame([(1, 5.0, 0.9, 0.1, 10, 1), (2, 1.0, 0.1, 0.1, 10, -1)],
                               "post_id long, engagement_velocity double, misinformation_probability double, "
                               "toxicity_score double, follower_count long, anomaly_label int")
    thr = {"engagement_velocity": 2.0, "misinformation_probability": 0.5, "toxicity_score": 0.5, "follower_count": 100}
    out = {r["post_id"]: r["anomaly_reason"] for r in anomaly.reasons(df, thr).collect()}
    assert out[1] == "normal behavior"
    assert out[2] == "unusual multivariate behavior across account and post metrics"
    df2 = df.withColumn("anomaly_label", F.lit(-1))
    out2 = {r["post_id"]: r["anomaly_reason"] for r in anomaly.reasons(df2, thr).collect()}
    assert out2[1] == "abnormal engagement spike; high misinformation probability"
    s = anomaly.summary(df.withColumn("anomaly_label", F.lit(1)).withColumn("anomaly_score", F.lit(0.1))).first()
    assert s["anomaly_count"] == 0 and s["anomaly_percentage"] == 0.0


def test_every_tree_draws_psi_rows_from_all_rows(spark):
    n = 5_000
    df = spark.range(n).selectExpr("id as post_id", "cast(id as double) as x")
    samples, psi = anomaly.tree_samples(df, ["x"], n_trees=60, max_samples=64)
    parts = {}
    for r in samples.collect():
        parts.setdefault(r["tree_id"], []).append((r["draw"], r["x"]))
    assert psi == 64 and len(parts) == 60
    drawn = {t: sorted(v)[:psi] for t, v in parts.items()}
    assert all(len({x for _, x in v}) == psi for v in drawn.values())
    every = {x for v in drawn.values() for _, x in v}
    assert len(every) > 0.45 * n  # 60 x 64 draws out of 5,000 rows leave about 46 % of them out
    again, _ = anomaly.tree_samples(df.repartition(11), ["x"], n_trees=60, max_samples=64)
    other = {}
    for r in again.collect():
        other.setdefault(r["tree_id"], []).append((r["draw"], r["x"]))
    assert {t: sorted(v)[:psi] for t, v in other.items()} == drawn
    small, psi = anomaly.tree_samples(df.limit(10), ["x"], n_trees=3)
    assert psi == 10 and small.count() == 30
