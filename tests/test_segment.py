import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from postlab.operators import density, segment


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.RandomState(42)
    a = rng.normal(0, 0.3, size=(30, 2))
    b = rng.normal(4, 0.3, size=(30, 2))
    pts = np.vstack([a, b])
    rows = [(i, float(x), float(y), int(i >= 30)) for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "post_id long, x double, y double, truth int")
    return df.withColumn("features_scaled", array_to_vector(F.array("x", "y"))), pts


def _np_metrics(x, lab):
    ks = np.unique(lab)
    cents = np.array([x[lab == k].mean(0) for k in ks])
    g = x.mean(0)
    w = sum(((x[lab == k] - cents[i]) ** 2).sum() for i, k in enumerate(ks))
    b = sum((lab == k).sum() * ((cents[i] - g) ** 2).sum() for i, k in enumerate(ks))
    n, k = len(x), len(ks)
    s = np.array([np.sqrt(((x[lab == kk] - cents[i]) ** 2).sum(1)).mean() for i, kk in enumerate(ks)])
    r = []
    for i in range(k):
        r.append(max((s[i] + s[j]) / np.linalg.norm(cents[i] - cents[j]) for j in range(k) if j != i))
    return w, (b / (k - 1)) / (w / (n - k)), float(np.mean(r))


def _np_silhouette(x, lab):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == k].mean() for k in np.unique(lab) if k != lab[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_metrics_match_formulas(blobs):
    df, pts = blobs
    lab = np.array([i % 3 for i in range(len(pts))])
    labeled = df.withColumn("cluster", F.col("post_id") % 3)
    m = segment.metric_values(labeled, "cluster", ["x", "y"])
    w, ch, db = _np_metrics(pts, lab)
    assert m["inertia"] == pytest.approx(w, abs=1e-3)
    assert m["calinski_harabasz_score"] == pytest.approx(ch, abs=1e-3)
    assert m["davies_bouldin_index"] == pytest.approx(db, abs=1e-5)
    assert segment.silhouette(labeled, "cluster", ["x", "y"]) == pytest.approx(_np_silhouette(pts, lab), abs=1e-9)


def test_single_label_gives_null_metrics(blobs):
    df, _ = blobs
    m = segment.metric_values(df.withColumn("cluster", F.lit(0)), "cluster", ["x", "y"])
    assert m["inertia"] is None and m["davies_bouldin_index"] is None
    assert segment.silhouette(df.withColumn("cluster", F.lit(0)), "cluster", ["x", "y"]) is None


def test_blobs_recovered_and_one_best(blobs):
    df, _ = blobs
    scores = segment.k_scan(df, ["x", "y"], restarts=1, max_k=4)
    assert segment.best_k(scores) == 2
    comp = segment.compare_models(df, ["x", "y"], restarts=1, cluster_count=2).collect()
    assert len(comp) == 3 and sum(r["is_best"] for r in comp) == 1
    final = segment.final_clusters(df, ["x", "y"], 2, restarts=1)
    agree = final.groupBy("truth", "cluster").count().count()
    assert agree == 2  # each blob maps to exactly one cluster


def test_dbscan_two_blobs(blobs):
    df, _ = blobs
    lab = density.dbscan(df, ["x", "y"], eps=0.75, min_samples=3)
    got = lab.join(df, "post_id").groupBy("truth").agg(F.collect_set("dbscan_cluster").alias("s")).collect()
    sets = sorted(tuple(sorted(set(r["s"]) - {-1})) for r in got)  # thin rows are noise
    assert sets == [(0,), (1,)]
    assert lab.count() == 60 and lab.filter("dbscan_cluster >= 0").count() >= 45


def test_lloyd_of_several_k_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(4000, 3)), np.zeros((700, 3)), rng.integers(0, 3, (600, 3))])
    assert len(x) > 2 * segment.BLOCK_ROWS
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").coalesce(1)
    starts = [x[[0, 1]], x[[5, 9, 4100]], x[[3, 2]], np.zeros((3, 3)), x[[7]]]  # equal centers: the first takes all
    for start, (centers, cost) in zip(starts, segment.lloyd(df, ["a", "b", "c"], starts, max_iter=3, tol=0.0), strict=True):
        want = start.astype(float)
        for _ in range(3):
            label = ((x[:, None] - want) ** 2).sum(2).argmin(1)
            want = np.array([x[label == i].mean(0) if (label == i).any() else want[i] for i in range(len(want))])
        assert np.allclose(centers, want, atol=1e-9)
        assert np.isclose(cost, ((x[:, None] - want) ** 2).sum(2).min(1).sum())
