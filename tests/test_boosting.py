import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from postlab.operators import boosting
from postlab.operators.prep import preprocessing_stages
from postlab.operators.supervised import make_regressor

PARAMS = {"n_estimators": 6, "max_depth": 4, "learning_rate": 0.3, "colsample_bytree": 1.0, "subsample": 1.0}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x, kind, other = rng.normal(size=(1500, 3)), rng.choice(list("pqrst"), 1500), rng.choice(["u", "v"], 1500)
    y = 2 * x[:, 0] * (kind == "q") + np.where(x[:, 1] > 0.3, x[:, 2], -1.0) + (other == "v") * x[:, 0] + rng.normal(size=1500) / 10
    rows = [(i, *map(float, r), float(i % 3), str(k), str(o), float(t)) for i, (r, k, o, t) in enumerate(zip(x, kind, other, y))]
    rows[5] = (5, None, 1.0, 2.0, None, None, "u", 0.0)
    df = spark.createDataFrame(rows, "post_id long, a double, b double, c double, d double, kind string, other string, label double").repartition(3)
    stages = preprocessing_stages(["a", "b", "c", "d"], ["kind", "other"])
    return Pipeline(stages=stages).fit(df).transform(df).select("post_id", "label", "features").persist()


def test_same_trees_as_spark_ml(vectors):
    own = make_regressor(3, PARAMS)
    theirs = GBTRegressor(**{p.name: v for p, v in own._paramMap.items()})
    a, b = own.fit(vectors), theirs.fit(vectors)
    assert a.getNumTrees == b.getNumTrees and a.treeWeights == b.treeWeights and a.numFeatures == b.numFeatures
    both = a.transform(vectors).join(b.transform(vectors).select("post_id", F.col("prediction").alias("p")), "post_id")
    assert both.agg(F.max(F.abs(F.col("prediction") - F.col("p")))).first()[0] < 1e-9
    assert np.allclose(a.featureImportances.toArray().sum(), 1)
    # features that part the rows of a small node alike may stand for each other
    assert np.allclose(a.featureImportances.toArray()[:9], b.featureImportances.toArray()[:9], atol=5e-3)
    assert a.extractParamMap()[a.getParam("maxIter")] == 6


def test_a_text_costs_one_slot_a_row_whatever_its_values(vectors):
    from pyspark.ml.functions import vector_to_array
    groups = vectors.schema["features"].metadata["ml_attr"]["attrs"]
    data = vectors.select("label", vector_to_array("features").alias("x"))
    layout, n_features = make_regressor(3, PARAMS)._layout(data, 1500, [a["idx"] for a in groups["binary"]])
    assert n_features == 11 and len(layout.numeric) == 4 and len(layout.binary) == 7
    for r in boosting.binned(data, layout, 2).collect():
        assert len(r.bins) == 4 * r.n and len(r.slots) == 2 * 2 * r.n


def test_subsets_are_those_of_the_seed(vectors):
    params = {**PARAMS, "subsample": 0.7, "colsample_bytree": 0.6, "n_estimators": 27}
    a, b, c = (make_regressor(s, params).fit(vectors) for s in (3, 3, 4))
    got = [[r[0] for r in m.transform(vectors).orderBy("post_id").select("prediction").collect()] for m in (a, b, c)]
    assert got[0] == got[1] and got[0] != got[2]
    y = np.array([r[0] for r in vectors.orderBy("post_id").select("label").collect()])
    assert np.mean((y - got[0]) ** 2) < 0.2 * y.var()


def test_constant_labels_give_one_leaf(vectors):
    m = make_regressor(3, PARAMS).fit(vectors.withColumn("label", F.lit(0.3)))
    assert [r[0] for r in m.transform(vectors).select(F.round("prediction", 12)).distinct().collect()] == [0.3]
    assert all(t.numNodes == 1 for t in m.trees)
    with pytest.raises(ValueError):
        make_regressor(3, PARAMS).fit(vectors.limit(0))


def test_models_together_equal_models_one_by_one_and_dealt_among_tasks(vectors, monkeypatch):
    several = [make_regressor(3, {**PARAMS, "max_depth": d, "n_estimators": n, "subsample": 0.8}) for d, n in ((4, 5), (2, 28), (3, 1))]

    def told(models):
        return [[r[0] for r in m.transform(vectors).orderBy("post_id").select("prediction").collect()] for m in models]

    together = told(boosting.fit_together(several, vectors))
    assert np.allclose(together[1], told([several[1].fit(vectors)])[0], atol=1e-9)
    monkeypatch.setattr(boosting, "ALONE_ROWS", 0)
    monkeypatch.setattr(boosting, "ONE_TASK_ROWS", 0)
    monkeypatch.setattr(boosting, "MIN_TASK_ROWS", 1500)  # one task, so that its chunks and draws are the same
    for a, b in zip(together, told(boosting.fit_together(several, vectors)), strict=True):
        assert np.allclose(a, b, atol=1e-9)


def test_a_models_task_starts_no_job_for_each_level(vectors, spark):
    spark.sparkContext.setJobGroup("boosted", "one fit")
    try:
        boosting.fit_together([make_regressor(3, {**PARAMS, "n_estimators": 40})], vectors)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 40
