import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from postlab.operators import contributions, explain
from postlab.operators.prep import preprocessing_stages, subsample
from postlab.operators.supervised import make_regressor


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    kind = rng.choice(["p", "q", "r"], 400)
    y = 2 * x[:, 0] * (kind == "q") + np.where(x[:, 1] > 0.3, x[:, 2], -1.0)
    rows = [(i, *map(float, r), str(k), float(t)) for i, (r, k, t) in enumerate(zip(x, kind, y))]
    rows[5] = (5, None, 1.0, 2.0, None, 0.0)
    df = spark.createDataFrame(rows, "post_id long, a double, b double, c double, kind string, label double")
    params = {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.5, "colsample_bytree": 1.0, "subsample": 1.0}
    return df, Pipeline(stages=preprocessing_stages(["a", "b", "c"], ["kind"]) + [make_regressor(1, params)]).fit(df)


def test_equal_to_the_enumeration_of_all_subsets(spark, fitted):
    df, model = fitted
    got = contributions.tree_contributions(model, df, n_rows=7, n_background=5).collect()
    found = {(r.post_id, r.feature): r.contribution for r in got}
    names = list(dict.fromkeys(r.feature for r in got))
    assert len(names) == 6 and len(got) == 7 * 6

    def processed(rows):
        return {r.post_id: np.array(r.x) for r in model.transform(rows).select("post_id", vector_to_array("features").alias("x")).collect()}

    rows, back = processed(subsample(df, 7, 42)), processed(subsample(df, 5, 43))
    subsets = [s for n in range(7) for s in combinations(range(6), n)]
    mixed = [(i, j, k, [float(v) for v in np.where(np.isin(np.arange(6), s), rows[i], back[j])])
             for i in rows for j in back for k, s in enumerate(subsets)]
    scored = model.stages[-1].transform(spark.createDataFrame(mixed, "i long, j long, k int, x array<double>").withColumn("features", array_to_vector("x")))
    worth = {(r.i, r.k): r.v for r in scored.groupBy("i", "k").agg(F.avg("prediction").alias("v")).collect()}
    number = {s: k for k, s in enumerate(subsets)}
    for i in rows:
        for f, name in enumerate(names):
            want = sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / math.factorial(6)
                       * (worth[i, number[tuple(sorted((*s, f)))]] - worth[i, number[s]]) for s in subsets if f not in s)
            assert abs(found[i, name] - want) < 1e-10


def test_contributions_sum_to_the_prediction(fitted):
    df, model = fitted
    told = contributions.tree_contributions(model, df, n_rows=1000, n_background=30)
    sums = told.groupBy("post_id").agg(F.sum("contribution").alias("s"))
    pred = model.transform(df).select("post_id", "prediction")
    base = model.transform(subsample(df, 30, 43)).agg(F.avg("prediction")).first()[0]
    worst = sums.join(pred, "post_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("s") + base - F.col("prediction"))).alias("e")).first()
    assert worst.n == 400 and worst.e < 1e-9
    top = explain.mean_abs_importance(told).first()["feature"]
    assert sum(r["n"] for r in explain.dependence(told, None, top, bins=5).collect()) == 400
    assert contributions.tree_contributions(model, df.limit(0)).count() == 0


def test_one_leaf_gives_nothing():
    import pandas as pd
    nodes = pd.DataFrame([(0, 0, 0.7, -1, -1, -1, [], -1)], columns=["tree", "id", "prediction", "left", "right", "feature", "sides", "categories"])
    paths = contributions.path_table(nodes, [1.0])
    masks = paths.masks(np.zeros((2, 3)))
    assert contributions.contributions_of(paths, masks[0], masks, 3).tolist() == [0.0] * 3
