import numpy as np

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from postlab.operators import explain


def test_shapley_additivity_and_linear_attribution(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.01 * rng.normal(size=300)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "post_id long, a double, b double, c double, label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"),
                             LinearRegression()]).fit(df)
    contrib = explain.shapley_values(model, df, ["a", "b", "c"], n_rows=40, n_background=1, permutations=4)
    # one background row: contributions of a linear model are exact and sum to f(x) - f(b)
    pred = model.transform(df).select("post_id", "prediction")
    sums = contrib.groupBy("post_id").agg(F.sum("contribution").alias("s")).join(pred, "post_id")
    bg_pred = sums.select((F.col("prediction") - F.col("s")).alias("fb")).distinct().collect()
    assert max(r[0] for r in bg_pred) - min(r[0] for r in bg_pred) < 1e-9
    imp = {r["feature"]: r["mean_abs_shap"] for r in explain.mean_abs_importance(contrib).collect()}
    assert imp["a"] > imp["b"] > imp["c"]
    dep = explain.dependence(contrib, df, "a", bins=5).collect()
    assert sum(r["n"] for r in dep) == 40
    assert dep[0]["mean_contribution"] < dep[-1]["mean_contribution"]
