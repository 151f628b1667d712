import numpy as np
from pyspark.sql import functions as F

from postlab.operators import supervised


def test_planted_signal_is_top_driver(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = 3 * x[:, 0] + 0.1 * rng.normal(size=600)
    cats = np.where(x[:, 1] > 0, "hi", "lo")
    df = spark.createDataFrame([(i, *map(float, r), str(c), float(t)) for i, (r, c, t) in enumerate(zip(x, cats, y))],
                               "post_id long, a double, b double, c double, d double, k string, label double")
    model, best, draws = supervised.tune(df, ["a", "b", "c", "d"], ["k"], n_draws=1, folds=2)
    assert len(draws) == 1 and 0 < best < 1.0
    assert supervised.regression_metrics(model.transform(df)).first()["r2"] > 0.95
    perm = supervised.permutation_importance(model, df, ["a", "b", "c", "d", "k"], repeats=2)
    assert perm.orderBy(F.desc("permutation_importance")).first()["feature"] == "a"
    drivers = supervised.signed_drivers(model, df, perm, ["a", "b", "c", "d"], ["k"])
    top = drivers.first()
    assert top["feature"] == "a" and top["directional_effect"] > 0
    assert "a" in supervised.recommendation("credibility_score", drivers)


def test_permutation_steps_are_permutations_of_n_alone():
    for n in (1, 2, 7, 12, 600, 7919, 104729):
        for a, b in supervised.permutation_steps(n, 5):
            assert np.gcd(a, n) == 1 and 0 <= b < n
            if n < 1000:
                assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def test_permutation_importance_against_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 2)), rng.normal(size=60)

    class Line:
        def transform(self, df):
            return df.withColumn("prediction", 2 * F.col("a") - F.col("b"))

    df = spark.createDataFrame([(100 - i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "post_id long, a double, b double, label double")
    got = {r["feature"]: r["permutation_importance"] for r in supervised.permutation_importance(Line(), df, ["a", "b"], 3).collect()}
    x, y, n = x[::-1], y[::-1], 60  # along the key

    def rmse(a, b):
        return np.sqrt(np.mean((2 * a - b - y) ** 2))

    at = np.arange(n)
    moved = [(s * at + t) % n for s, t in supervised.permutation_steps(n, 3)]
    whole = rmse(x[:, 0], x[:, 1])
    assert abs(got["a"] - np.mean([rmse(x[m, 0], x[:, 1]) - whole for m in moved])) < 1e-12
    assert abs(got["b"] - np.mean([rmse(x[:, 0], x[m, 1]) - whole for m in moved])) < 1e-12
    assert supervised.permutation_importance(Line(), df.limit(0), ["a", "b"], 3).count() == 0


def test_registered_training_is_the_whole_search(spark, monkeypatch):
    """Eight draws, two folds and the refit, five permutation repeats: what the pipeline does by default."""
    import inspect

    import __spark_entry__ as E

    seen = {}
    how = inspect.signature(supervised.train_target)

    def spy(*args, **kw):
        call = how.bind(*args, **kw)
        call.apply_defaults()
        seen.update(call.arguments)
        return {"metrics": spark.range(1).selectExpr("id AS mae", "0 AS training_seconds")}

    monkeypatch.setattr(supervised, "train_target", spy)
    assert E.queries()["sup_07_train_target"](spark, "/root/testdata/sf0.001").columns == ["mae"]
    assert (seen["n_draws"], seen["folds"], seen["repeats"]) == (8, 2, 5)
