"""Supervised models and explanation (SUP-01..09, SUP-12).

Boosted trees are Spark ML ``GBTRegressor`` models, fitted by ``boosting`` inside one ``Pipeline`` with the preprocessing, so
cross-validation refits preprocessing per fold. XGBoost's L1/L2 leaf penalties (reg_alpha,
reg_lambda) have no GBTRegressor equivalent; those two grid axes are not drawn.
"""

from __future__ import annotations

import itertools
import math
import time

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.functions.exprs import bounded_broadcast, safe_corr
from postlab.operators.boosting import HistogramGBTRegressor, fit_together
from postlab.operators.prep import (check_categories, feature_target_split, fold_column, preprocessing_stages,
                                    processed_feature_names, train_test_split)
from postlab.operators.star import dense_index
from postlab.session import cut_lineage
from postlab.schema import GBT_DEFAULTS, GBT_SEARCH_SPACE, RECOMMENDATION_TEMPLATES


def make_regressor(seed: int = 42, params: dict | None = None) -> HistogramGBTRegressor:
    """SUP-01: squared-error boosted trees (defaults: 300 trees, depth 6, rate 0.05, row 0.9, column 0.9)."""
    p = {**GBT_DEFAULTS, **(params or {})}
    return HistogramGBTRegressor(featuresCol="features", labelCol="label", predictionCol="prediction", lossType="squared",
                                 maxIter=int(p["n_estimators"]), maxDepth=int(p["max_depth"]), stepSize=float(p["learning_rate"]),
                                 subsamplingRate=float(p["subsample"]), featureSubsetStrategy=str(p["colsample_bytree"]),
                                 seed=seed, maxBins=256, cacheNodeIds=True, maxMemoryInMB=512)


#: Leaf penalties that GBTRegressor does not have: drawing them would only repeat the same model.
UNSUPPORTED_AXES = ("reg_alpha", "reg_lambda")


def draw_params(n_draws: int = 8, seed: int = 42) -> list[dict]:
    """Seeded random draws without replacement from the product grid of the supported axes."""
    keys = [k for k in GBT_SEARCH_SPACE if k not in UNSUPPORTED_AXES]
    grid = list(itertools.product(*[GBT_SEARCH_SPACE[k] for k in keys]))
    idx = np.random.RandomState(seed).choice(len(grid), size=min(n_draws, len(grid)), replace=False)
    return [dict(zip(keys, grid[i])) for i in idx]


def regression_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """SUP-03: MAE, RMSE, R^2 in one aggregate."""
    e = F.col(pred) - F.col(label)
    agg = df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("__sse"),
                 (F.var_pop(label) * F.count(F.lit(1))).alias("__sst"))
    return agg.select(F.col("mae").alias("mae"), F.col("rmse").alias("rmse"),
                      (F.when(F.col("__sst") > 0, 1 - F.col("__sse") / F.col("__sst"))).alias("r2"))


def tune(train: DataFrame, num: list[str], cat: list[str], seed: int = 42, n_draws: int = 8, folds: int = 2,
         parallelism: int = 4):
    """SUP-02: random search with k-fold CV on hash folds; returns (refit best PipelineModel, best CV RMSE, draws).

    Same result as ``CrossValidator`` with these folds (mean validation RMSE per draw, best draw
    refitted on the whole training split), but the preprocessing is fitted once per fold, its vectors are
    checkpointed and their bins shared by all draws of the fold, which are fitted together and judged in one scan
    of the rows held back. Folds run concurrently.
    """
    from concurrent.futures import ThreadPoolExecutor

    check_categories(train, cat)
    draws = draw_params(n_draws, seed)
    data = fold_column(train, folds, seed)

    def vectors(fit_on: DataFrame, *frames: DataFrame):
        fitted = Pipeline(stages=preprocessing_stages(num, cat)).fit(fit_on)
        return fitted, [cut_lineage(fitted.transform(f).select("label", "features")) for f in frames]

    def fold_rmse(f: int) -> list[float]:
        rest = data.where(F.col("fold") != f)
        _, (rest, held) = vectors(rest, rest, data.where(F.col("fold") == f))
        for i, model in enumerate(fit_together([make_regressor(seed, d) for d in draws], rest)):
            held = model.setPredictionCol(f"prediction_{i}").transform(held)
        errors = [F.sqrt(F.avg((F.col(f"prediction_{i}") - F.col("label")) ** 2)) for i in range(len(draws))]
        return [math.nan if e is None else e for e in held.agg(*errors).first()]

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, folds))) as pool:
        scores = list(pool.map(fold_rmse, range(folds)))
    avg = [sum(s[k] for s in scores) / folds for k in range(len(draws))]
    best = min(range(len(draws)), key=lambda k: (avg[k], k))
    fitted, (whole,) = vectors(train, train)
    model = PipelineModel(stages=[*fitted.stages, make_regressor(seed, draws[best]).fit(whole)])
    return model, float(avg[best]), draws


def feature_importance(model, scored: DataFrame) -> DataFrame:
    """SUP-04: tree importances by processed feature name, sorted."""
    names = processed_feature_names(scored, "features")
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = scored.sparkSession
    rows = [(names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_steps(n: int, repeats: int) -> list[tuple[int, int]]:
    """(a, b) per repeat: row i takes the value of row (a i + b) mod n. ``a`` is the first number from 1 + 7919 (r + 1) mod n
    without a common factor with n, so every repeat is a permutation; b = 104729 (r + 1) mod n."""
    out = []
    for r in range(1, repeats + 1):
        a = 1 + 7919 * r % n
        while math.gcd(a, n) != 1:
            a += 1
        out.append((a, 104729 * r % n))
    return out


def permutation_importance(model, test: DataFrame, features: list[str], repeats: int = 5, key: str = "post_id") -> DataFrame:
    """SUP-05: mean RMSE increase when one raw column is permuted, ``repeats`` times per column.

    All test rows are used, with dense indexes 0..n-1 along the key. The steps of :func:`permutation_steps` depend on n
    alone, so reruns agree. Each row sends its features once a repeat to the index that takes them (the step's inverse),
    one shuffle gathers a row's partners, and one join brings them to it. All (feature, repeat) copies come from one explode
    and are scored by one transform. A test frame without rows gives no result.
    """
    idx = dense_index(test, [key], "__i", start=0)
    n = idx.count()
    if not n:
        return test.sparkSession.createDataFrame([], "feature string, permutation_importance double")
    sent = [F.struct(F.lit(r).alias("rep"), F.pmod((F.col("__i") - F.lit(b)) * F.lit(pow(a, -1, n) if n > 1 else 0), F.lit(n)).alias("to"))
            for r, (a, b) in enumerate(permutation_steps(n, repeats))]
    partners = idx.select(F.struct(*features).alias("__p"), F.explode(F.array(*sent)).alias("__s")).groupBy(F.col("__s.to").alias("__to")).agg(
        *[F.max_by("__p", F.when(F.col("__s.rep") == r, 1)).alias(f"__p{r}") for r in range(repeats)])
    base = idx.join(partners, F.col("__i") == F.col("__to"))
    combos = [(fi, r) for fi in range(len(features)) for r in range(repeats)]
    pick = F.explode(F.array(*[F.struct(F.lit(fi).alias("fi"), F.lit(r).alias("rep")) for fi, r in combos]))
    stacked = base.select("*", pick.alias("__c")).select("*", "__c.fi", "__c.rep")
    swapped = {}
    for fi, c in enumerate(features):
        alt = F.element_at(F.array(*[F.col(f"__p{r}")[c] for r in range(repeats)]), F.col("rep") + 1)
        swapped[c] = F.when(F.col("fi") == fi, alt).otherwise(F.col(c))
    stacked = stacked.withColumns(swapped).select("label", "fi", "rep", *features)
    scored = model.transform(stacked)
    e = F.col("prediction") - F.col("label")
    per = scored.groupBy("fi", "rep").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    base_rmse = model.transform(test).agg(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2))).first()[0]
    names = test.sparkSession.createDataFrame(list(enumerate(features)), "fi int, feature string")
    return (per.groupBy("fi").agg(F.avg(F.col("rmse") - F.lit(base_rmse)).alias("permutation_importance"))
            .join(F.broadcast(names), "fi").select("feature", "permutation_importance"))


#: Distinct values of a text column up to which their codes are broadcast; beyond, the join shuffles.
MAX_CODES_BROADCAST = 100_000


def signed_drivers(model, test: DataFrame, importance: DataFrame, num: list[str], cat: list[str],
                   floor_negative: bool = True) -> DataFrame:
    """SUP-06: importance x sign(corr(feature, prediction)), row-aligned (defect D2 fixed).

    Categories are correlated through their alphabetical codes (``is_nominal`` flags them); no or NaN
    correlation -> 0. ``floor_negative`` floors importances at 0 so noise is never a driver (D10)."""
    pred = model.transform(test).select(*num, *cat, "prediction")
    codes = {}
    for c in cat:

        vals = pred.select(c).where(F.col(c).isNotNull()).distinct()
        vals = dense_index(vals, [c], f"__code_{c}", start=0)
        pred = pred.join(bounded_broadcast(vals, MAX_CODES_BROADCAST), c, "left")
        codes[c] = f"__code_{c}"

    exprs = [safe_corr(c, "prediction").alias(c) for c in num]
    exprs += [safe_corr(codes[c], "prediction").alias(c) for c in cat]
    row = pred.agg(*exprs).first()
    spark = test.sparkSession
    corr = spark.createDataFrame([(c, None if row[c] is None or row[c] != row[c] else float(row[c]), c in cat)
                                  for c in num + cat], "feature string, correlation double, is_nominal boolean")
    imp = F.greatest(F.col("permutation_importance"), F.lit(0.0)) if floor_negative else F.col("permutation_importance")
    return (importance.join(corr, "feature")
            .withColumn("directional_effect", imp * F.coalesce(F.signum("correlation"), F.lit(0.0)))
            .orderBy(F.desc("directional_effect"), "feature"))


def recommendation(target: str, drivers: DataFrame) -> str:
    """SUP-12: sentence from the strongest positive and negative drivers."""
    r = drivers.agg(F.max_by("feature", "directional_effect").alias("pos"),
                    F.min_by("feature", "directional_effect").alias("neg")).first()
    tmpl = RECOMMENDATION_TEMPLATES.get(target, RECOMMENDATION_TEMPLATES["credibility_score"])
    return tmpl.format(pos=r["pos"], neg=r["neg"])


ROWS_PER_PARTITION = 1_000_000
MIN_ROWS_PER_TASK = 20_000


def train_target(data: DataFrame, target: str, seed: int = 42, n_draws: int = 8, folds: int = 2,
                 exclude_leaky: bool = True, repeats: int = 5, parallelism: int | None = None) -> dict:
    """SUP-07: split, tune, predict, score and explain one target; returns tables keyed by ``target``.

    The training frame is cached in partitions of at most about one million rows and at least
    ~20,000 rows: boosting runs one job per tree level per iteration, so tiny partitions only add
    scheduling latency, while at scale the partition count grows with the data. All draws of a
    fold (and the folds) are fitted together.
    """

    t0 = time.time()
    frame, num, cat = feature_target_split(data, target, exclude_leaky)
    n = frame.count()
    cores = frame.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(n / ROWS_PER_PARTITION), min(cores, math.ceil(n / MIN_ROWS_PER_TASK)), 1)
    frame = frame.repartition(parts).persist()
    parallelism = parallelism or max(1, min(folds, 8))
    train, test = train_test_split(frame, seed)
    model, best_cv, _draws = tune(train, num, cat, seed, n_draws, folds, parallelism)
    scored = model.transform(test)
    metrics = regression_metrics(scored).withColumns({
        "best_cv_rmse": F.lit(best_cv), "training_seconds": F.lit(round(time.time() - t0, 2)),
        "target": F.lit(target)})
    importance = feature_importance(model, scored).withColumn("target", F.lit(target))
    perm = cut_lineage(permutation_importance(model, test, num + cat, repeats))
    drivers = signed_drivers(model, test, perm, num, cat).withColumn("target", F.lit(target))
    predictions = scored.select("post_id", F.lit(target).alias("target"), F.col("label").alias("actual"),
                                F.col("prediction").alias("predicted"))
    # everything lazy is written before the training frame is released
    metrics, predictions, drivers = cut_lineage(metrics), cut_lineage(predictions), cut_lineage(drivers)
    frame.unpersist()
    return {"model": model, "metrics": metrics, "importance": importance, "drivers": drivers,
            "predictions": predictions, "recommendation": recommendation(target, drivers)}
