"""Model explanation for any model with ``transform``: sampled-permutation Shapley values as one Spark job.
Boosted trees are explained exactly by ``contributions``; the summaries (SUP-10, SUP-11) here serve both.

For each explained row x and permutation m, hybrids z(m, 0..d) take the first j features of the
permutation from x and the rest from a background row b(m, x). All hybrids come from one explode
(JVM expressions over literal permutation tables), are scored by one ``model.transform``, and
consecutive predictions are differenced with ``lag``; the difference at position j belongs to the
j-th feature of the permutation. Per row the contributions add up exactly to
mean_m f(x) - f(b(m, x)). Rows to explain and background rows are hash samples of bounded size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlab.functions.exprs import bounded_broadcast
from postlab.operators.prep import subsample


def shapley_values(model, data: DataFrame, features: list[str], n_rows: int = 500, n_background: int = 100,
                   permutations: int = 20, seed: int = 42, key: str = "post_id") -> DataFrame:
    """(post_id, feature, contribution) for min(n_rows, n) hash-sampled rows."""
    spark = data.sparkSession
    d = len(features)
    rng = np.random.RandomState(seed)
    perms = [rng.permutation(d).tolist() for _ in range(permutations)]
    inv = [np.argsort(p).tolist() for p in perms]  # position of each feature in permutation m
    rows = subsample(data, n_rows, seed, key).select(key, *features)
    bg = subsample(data, n_background, seed + 1, key).select(*features)
    bg = bg.withColumn("__b", F.row_number().over(Window.orderBy(*features)) - 1)
    nb = max(bg.count(), 1)
    bg = bounded_broadcast(bg.select("__b", F.struct(*features).alias("__bg")), n_background)
    m_j = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(j).alias("j"))
                              for m in range(permutations) for j in range(d + 1)]))
    hyb = (rows.select("*", m_j.alias("__mj")).select("*", "__mj.m", "__mj.j")
           .withColumn("__b", F.pmod(F.xxhash64(F.col(key), F.col("m"), F.lit(seed)), F.lit(nb)))
           .join(bg, "__b"))
    inv_tab = F.array(*[F.array(*[F.lit(v) for v in row]) for row in inv])
    perm_tab = F.array(*[F.array(*[F.lit(v) for v in row]) for row in perms])
    swapped = {}
    for fi, c in enumerate(features):
        pos = F.element_at(F.element_at(inv_tab, F.col("m") + 1), fi + 1)
        swapped[c] = F.when(pos < F.col("j"), F.col(c)).otherwise(F.col("__bg")[c])
    hyb = hyb.withColumns(swapped).select(key, "m", "j", *features)
    scored = model.transform(hyb).select(key, "m", "j", "prediction")
    w = Window.partitionBy(key, "m").orderBy("j")
    diffs = (scored.withColumn("__d", F.col("prediction") - F.lag("prediction").over(w))
             .where(F.col("j") > 0)
             .withColumn("__fi", F.element_at(F.element_at(perm_tab, F.col("m") + 1), F.col("j"))))
    names = spark.createDataFrame(list(enumerate(features)), "__fi int, feature string")
    return (diffs.groupBy(key, "__fi").agg((F.sum("__d") / permutations).alias("contribution"))
            .join(F.broadcast(names), "__fi").select(key, "feature", "contribution"))


def mean_abs_importance(contrib: DataFrame) -> DataFrame:
    """SUP-10 summary: mean |contribution| per feature, sorted."""
    return (contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_shap"))
            .orderBy(F.desc("mean_abs_shap"), "feature"))


def dependence(contrib: DataFrame, data: DataFrame | None, feature: str, bins: int = 20, key: str = "post_id") -> DataFrame:
    """SUP-11: binned (feature value, mean contribution) for one feature; without ``data``, ``contrib`` has the values."""
    c = contrib.where(F.col("feature") == feature)
    if data is not None:
        c = c.join(data.select(key, F.col(feature).cast("double").alias("value")), key)
    rng = c.agg(F.min("value").alias("mn"), F.max("value").alias("mx")).first()
    mn, mx = rng["mn"], rng["mx"]
    b = F.lit(1) if mn is None or mx == mn else F.least(
        F.floor((F.col("value") - F.lit(mn)) / F.lit(mx - mn) * bins) + 1, F.lit(bins))
    return (c.groupBy(b.cast("int").alias("bin"))
            .agg(F.avg("value").alias("value"), F.avg("contribution").alias("mean_contribution"),
                 F.count(F.lit(1)).alias("n")).orderBy("bin"))
