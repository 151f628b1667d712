"""Segmentation (CLU-01..13, AGG-08), on all rows.

Cluster-quality measures are linear-time: inertia, Calinski-Harabasz and Davies-Bouldin are aggregates, and the
silhouette uses squared Euclidean distance, for which the mean distance of a row to a cluster follows from the
cluster's size, mean and mean square norm. K-Means fits for every K and restart share each scan: one job per
Lloyd iteration sums all models' clusters per task, and only the cluster sums reach the driver. Density
clustering is in ``density``; a table of grid cells gives an overview of where the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlab.functions.exprs import bounded_broadcast
from postlab.operators.density import dbscan, default_min_samples
from postlab.operators.prep import subsample
from postlab.schema import (CLUSTER_NARRATIVE_PREFIX, CLUSTER_TRAITS, KMEANS_N_INIT_LARGE, KMEANS_N_INIT_SMALL,
                            KMEANS_N_INIT_ROWS)
from postlab.session import written

MAX_LABELS_BROADCAST = 100_000
#: Rows drawn by hash from which all k-means++ starts are chosen; the fits themselves read every row.
SEED_ROWS = 2_000
#: Rows whose distances to all models' centers are held at once.
BLOCK_ROWS = 2_048


# ------------------------------------------------------------------ linear-time metrics
def cluster_metrics(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """CLU-05/06/07/08: one row (n, k, inertia, calinski_harabasz_score, davies_bouldin_index).

    Null metrics when fewer than 2 labels or fewer than 4 rows.
    """
    x = [F.col(c).cast("double") for c in cols]
    cents = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"),
                                  *[F.avg(v).alias(f"__c{i}") for i, v in enumerate(x)])
    cents = bounded_broadcast(cents, MAX_LABELS_BROADCAST)
    d2 = sum(((F.col(c).cast("double") - F.col(f"__c{i}")) ** 2 for i, c in enumerate(cols)), F.lit(0.0))
    within = (df.select(label, *cols).join(cents, label)
              .groupBy(label).agg(F.sum(d2).alias("__w"), F.avg(F.sqrt(d2)).alias("__s")))
    per = cents.join(within, label)
    glob = df.agg(*[F.avg(v).alias(f"__g{i}") for i, v in enumerate(x)]).first()  # one row of scalars
    b2 = sum(((F.col(f"__c{i}") - F.lit(glob[f"__g{i}"])) ** 2 for i in range(len(cols))), F.lit(0.0))
    totals = per.agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("__w").alias("inertia"),
                     F.sum(F.col("__n") * b2).alias("__b"))
    # Davies-Bouldin over pairs of clusters: a k x k join of the k-row centroid table
    a = per.select(F.col(label).alias("__la"), F.col("__s").alias("__sa"),
                   *[F.col(f"__c{i}").alias(f"__a{i}") for i in range(len(cols))])
    b = per.select(F.col(label).alias("__lb"), F.col("__s").alias("__sb"),
                   *[F.col(f"__c{i}").alias(f"__b{i}") for i in range(len(cols))])
    dist = F.sqrt(sum(((F.col(f"__a{i}") - F.col(f"__b{i}")) ** 2 for i in range(len(cols))), F.lit(0.0)))
    r = F.when(dist == 0, F.lit(0.0)).otherwise((F.col("__sa") + F.col("__sb")) / dist)
    db = (a.join(b, F.col("__la") != F.col("__lb")).groupBy("__la").agg(F.max(r).alias("__r"))
          .agg(F.avg("__r")).first()[0])
    ok = (F.col("k") >= 2) & (F.col("n") >= 4)
    ch = (F.col("__b") / (F.col("k") - 1)) / (F.col("inertia") / (F.col("n") - F.col("k")))
    return totals.withColumn("davies_bouldin_index", F.lit(db).cast("double")).select(
        F.col("n").cast("bigint").alias("n"), F.col("k").cast("bigint").alias("k"),
        F.when(ok, F.round("inertia", 3)).alias("inertia"),
        F.when(ok, F.round(F.when(F.col("inertia") == 0, F.lit(1.0)).otherwise(ch), 4)).alias("calinski_harabasz_score"),
        F.when(ok, F.col("davies_bouldin_index")).alias("davies_bouldin_index"))


def metric_values(df: DataFrame, label: str, cols: list[str]) -> dict:
    return cluster_metrics(df, label, cols).first().asDict()


# ------------------------------------------------------------------ silhouette
def silhouette(df: DataFrame, label: str, cols: list[str]) -> float | None:
    """CLU-04: mean silhouette with squared Euclidean distance over all rows; rows of singleton clusters score 0,
    fewer than 2 labels or 4 rows give None.

    Two scans: cluster sums (one row per label reaches the driver), then the score of each row against them."""
    x = [F.col(c).cast("double") for c in cols]
    norm = sum((v * v for v in x), F.lit(0.0))
    stats = df.groupBy(F.col(label).cast("long").alias("l")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(norm).alias("q"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)])
    rows = stats.orderBy("l").limit(MAX_LABELS_BROADCAST + 1).collect()
    if len(rows) > MAX_LABELS_BROADCAST:
        raise ValueError(f"more than {MAX_LABELS_BROADCAST} labels")
    if len(rows) < 2 or sum(r["n"] for r in rows) < 4:
        return None
    labels = np.array([r["l"] for r in rows])
    size, square = np.array([r["n"] for r in rows]), np.array([r["q"] for r in rows])
    mean = np.array([[r[f"m{i}"] for i in range(len(cols))] for r in rows])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, pts = np.searchsorted(labels, pdf["l"].to_numpy()), pdf[cols].to_numpy(np.float64)
            at = np.arange(len(pts))
            dist = np.maximum((pts * pts).sum(1)[:, None] + square - 2 * pts @ mean.T, 0.0)
            a = dist[at, own] * size[own] / np.maximum(size[own] - 1, 1)
            dist[at, own] = np.inf
            b = dist.min(1)
            top = np.maximum(a, b)
            yield pd.DataFrame({"s": np.where((size[own] == 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top))})

    picked = df.select(F.col(label).cast("long").alias("l"), *[v.alias(c) for v, c in zip(x, cols, strict=True)])
    return float(picked.mapInPandas(score, "s double").agg(F.avg("s")).first()[0])


# ------------------------------------------------------------------ K-Means
def n_restarts(n: int) -> int:
    """CLU-02: restart count of the reference (10 above 10,000 rows, else 20)."""
    return KMEANS_N_INIT_LARGE if n > KMEANS_N_INIT_ROWS else KMEANS_N_INIT_SMALL


def _spread_start(pool: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ start from the pool."""
    rng = np.random.default_rng(seed)
    out = [pool[rng.integers(len(pool))]]
    near = ((pool - out[0]) ** 2).sum(1)
    for _ in range(1, k):
        total = near.sum()
        pick = rng.choice(len(pool), p=near / total) if total > 0 else rng.integers(len(pool))
        out.append(pool[pick])
        near = np.minimum(near, ((pool - pool[pick]) ** 2).sum(1))
    return np.array(out)


def lloyd(df: DataFrame, cols: list[str], starts: list[np.ndarray], max_iter: int = 30, tol: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """K-Means from each start over all rows: (centers, cost) per start.

    All models still moving share one scan per iteration; a task returns one row per model and cluster."""
    d, names = len(cols), [f"s{i}" for i in range(len(cols))]
    points = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    centers, cost, moving = [s.copy() for s in starts], [float("inf")] * len(starts), list(range(len(starts)))
    for step in range(max_iter + 1):
        if not moving:
            break
        now = {m: centers[m] for m in moving}

        def sums(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            # models of equal K stand together: center 0 of each, center 1 of each ...
            by_k: dict[int, list[int]] = {}
            for m, c in now.items():
                by_k.setdefault(len(c), []).append(m)
            every = np.concatenate([np.stack([now[m] for m in ms], 1).reshape(-1, d) for ms in by_k.values()])
            turned, square_of = -2.0 * every, (every * every).sum(1)[:, None]
            held, spent = np.zeros((len(every), d + 1)), {k: np.zeros(len(ms)) for k, ms in by_k.items()}
            room, hot_room = np.empty(len(every) * BLOCK_ROWS), np.empty(len(every) * BLOCK_ROWS)
            for pdf in batches:
                whole = pdf.to_numpy(np.float64)
                for at in range(0, len(whole), BLOCK_ROWS):
                    x = whole[at:at + BLOCK_ROWS]
                    square, shape = (x * x).sum(1), (len(every), len(x))
                    dist, hot = (r[:shape[0] * shape[1]].reshape(shape) for r in (room, hot_room))
                    np.matmul(turned, x.T, out=dist)  # all models' centers in one product, short of |x|^2
                    dist += square_of
                    start = 0
                    for k, ms in by_k.items():
                        part, mark = (a[start:start + k * len(ms)].reshape(k, len(ms), -1) for a in (dist, hot))
                        best, label = part[0].copy(), np.zeros(part[0].shape, np.int32)
                        for c in range(1, k):
                            np.copyto(label, c, where=part[c] < best)
                            np.minimum(best, part[c], out=best)
                        for c in range(k):
                            np.equal(label, c, out=mark[c], casting="unsafe")
                        spent[k] += np.maximum(best + square, 0.0).sum(1)
                        start += k * len(ms)
                    held += hot @ np.column_stack([np.ones(len(x)), x])
            start = 0
            for k, ms in by_k.items():
                for j, m in enumerate(ms):
                    out = pd.DataFrame(held[start + j:start + k * len(ms):len(ms)], columns=["n", *names]).assign(cost=0.0, model=m, cluster=np.arange(k))
                    out.loc[0, "cost"] = spent[k][j]
                    yield out[["n", "cost", *names, "model", "cluster"]]
                start += k * len(ms)

        schema = "n double, cost double, " + ", ".join(f"{n} double" for n in names) + ", model int, cluster int"
        total = points.mapInPandas(sums, schema).groupBy("model", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *names)])
        got: dict[int, list] = {}
        for r in total.collect():  # one row per model and cluster
            got.setdefault(r["model"], []).append(r)
        still = []
        for m in moving:
            cost[m] = sum(r["cost"] for r in got.get(m, []))
            new = centers[m].copy()
            for r in got.get(m, []):
                if r["n"]:
                    new[r["cluster"]] = [r[n] / r["n"] for n in names]
            if step < max_iter and ((new - centers[m]) ** 2).sum(1).max() > tol ** 2:
                centers[m] = new
                still.append(m)
        moving = still
    return list(zip(centers, cost, strict=True))


def fit_kmeans(df: DataFrame, cols: list[str], ks: list[int], seed: int = 42, restarts: int | None = None,
               key: str = "post_id") -> dict[int, tuple[np.ndarray, float]]:
    """CLU-01/03: per K the cheapest of ``restarts`` fits (rule CLU-02 by default), all on every row."""
    n = df.count()
    restarts = restarts or n_restarts(n)
    pool = np.array([list(r) for r in subsample(df, SEED_ROWS, seed, key).select(*[F.col(c).cast("double") for c in cols]).collect()])
    jobs = [(k, r) for k in ks for r in range(restarts)]
    fits = lloyd(df, cols, [_spread_start(pool, k, seed * 1_000 + 31 * k + r) for k, r in jobs])
    best: dict[int, tuple[np.ndarray, float]] = {}
    for (k, _), fit in zip(jobs, fits, strict=True):
        if k not in best or fit[1] < best[k][1]:
            best[k] = fit
    return best


def assign(df: DataFrame, cols: list[str], centers: np.ndarray, label: str = "cluster") -> DataFrame:
    """``df`` with the number of the nearest center, as one projection."""
    dist = [sum(((F.col(c).cast("double") - F.lit(float(v))) ** 2 for c, v in zip(cols, row, strict=True)), F.lit(0.0)) for row in centers]
    pairs = F.array(*[F.struct(x.alias("d"), F.lit(i).alias("i")) for i, x in enumerate(dist)])
    return df.withColumn(label, F.array_min(pairs)["i"])


def renumber_by_size(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Stable cluster ids: 0 = largest cluster (ties by old id)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    mapping = sizes.select(label, (F.row_number().over(Window.orderBy(F.desc("__n"), label)) - 1)
                           .cast("int").alias("__new"))
    mapping = bounded_broadcast(mapping, MAX_LABELS_BROADCAST)
    return df.join(mapping, label).drop(label).withColumnRenamed("__new", label)


def scan_range(n: int, max_k: int = 10) -> list[int]:
    return list(range(2, min(max_k, n - 1) + 1))


def k_scan(scaled: DataFrame, cols: list[str], seed: int = 42, max_k: int = 10, restarts: int | None = None,
           fits: dict | None = None) -> DataFrame:
    """CLU-01: K = 2..min(max_k, n-1) on all rows: inertia and silhouette per K. ``fits`` are models of
    :func:`fit_kmeans` that the scan, the final labels and the comparison may share."""
    spark, n = scaled.sparkSession, scaled.count()
    rows = []
    for k, (centers, cost) in sorted((fits or fit_kmeans(scaled, cols, scan_range(n, max_k), seed, restarts)).items()):
        rows.append((k, cost, silhouette(assign(scaled, cols, centers), "cluster", cols), False, n))
    return spark.createDataFrame(rows, "k int, inertia double, silhouette_score double, silhouette_sampled boolean, "
                                       "silhouette_sample_size long")


def best_k(scores: DataFrame) -> int | None:
    """TOP-05: K with the highest silhouette (ties: smaller K)."""
    r = scores.where(F.col("silhouette_score").isNotNull()).orderBy(F.desc("silhouette_score"), "k").first()
    return None if r is None else int(r["k"])


def cluster_profile(clustered: DataFrame, label: str = "cluster") -> DataFrame:
    """AGG-08: size and four means per cluster."""
    return (clustered.groupBy(label)
            .agg(F.count(F.lit(1)).alias("cluster_size"),
                 F.avg("engagement_velocity").alias("engagement_velocity"),
                 F.avg("misinformation_probability").alias("misinformation_probability"),
                 F.avg("credibility_score").alias("credibility_score"),
                 F.avg("toxicity_score").alias("toxicity_score"))
            .orderBy(label))


def narrative(profile: DataFrame, global_means: DataFrame) -> DataFrame:
    """CLU-12: segment description from strict '>' comparisons with the global means (one-row frame); means that differ
    by less than 1e-9 are equal, as the order of summation decides no more than that."""
    g = global_means.first()  # one row of scalars
    traits = []
    for c, above, below in CLUSTER_TRAITS:
        cond = F.round(c, 9) > F.round(F.lit(g[c]), 9)
        traits.append(F.when(cond, F.lit(above)) if below is None else F.when(cond, F.lit(above)).otherwise(below))
    text = F.concat(F.lit(CLUSTER_NARRATIVE_PREFIX), F.concat_ws(", ", *traits), F.lit("."))
    return profile.withColumn("interpretation", text)


# ------------------------------------------------------------------ overview of dense cells
#: Coordinates that make the overview grid.
DENSITY_AXES = 3


def density_cells(df: DataFrame, cols: list[str], eps: float = 0.75, min_samples: int | None = None) -> DataFrame:
    """Cells of width ``eps`` over the first DENSITY_AXES columns: (g0, g1, g2, n, dense). A cell is dense with at least
    ``min_samples`` rows (2 % of the rows, between 3 and 50, by default)."""
    if min_samples is None:
        min_samples = default_min_samples(df.count())
    axes = [F.floor(F.col(c).cast("double") / eps).cast("int").alias(f"g{i}") for i, c in enumerate(cols[:DENSITY_AXES])]
    return df.groupBy(*axes).agg(F.count(F.lit(1)).alias("n")).withColumn("dense", F.col("n") >= min_samples)


# ------------------------------------------------------------------ comparison (CLU-09/10)
def bisecting(scaled: DataFrame, k: int, seed: int = 42, features: str = "features_scaled") -> DataFrame:
    """CLU-10 (re-aimed): top-down hierarchical clustering of all rows."""
    return BisectingKMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(scaled).transform(scaled)


def compare_models(scaled: DataFrame, cols: list[str], seed: int = 42, cluster_count: int | None = None,
                   restarts: int | None = None, key: str = "post_id", fits: dict | None = None) -> DataFrame:
    """K-Means, hierarchical (bisecting k-means, top-down) and density clustering, each on all rows; one row each;
    exactly one ``is_best`` when any silhouette exists."""
    from postlab.operators.eda import best_by_ranking

    spark, n = scaled.sparkSession, scaled.count()
    if cluster_count is None:
        cluster_count = min(4, max(2, min(n - 1, 6)))

    def metrics_row(labeled, label, name, k, inertia=None):
        labeled = labeled.select(label, *cols)
        met, sil = metric_values(labeled, label, cols), silhouette(labeled, label, cols)
        return (name, int(k), sil, met["davies_bouldin_index"], met["calinski_harabasz_score"], inertia, False, n, None)

    centers, cost = (fits or fit_kmeans(scaled, cols, [cluster_count], seed, restarts, key))[cluster_count]
    # K-Means and bisecting labels are projections that each scan makes anew; a join of labels is not
    dense = written(scaled.select(key, *cols).join(dbscan(scaled, cols, key=key), key).select("dbscan_cluster", *cols))
    labels = dense.agg(F.count_distinct("dbscan_cluster")).first()[0]
    rows = [metrics_row(assign(scaled, cols, centers), "cluster", "K-Means", cluster_count, cost),
            metrics_row(bisecting(scaled, cluster_count, seed), "cluster", "Hierarchical (bisecting k-means)", cluster_count),
            metrics_row(dense, "dbscan_cluster", "DBSCAN", labels)]
    comp = spark.createDataFrame(rows, "model_name string, cluster_count int, silhouette_score double, "
                                       "davies_bouldin_index double, calinski_harabasz_score double, inertia double, "
                                       "silhouette_sampled boolean, silhouette_sample_size long, skipped_reason string")
    return best_by_ranking(comp.withColumn("subsampled", F.lit(False)))


def final_clusters(scaled: DataFrame, cols: list[str], k: int, seed: int = 42, restarts: int | None = None,
                   fits: dict | None = None) -> DataFrame:
    """CLU-03: K-Means on all rows; ``cluster`` renumbered by size (0 = largest)."""
    centers, _ = (fits or fit_kmeans(scaled, cols, [k], seed, restarts))[k]
    return renumber_by_size(assign(scaled, cols, centers), "cluster")
