"""Anomaly detection (ANO-01..08, AGG-16/17, TOP-02).

Isolation forest (Liu, Ting and Zhou, 2008) as a Spark job:

1. *Sampling* - every row of the table takes part in the draw of every tree: a hash of its key and the tree orders the
   rows, and a tree takes the psi = min(256, n) smallest. Each task keeps the psi smallest it meets per tree, of those
   below a bound that about 2 psi rows of the table pass, and the tree's group keeps the psi smallest of what the tasks
   send: a mergeable sketch, one pass, about trees x 2 psi rows shuffled whatever the table's size.
2. *Fitting* - ``groupBy("tree_id").applyInPandas`` grows one isolation tree per group (psi rows).
3. *Scoring* - the node table (at most trees x (2psi - 1) rows, a bound fixed by the parameters)
   is broadcast and ``mapInPandas`` walks every row through all trees, vectorised per batch.

``anomaly_score = 0.5 - 2^(-E[h(x)] / c(psi))``: lower = more unusual; label -1 when below 0.
``risk_score = -anomaly_score`` is the column ranking metrics use (higher = more unusual).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlab.operators.stats import exact_quantiles, running_totals
from postlab.schema import ANOMALY_REASON_CHECKS, ANOMALY_REASON_FALLBACK, NORMAL_REASON

EULER = 0.5772156649
NODE_SCHEMA = ("tree_id int, node_id int, feature int, threshold double, left_child int, right_child int, "
               "size int, depth int")


def c_factor(n):
    """Average path length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(pdf: pd.DataFrame, cols: list[str], seed: int, max_depth: int) -> pd.DataFrame:
    """One isolation tree from one group of rows (random feature, uniform split between min and max)."""
    tree_id = int(pdf["tree_id"].iloc[0])
    x = pdf[cols].to_numpy(dtype=np.float64)
    rng = np.random.default_rng([seed, tree_id])
    nodes = []  # node_id, feature, threshold, left, right, size, depth
    stack = [(0, np.arange(len(x)), 0)]
    next_id = 1
    while stack:
        nid, idx, depth = stack.pop()
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes.append((nid, -1, 0.0, -1, -1, len(idx), depth))
            continue
        lo, hi = sub.min(0), sub.max(0)
        usable = np.nonzero(hi > lo)[0]
        if len(usable) == 0:
            nodes.append((nid, -1, 0.0, -1, -1, len(idx), depth))
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        if thr >= hi[f]:
            thr = float(lo[f])
        go_left = sub[:, f] <= thr
        left, right = next_id, next_id + 1
        next_id += 2
        nodes.append((nid, f, thr, left, right, len(idx), depth))
        stack.append((left, idx[go_left], depth + 1))
        stack.append((right, idx[~go_left], depth + 1))
    out = pd.DataFrame(nodes, columns=["node_id", "feature", "threshold", "left_child", "right_child", "size",
                                       "depth"])
    out.insert(0, "tree_id", tree_id)
    return out.astype({"tree_id": "int32", "node_id": "int32", "feature": "int32", "left_child": "int32",
                       "right_child": "int32", "size": "int32", "depth": "int32"})


def _tree_hashes(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A 64-bit hash of each (hashed) key for one tree."""
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    for multiply in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(multiply)
    return x ^ (x >> np.uint64(31))


def tree_samples(df: DataFrame, cols: list[str], n_trees: int = 300, max_samples: int = 256, seed: int = 42,
                 key: str = "post_id"):
    """Candidates of every tree's sample (tree_id, draw, cols...), the psi smallest draws of which are the sample, and psi."""
    n = df.count()
    psi = min(max_samples, n)
    bound = np.uint64(min((1 << 64) - 1, (1 << 64) * 2 * psi // max(n, 1)))

    def run(batches):
        held: list[pd.DataFrame | None] = [None] * n_trees
        for pdf in batches:
            keys = pdf["key_hash"].to_numpy(np.int64).view(np.uint64)
            for tree in range(n_trees):
                h = _tree_hashes(keys, seed, tree)
                at = np.flatnonzero(h <= bound)
                if not len(at):
                    continue
                one = pdf.iloc[at].drop(columns="key_hash").assign(draw=(h[at] >> np.uint64(1)).astype(np.int64))
                one = one if held[tree] is None else pd.concat([held[tree], one])
                held[tree] = one.nsmallest(psi, "draw") if len(one) > psi else one
        for tree, one in enumerate(held):
            if one is not None:
                yield one.assign(tree_id=np.int32(tree))[["tree_id", "draw", *cols]]

    rows = df.select(F.xxhash64(key).alias("key_hash"), *[F.col(c).cast("double").alias(c) for c in cols])
    return rows.mapInPandas(run, "tree_id int, draw long, " + ", ".join(f"`{c}` double" for c in cols)), psi


def fit_isolation_forest(df: DataFrame, cols: list[str], n_trees: int = 300, max_samples: int = 256,
                         seed: int = 42, key: str = "post_id") -> tuple[DataFrame, int]:
    """ANO-01: node table of the forest (a DataFrame) and psi."""
    samples, psi = tree_samples(df, cols, n_trees, max_samples, seed, key)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    nodes = samples.groupBy("tree_id").applyInPandas(
        lambda pdf: _grow(pdf.nsmallest(psi, "draw"), cols, seed, max_depth), NODE_SCHEMA)
    return nodes, psi


def _pack(nodes_pdf: pd.DataFrame, n_trees: int):
    width = int(nodes_pdf["node_id"].max()) + 1
    shape = (n_trees, width)
    feat = np.full(shape, -1, dtype=np.int64)
    thr = np.zeros(shape)
    left = np.zeros(shape, dtype=np.int64)
    right = np.zeros(shape, dtype=np.int64)
    plen = np.zeros(shape)
    t, nid = nodes_pdf["tree_id"].to_numpy(), nodes_pdf["node_id"].to_numpy()
    feat[t, nid] = nodes_pdf["feature"].to_numpy()
    thr[t, nid] = nodes_pdf["threshold"].to_numpy()
    left[t, nid] = nodes_pdf["left_child"].to_numpy()
    right[t, nid] = nodes_pdf["right_child"].to_numpy()
    plen[t, nid] = nodes_pdf["depth"].to_numpy() + c_factor(nodes_pdf["size"].to_numpy())
    return feat, thr, left, right, plen


def score_columns(df: DataFrame, path: str, psi: int) -> DataFrame:
    """ANO-02: ``anomaly_score`` = 0.5 - 2 ** (-mean path / c(psi)), ``anomaly_label`` (-1 below 0) and ``risk_score``."""
    denom = float(c_factor([psi])[0]) or 1.0
    score = 0.5 - F.pow(F.lit(2.0), -F.col(path) / denom)
    df = df.withColumn("anomaly_score", score)
    return df.withColumns({"anomaly_label": F.when(F.col("anomaly_score") < 0, -1).otherwise(1).cast("int"),
                           "risk_score": -F.col("anomaly_score")})


def score_isolation_forest(df: DataFrame, cols: list[str], nodes: DataFrame, psi: int, key: str = "post_id",
                           keep: list[str] | None = None) -> DataFrame:
    """ANO-02: ``anomaly_score``, ``anomaly_label`` (-1 / 1) and ``risk_score`` for every row."""
    spark = df.sparkSession
    nodes_pdf = nodes.toPandas()  # bounded: trees x (2 psi - 1) rows
    n_trees = int(nodes_pdf["tree_id"].max()) + 1
    packed = spark.sparkContext.broadcast(_pack(nodes_pdf, n_trees))
    max_depth = int(nodes_pdf["depth"].max())
    keep = keep or []

    def walk(it):
        feat, thr, left, right, plen = packed.value
        rows = np.arange(0)
        for pdf in it:
            x = pdf[cols].to_numpy(dtype=np.float64)
            m = len(x)
            if len(rows) != m:
                rows = np.arange(m)
            total = np.zeros(m)
            for t in range(feat.shape[0]):
                node = np.zeros(m, dtype=np.int64)
                ft, th, lf, rt = feat[t], thr[t], left[t], right[t]
                for _ in range(max_depth):
                    f = ft[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    v = x[rows, np.where(inner, f, 0)]
                    nxt = np.where(v <= th[node], lf[node], rt[node])
                    node = np.where(inner, nxt, node)
                total += plen[t][node]
            yield pdf[[key] + keep].assign(mean_path=total / feat.shape[0])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(key, *keep).schema.fields)
    scored = df.select(key, *keep, *cols).mapInPandas(walk, f"{fields}, mean_path double")
    return score_columns(scored, "mean_path", psi).drop("mean_path")


def reasons(df: DataFrame, thresholds: dict, label: str = "anomaly_label") -> DataFrame:
    """ANO-03: '; '-joined reasons for flagged rows (strict '> p95' checks in fixed order),
    fallback text when none holds, fixed text for normal rows."""
    parts = [F.when(F.col(c) > F.lit(thresholds[c]), F.lit(p)) for c, p in ANOMALY_REASON_CHECKS
             if c in df.columns and thresholds.get(c) is not None]
    joined = F.concat_ws("; ", *parts) if parts else F.lit("")
    text = F.when(joined == "", F.lit(ANOMALY_REASON_FALLBACK)).otherwise(joined)
    return df.withColumn("anomaly_reason", F.when(F.col(label) == -1, text).otherwise(F.lit(NORMAL_REASON)))


def reason_thresholds(imputed: DataFrame, p: float = 0.95) -> dict:
    cols = [c for c, _p in ANOMALY_REASON_CHECKS if c in imputed.columns]
    q = exact_quantiles(imputed, cols, [p])
    return {c: q[(c, p)] for c in cols}


def anomalies_sorted(scored: DataFrame) -> DataFrame:
    """TOP-02: flagged rows, most unusual first."""
    return scored.where(F.col("anomaly_label") == -1).orderBy("anomaly_score", "post_id")


def top_reasons(scored: DataFrame, k: int = 10) -> DataFrame:
    """AGG-16: most frequent reasons among flagged rows."""
    return (scored.where(F.col("anomaly_label") == -1).groupBy("anomaly_reason").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "anomaly_reason").limit(k))


def summary(scored: DataFrame, label: str = "anomaly_label", score: str = "anomaly_score",
            contamination=None) -> DataFrame:
    """AGG-17 / ANO-04: one-row summary; quantiles exact; std is the population std."""
    q = exact_quantiles(scored, [score], [0.25, 0.5, 0.75])
    base = scored.agg(F.count_if(F.col(label) == -1).alias("anomaly_count"), F.count(F.lit(1)).alias("total_records"),
                      F.min(score).alias("score_min"), F.max(score).alias("score_max"),
                      F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"))
    cnt, tot = F.col("anomaly_count"), F.col("total_records")
    cont = float(contamination) if isinstance(contamination, (int, float)) else None
    qv = [None if q[(score, p)] is None else float(q[(score, p)]) for p in (0.25, 0.5, 0.75)]
    return base.select(
        cnt.cast("bigint").alias("anomaly_count"), tot.cast("bigint").alias("total_records"),
        F.when(tot > 0, F.bround(cnt * 100.0 / tot, 2)).otherwise(F.lit(0.0)).alias("anomaly_percentage"),
        F.lit(cont).cast("double").alias("contamination_setting"),
        F.when(tot > 0, F.bround(cnt / tot, 4)).otherwise(F.lit(0.0)).alias("anomaly_ratio"),
        F.col("score_min").alias("score_min"), F.col("score_max").alias("score_max"),
        F.col("score_mean").alias("score_mean"), F.lit(qv[1]).cast("double").alias("score_median"),
        F.col("score_std").alias("score_std"), F.lit(qv[0]).cast("double").alias("score_p25"),
        F.lit(qv[2]).cast("double").alias("score_p75"))


def normalise_labels(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """ANO-05 input rules, applied to each side separately (defect D6 fixed): a side containing -1
    means -1 = anomaly; numeric 0/1 stays; text 'anomaly' = 1."""
    flags = df.agg(F.max((F.col(truth).cast("string") == "-1").cast("int")).alias("t"),
                   F.max((F.col(pred).cast("string") == "-1").cast("int")).alias("p")).first()

    def conv(c, minus):
        s = F.col(c).cast("string")
        if minus:
            return (s == "-1").cast("int")
        num = F.expr(f"try_cast({c} as double)")
        return F.when(num.isNotNull(), (num == 1).cast("int")).otherwise((s == "anomaly").cast("int"))
    return df.withColumns({"y_true": conv(truth, flags["t"]), "y_pred": conv(pred, flags["p"])})


def supervised_metrics(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", risk: str = "risk_score") -> DataFrame:
    """ANO-05: precision, recall, F1 (0 when undefined), confusion counts, ROC-AUC (tie-aware
    Mann-Whitney) and average precision over distinct thresholds; AUC/AP null for one class or a
    constant score. Higher ``risk`` = more anomalous."""
    counts = df.agg(F.count_if((F.col(truth) == 1) & (F.col(pred) == 1)).alias("tp"),
                    F.count_if((F.col(truth) == 0) & (F.col(pred) == 1)).alias("fp"),
                    F.count_if((F.col(truth) == 1) & (F.col(pred) == 0)).alias("fn"),
                    F.count_if((F.col(truth) == 0) & (F.col(pred) == 0)).alias("tn"),
                    F.count_distinct(risk).alias("n_scores"))
    by_score = df.groupBy(risk).agg(F.sum(F.col(truth)).cast("bigint").alias("pos"),
                                    F.sum(1 - F.col(truth)).cast("bigint").alias("neg"))
    cum = running_totals(by_score, [F.desc(risk)], ["pos", "neg"])  # inclusive, highest score first
    tot = by_score.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()  # scalars
    # doubles: the product of both counts passes the range of integers from some 100,000 rows on
    big_p, big_n = F.lit(float(tot["P"] or 0)), F.lit(float(tot["N"] or 0))
    rank = cum.agg(F.sum(F.col("pos") * ((big_n - F.col("cum_neg")) + 0.5 * F.col("neg"))).alias("a"),
                   F.sum(F.when(F.col("pos") > 0, (F.col("pos") / big_p) *
                                (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))))).alias("ap")).first()
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    valid = (big_p > 0) & (big_n > 0) & (F.col("n_scores") > 1)
    auc = F.lit(rank["a"]).cast("double") / (big_p * big_n)
    out = counts.select(
        prec.alias("precision"), rec.alias("recall"),
        F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1_score"),
        F.when(valid, auc).alias("roc_auc"),
        F.when(valid, F.lit(rank["ap"]).cast("double")).alias("average_precision"),
        F.col("tn").cast("bigint").alias("tn"), F.col("fp").cast("bigint").alias("fp"),
        F.col("fn").cast("bigint").alias("fn"), F.col("tp").cast("bigint").alias("tp"))
    return out


def curves(df: DataFrame, truth: str = "y_true", risk: str = "risk_score") -> DataFrame:
    """ANO-07: ROC and precision-recall points, one per distinct threshold (highest first)."""
    by_score = df.groupBy(risk).agg(F.sum(F.col(truth)).cast("bigint").alias("pos"),
                                    F.sum(1 - F.col(truth)).cast("bigint").alias("neg"))
    cum = running_totals(by_score, [F.desc(risk)], ["pos", "neg"])
    tot = by_score.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()  # scalars
    big_p, big_n = F.lit(tot["P"] or 0), F.lit(tot["N"] or 0)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return cum.select(
        F.col(risk).alias("threshold"), tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
        F.when(big_p > 0, tp / big_p).alias("tpr"),
        F.when(big_n > 0, fp / big_n).alias("fpr"),
        (tp / (tp + fp)).alias("precision"),
        F.when(big_p > 0, tp / big_p).alias("recall"))


def find_truth_column(columns: list[str]) -> str | None:
    """ANO-06: first ground-truth column name present."""
    from postlab.schema import TRUTH_COLUMN_CANDIDATES
    return next((c for c in TRUTH_COLUMN_CANDIDATES if c in columns), None)
