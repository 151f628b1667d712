"""Exact contributions of boosted trees (SUP-10, SUP-11), by processed feature.

The contribution of a feature to f(x) against a background row b is its Shapley value in the game whose value for a set of
features is the prediction for the row that takes them from x and the others from b. For a sum of trees that value has a closed
form: a leaf counts if every feature on its path is satisfied by x or by b. With A the path's features that only x satisfies and B
those that only b satisfies, a leaf of value v gives v (|A|-1)! |B|! / (|A|+|B|)! to each of A and -v |A|! (|B|-1)! / (|A|+|B|)!
to each of B, and nothing if one of its features is satisfied by neither row. Values are averaged over all background rows, so
they sum to f(x) less the mean prediction of the background, without sampled permutations.

The path table comes from the node table that the saved model consists of; its size is that of the model, not of the data.
Explained rows are spread over tasks; the background is a sample of bounded size (``n_background``).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab.operators.prep import processed_feature_names, subsample
from postlab.session import ensure_checkpoint_dir

#: Pairs of a background row and a leaf held at once.
PAIRS = 1 << 20


@dataclass
class Paths:
    """Leaves of all trees. ``unit`` numbers the (leaf, feature) pairs in the order of leaves; an edge is one split above a leaf."""

    value: np.ndarray  # leaf -> weighted prediction
    unit_feature: np.ndarray  # unit -> feature
    unit_leaf: np.ndarray
    unit_bit: np.ndarray  # unit -> place of its feature among those of its leaf
    edge_split: np.ndarray  # edge -> split, ordered by unit
    edge_left: np.ndarray
    edge_start: np.ndarray  # unit -> its first edge
    split_feature: np.ndarray
    split_threshold: np.ndarray  # NaN where the split is by category
    split_left: dict[int, list[float]]  # split -> categories that go left

    @property
    def full(self) -> np.ndarray:
        """Leaf -> mask of all its features."""
        return (np.int64(1) << np.bincount(self.unit_leaf, minlength=len(self.value))) - 1

    def masks(self, x: np.ndarray) -> np.ndarray:
        """(rows, leaves): which of a leaf's features satisfy all splits above it."""
        out = np.zeros((len(x), len(self.value)), np.int64)
        if not len(self.unit_leaf):
            return out
        for i, row in enumerate(x):
            left = row[self.split_feature] <= self.split_threshold
            for split, allowed in self.split_left.items():
                left[split] = row[self.split_feature[split]] in allowed
            held = np.logical_and.reduceat(left[self.edge_split] == self.edge_left, self.edge_start)
            np.add.at(out[i], self.unit_leaf[held], np.int64(1) << self.unit_bit[held])
        return out


def tree_nodes(spark: SparkSession, model) -> tuple[pd.DataFrame, list[float]]:
    """Node table and tree weights of a fitted ``GBTRegressionModel``, read from its saved form."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.save(path)
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n.id.alias("id"), n.prediction.alias("prediction"), n.leftChild.alias("left"), n.rightChild.alias("right"),
        n.split.featureIndex.alias("feature"), n.split.leftCategoriesOrThreshold.alias("sides"), n.split.numCategories.alias("categories"))
    return nodes.toPandas(), list(model.treeWeights)


def path_table(nodes: pd.DataFrame, weights: list[float]) -> Paths:
    """Every leaf with the splits above it, grouped by feature."""
    value, unit_feature, unit_leaf, unit_bit, edge_split, edge_left, edge_start = [], [], [], [], [], [], []
    split_feature, split_threshold, split_left = [], [], {}
    for tree, part in nodes.groupby("tree"):
        by_id = {r.id: r for r in part.itertuples()}
        pending = [(0, [])]
        while pending:
            at, above = pending.pop()
            node = by_id[at]
            if node.left >= 0:
                split = len(split_feature)
                split_feature.append(node.feature)
                split_threshold.append(node.sides[0] if node.categories < 0 else math.nan)
                if node.categories >= 0:
                    split_left[split] = [float(c) for c in node.sides]
                pending += [(node.left, [*above, (node.feature, split, True)]), (node.right, [*above, (node.feature, split, False)])]
                continue
            for bit, feature in enumerate(sorted({f for f, _, _ in above})):
                edge_start.append(len(edge_split))
                unit_feature.append(feature), unit_leaf.append(len(value)), unit_bit.append(bit)
                for f, split, left in above:
                    if f == feature:
                        edge_split.append(split), edge_left.append(left)
            value.append(node.prediction * weights[tree])
    whole = [np.array(v, np.int64) for v in (unit_feature, unit_leaf, unit_bit, edge_split)]
    return Paths(np.array(value), *whole, np.array(edge_left, bool), np.array(edge_start, np.int64), np.array(split_feature, np.int64),
                 np.array(split_threshold, float), split_left)


def shapley_weights(most: int) -> np.ndarray:
    """[a, b] -> (a-1)! b! / (a+b)!, the weight of one of a features against b others; 0 without a."""
    out = np.zeros((most + 1, most + 1))
    for a in range(1, most + 1):
        for b in range(most + 1 - a):
            out[a, b] = math.factorial(a - 1) * math.factorial(b) / math.factorial(a + b)
    return out


def contributions_of(paths: Paths, row: np.ndarray, background: np.ndarray, n_features: int) -> np.ndarray:
    """Contributions of all features to one row; ``row`` and ``background`` are masks of :meth:`Paths.masks`."""
    most = int(paths.unit_bit.max(initial=-1)) + 1
    table, full, out = shapley_weights(most), paths.full, np.zeros(n_features)
    gain = np.zeros((most, len(paths.value)))
    step = max(1, PAIRS // max(1, len(full)))
    for at in range(0, len(background), step):
        other = background[at:at + step]
        b, leaf = np.nonzero(((row | other) == full) & (row != other))
        only_x, only_b = row[leaf] & ~other[b, leaf], other[b, leaf] & ~row[leaf]
        n_x, n_b = np.bitwise_count(only_x), np.bitwise_count(only_b)
        plus, minus = paths.value[leaf] * table[n_x, n_b], paths.value[leaf] * table[n_b, n_x]
        for bit in range(most):
            given = np.where(only_x >> bit & 1, plus, 0.0) - np.where(only_b >> bit & 1, minus, 0.0)
            gain[bit] += np.bincount(leaf, given, len(full))
    np.add.at(out, paths.unit_feature, gain[paths.unit_bit, paths.unit_leaf])
    return out / max(1, len(background))


def tree_contributions(model: PipelineModel, data: DataFrame, n_rows: int = 500, n_background: int = 100, seed: int = 42,
                       key: str = "post_id") -> DataFrame:
    """(key, feature, value, contribution) of min(n_rows, n) hash-sampled rows, for every processed feature.

    ``model`` is a fitted pipeline that ends in a ``GBTRegressionModel``; ``value`` is the processed value (scaled numbers, 0 or 1
    of a category). Missing values are filled by the pipeline. Without rows the result is empty."""
    spark, trees = data.sparkSession, model.stages[-1]
    prepared = PipelineModel(stages=model.stages[:-1]).transform
    rows = prepared(subsample(data, n_rows, seed, key))
    names = processed_feature_names(rows, "features")
    n_features = len(names)
    others = prepared(subsample(data, n_background, seed + 1, key)).select(vector_to_array("features").alias("x")).collect()
    paths = path_table(*tree_nodes(spark, trees))
    background = paths.masks(np.array([r.x for r in others], float).reshape(len(others), n_features))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = paths.masks(np.array(batch["x"].tolist(), float).reshape(len(batch), n_features))
            told = [contributions_of(paths, m, background, n_features).tolist() for m in own]
            yield pd.DataFrame({"key": batch["key"], "x": batch["x"], "c": told})

    key_type = data.schema[key].dataType.simpleString()
    spread = rows.select(F.col(key).alias("key"), vector_to_array("features").alias("x")).repartition(
        max(1, min(n_rows, spark.sparkContext.defaultParallelism)))
    told = spread.mapInPandas(run, f"key {key_type}, x array<double>, c array<double>")
    named = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("x").alias("value"), F.col("c").alias("contribution"))
    return told.select(F.col("key").alias(key), F.inline(named))
