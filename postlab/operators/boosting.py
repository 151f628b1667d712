"""Boosted regression trees from shared histograms (SUP-01), saved and read as Spark ML's ``GBTRegressionModel``.

The model is that of ``GBTRegressor`` with squared loss: the same bins (at most ``maxBins``, from as many rows as Spark ML draws for
them), row and feature subsets, first tree on the labels with weight 1, later ones on twice the residual with the step size, the
same gain and stopping rules. Only the way to the histograms of a level differs, and every row enters them:

* a column of 0 and 1 (one-hot) costs a row something only where it is 1; its other bin is the node's total less that;
* of two siblings only the smaller one is summed, the other is their parent less that;
* bins are one byte each and stay in executor memory with the running prediction.

Where rows are dealt among tasks, each level is one job; the histograms of a task do not grow with its rows, and many tasks are
summed on the executors. Models of rows that a task can hold are grown by one task each, all draws of a search at once.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.session import cut_lineage, ensure_checkpoint_dir

#: Rows that are binned and summed together.
CHUNK_ROWS = 1 << 15
#: Rows of a task: at least, and at most (beyond, there are more tasks than cores).
MIN_TASK_ROWS, MAX_TASK_ROWS = 20_000, 2_000_000
#: Rows up to which one task grows a model by itself: of many models at once, and of few.
ONE_TASK_ROWS, ALONE_ROWS = 4_000_000, 500_000
#: Trees after which the running prediction is made anew from the binned rows, which bounds its lineage.
REBASE_TREES = 25
#: Tasks whose histograms the driver sums itself; of more, the executors sum them first.
DIRECT_TASKS = 32
#: Gains below this share of the targets' mean square are rounding.
NO_GAIN = 1e-13


@dataclass
class Layout:
    """Where each feature is: a row of ``bins`` or a number in ``slots``."""

    numeric: list[int]  # row of bins -> feature
    binary: list[int]  # number in slots -> feature
    thresholds: list[np.ndarray]  # row of bins -> ascending thresholds; bin b holds (t[b-1], t[b]]

    @property
    def n_bins(self) -> int:
        return max((len(t) for t in self.thresholds), default=0) + 1


class Tree:
    """Nodes as a heap: the children of i are 2 i + 1 (left) and 2 i + 2."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.depth, self.weight = depth, 1.0
        self.split, self.one_left = np.zeros(size, bool), np.zeros(size, bool)
        self.row, self.slot, self.cut = np.full(size, -1), np.full(size, -1), np.zeros(size, np.int64)
        self.gain, self.n, self.s, self.q = (np.zeros(size) for _ in range(4))

    @property
    def value(self) -> np.ndarray:
        return self.s / np.maximum(self.n, 1)

    def descend(self, bins: np.ndarray, slots: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` splits."""
        n = slots.shape[1]
        node, at, flat = np.zeros(n, np.int64), np.arange(n), bins.reshape(-1)
        for level in range(levels):
            here = slice(2 ** level - 1, 2 ** (level + 1) - 1)
            if not self.split[here].any():
                break
            right = np.zeros(n, bool)
            row = self.row[node]
            if (self.row[here] >= 0).any():
                right = (flat.take(np.maximum(row, 0) * n + at) > self.cut[node]) & (row >= 0)
            if (self.slot[here] >= 0).any():
                slot = self.slot[node]
                one = (slots == slot.astype(slots.dtype)).any(0)
                right |= (slot >= 0) & (one != self.one_left[node])
            node = np.where(self.split[node], 2 * node + 1 + right, node)
        return node


def thresholds_of(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Midpoints between neighbouring values; of more than ``max_bins`` values, those next to equal shares of the rows."""
    values, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= max_bins - 1:
        return middle
    stride = target = counts.sum() / max_bins
    ends, out = np.cumsum(counts), []
    for i in range(1, len(values)):
        if abs(ends[i - 1] - target) < abs(ends[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def binned(df: DataFrame, layout: Layout, tasks: int) -> DataFrame:
    """(chunk, bins, slots, y) of up to CHUNK_ROWS rows each: one byte a number, and a row's ones by their number."""
    byte = np.uint8 if layout.n_bins <= 256 else np.int32
    numeric, binary, none = np.array(layout.numeric, int), np.array(layout.binary, int), len(layout.binary)

    def pack(x: np.ndarray, y: np.ndarray, chunk: int) -> pa.RecordBatch:
        bins = np.empty((len(numeric), len(x)), byte)
        for i, t in enumerate(layout.thresholds):
            bins[i] = np.searchsorted(t, x[:, numeric[i]], side="left")
        row, one = np.nonzero(x[:, binary])
        place = np.arange(len(row)) - np.searchsorted(row, row)  # among the ones of its row
        slots = np.full((int(place.max(initial=-1)) + 1, len(x)), none, np.uint16 if none < 1 << 16 else np.int32)
        slots[place, row] = one
        return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "n": pa.array([len(x)], pa.int64()), "bins": [bins.tobytes()],
                                           "slots": [slots.tobytes()], "y": [y.tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            held.append((x, batch.column("label").to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield pack(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), chunk)
                chunk, held, rows = chunk + 1, [], 0
        if rows:
            yield pack(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), chunk)

    return df.mapInArrow(run, "chunk long, n long, bins binary, slots binary, y binary").repartition(tasks)


def summed(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [u + v for u, v in zip(a, b, strict=True)]


def level_sums(layout: Layout, tree: Tree, level: int, todo: np.ndarray, number: int, last: Tree | None, rate: float, seed: int):
    """A task's part of: counts and target sums of each (node of ``todo``, feature, bin), the totals (n, sum, sum of squares) of the
    tree's targets and, at the root, those of the leaves of the tree before."""
    width, none = layout.n_bins, len(layout.binary)
    place = np.full(2 ** (tree.depth + 1) - 1, -1)
    place[todo] = np.arange(len(todo))

    def run(chunks):
        m = len(todo)
        held = [np.zeros((len(layout.numeric), m * width)) for _ in range(2)] + [np.zeros(m * (none + 1)) for _ in range(2)]
        totals, leaves = np.zeros(3), np.zeros((3, len(place)))
        for chunk, bins, slots, y, pred, leaf in chunks:
            if last is not None and level == 0:
                drawn = sample(seed, number - 1, chunk, len(y), rate)
                before = (pred - last.weight * last.value[leaf])
                t = (y if number == 1 else 2.0 * (y - before))[drawn]
                for out, v in zip(leaves, (None, t, t * t), strict=True):
                    out += np.bincount(leaf[drawn], v, len(place))
            if not m:
                continue
            drawn = sample(seed, number, chunk, len(y), rate)
            if level:
                at = place[tree.descend(bins, slots, level)]
                drawn = drawn[at[drawn] >= 0]
                at = at[drawn]
            else:
                at = np.zeros(len(drawn), np.int64)
            t = (y if number == 0 else 2.0 * (y - pred))[drawn]
            totals += [len(t), t.sum(), (t * t).sum()]
            base, key = at * width, np.empty(len(at), np.int64)
            for i, row in enumerate(bins):
                np.add(base, row[drawn], out=key)
                held[0][i] += np.bincount(key, minlength=m * width)
                held[1][i] += np.bincount(key, t, m * width)
            base = at * (none + 1)
            for row in slots:
                np.add(base, row[drawn], out=key)
                held[2] += np.bincount(key, minlength=m * (none + 1))
                held[3] += np.bincount(key, t, m * (none + 1))
        yield [*held, totals, leaves]
    return run


def sample(seed: int, number: int, chunk: int, n: int, rate: float) -> np.ndarray:
    """Rows of a chunk that a tree learns from."""
    if rate >= 1:
        return np.arange(n)
    return np.flatnonzero(np.random.default_rng([abs(seed), number, chunk]).random(n) < rate)


def advance(trees: list[Tree]):
    """Chunks with the trees' part added to the running prediction, and the last tree's leaf of each row."""
    def run(c):
        chunk, bins, slots, y, pred, leaf = c
        for tree in trees:
            leaf = tree.descend(bins, slots, tree.depth)
            pred = pred + tree.weight * tree.value[leaf]
        return chunk, bins, slots, y, pred, leaf.astype(np.int16 if len(tree.split) < 1 << 15 else np.int64)
    return run


def best_splits(tree: Tree, layout: Layout, nodes: np.ndarray, hists: dict, allowed: np.ndarray, least: float, no_gain: float) -> list[int]:
    """Set the best split of each node among its allowed features; returns the nodes that were split."""
    n_features, done = len(layout.numeric) + len(layout.binary), []
    for node, chosen in zip(nodes, allowed, strict=True):
        n, s, (cn, cs, bn, bs) = tree.n[node], tree.s[node], hists[node]
        gain = np.full(n_features, -np.inf)
        left, left_s = np.cumsum(cn, 1)[:, :-1], np.cumsum(cs, 1)[:, :-1]

        def worth(l, ls):
            r, rs = n - l, s - ls
            g = (ls * ls / np.maximum(l, 1) + rs * rs / np.maximum(r, 1) - s * s / n) / n
            return np.where((l >= least) & (r >= least), g, -np.inf)

        if left.size:
            by_cut = worth(left, left_s)
            cut = by_cut.argmax(1)
            gain[layout.numeric] = by_cut[np.arange(len(cut)), cut]
        if len(layout.binary):
            gain[layout.binary] = worth(bn, bs)
        gain[~chosen] = -np.inf
        best = int(gain.argmax())
        if not gain[best] > no_gain:
            continue
        tree.split[node], tree.gain[node] = True, gain[best]
        if best in layout.binary:
            i = layout.binary.index(best)
            tree.slot[node], tree.one_left[node] = i, bs[i] / bn[i] < (s - bs[i]) / (n - bn[i])
            small = (bn[i], bs[i]) if tree.one_left[node] else (n - bn[i], s - bs[i])
        else:
            i = layout.numeric.index(best)
            tree.row[node], tree.cut[node] = i, cut[i]
            small = (left[i, cut[i]], left_s[i, cut[i]])
        a, b = 2 * node + 1, 2 * node + 2
        tree.n[a], tree.s[a], tree.n[b], tree.s[b] = *small, n - small[0], s - small[1]
        done.append(int(node))
    return done


@dataclass
class Plan:
    """What the trees of a model are grown by; ``subset`` features may split a node, with ``least`` rows on either side."""

    trees: int
    depth: int
    step: float
    rate: float
    seed: int
    subset: int
    least: int


class InTask:
    """All chunks in the memory of one task."""

    def __init__(self, chunks):
        self.chunks = sorted(chunks, key=lambda c: c[0])

    def total(self, part) -> list[np.ndarray]:
        return next(part(self.chunks))

    def learn(self, trees: list[Tree]) -> None:
        self.chunks = list(map(advance(trees[-1:]), self.chunks))


class OverTasks:
    """Chunks dealt among tasks, which stay in executor memory."""

    def __init__(self, rows, tasks: int):
        self.rows, self.tasks, self.state, self.older = rows, tasks, rows.persist(StorageLevel.MEMORY_AND_DISK), None

    def total(self, part) -> list[np.ndarray]:
        parts = self.state.mapPartitions(part)
        return parts.treeReduce(summed) if self.tasks > DIRECT_TASKS else parts.reduce(summed)

    def learn(self, trees: list[Tree]) -> None:
        whole = len(trees) % REBASE_TREES == 0
        if self.older is not None:
            self.older.unpersist()
        self.older = self.state
        self.state = (self.rows if whole else self.state).map(advance(list(trees) if whole else trees[-1:])).persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        for rdd in {id(r): r for r in (self.rows, self.older, self.state) if r is not None}.values():
            rdd.unpersist()


def grow(layout: Layout, plan: Plan, held: InTask | OverTasks) -> list[Tree]:
    """The trees of a model, level by level from the sums over all chunks."""
    depth, rate, seed, none, trees = plan.depth, plan.rate, plan.seed, len(layout.binary), []
    n_features = len(layout.numeric) + none

    def settle(tree, leaves):
        """Totals of all nodes from those of the leaves."""
        tree.q = np.where(leaves[0] > 0, leaves[2], 0.0)
        for i in range(2 ** depth - 2, -1, -1):
            if tree.split[i]:
                tree.q[i] = tree.q[2 * i + 1] + tree.q[2 * i + 2]

    for number in range(plan.trees):
        tree = Tree(depth)
        tree.weight = 1.0 if number == 0 else plan.step
        nodes, hists = np.array([0]), {}
        draw = np.random.default_rng([abs(seed), number])
        for level in range(depth):
            parents = sorted({(i - 1) // 2 for i in nodes.tolist()}) if level else []
            todo = np.array([2 * p + 1 + int(tree.n[2 * p + 2] < tree.n[2 * p + 1]) for p in parents] if level else [0])
            cn, cs, bn, bs, totals, leaves = held.total(level_sums(layout, tree, level, todo, number, trees[-1] if trees else None, rate, seed))
            m, width = len(todo), layout.n_bins
            cn, cs = (h.reshape(-1, m, width) for h in (cn, cs))
            bn, bs = (h.reshape(m, none + 1)[:, :none] for h in (bn, bs))
            now = {int(node): (cn[:, i], cs[:, i], bn[i], bs[i]) for i, node in enumerate(todo)}
            if level == 0:
                if trees:
                    settle(trees[-1], leaves)
                tree.n[0], tree.s[0] = totals[:2]
                no_gain = NO_GAIN * totals[2] / max(totals[0], 1)
            for p in parents:
                small = next(c for c in (2 * p + 1, 2 * p + 2) if c in now)
                now[4 * p + 3 - small] = tuple(u - v for u, v in zip(hists[p], now[small], strict=True))
            allowed = np.ones((len(nodes), n_features), bool)
            if plan.subset < n_features:
                for one in allowed:
                    one[draw.choice(n_features, n_features - plan.subset, replace=False)] = False
            hists = now
            split = best_splits(tree, layout, nodes, hists, allowed, plan.least, no_gain) if tree.n[0] else []
            nodes = np.array([c for p in split for c in (2 * p + 1, 2 * p + 2)])
            if not len(nodes):
                break
        trees.append(tree)
        held.learn(trees)
    settle(trees[-1], held.total(level_sums(layout, Tree(depth), 0, np.array([], int), len(trees), trees[-1], rate, seed))[-1])
    return trees


def fit_together(regressors: list[HistogramGBTRegressor], dataset: DataFrame) -> list[GBTRegressionModel]:
    """The models of several regressors on the same rows, whose bins are made once (regressors of one seed and number of bins).

    Rows that one task can hold are given whole to one task a model, which then needs no job for each level; others, and
    many rows of few models, are dealt among tasks, level by level."""
    one, k = regressors[0], len(regressors)
    if not all(r._plain(dataset) for r in regressors) or len({(r.getSeed(), r.getMaxBins(), r.getLabelCol(), r.getFeaturesCol()) for r in regressors}) > 1:
        return [r.fit(dataset) for r in regressors]
    spark = dataset.sparkSession
    groups = dataset.schema[one.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
    data = dataset.select(F.col(one.getLabelCol()).cast("double").alias("label"), vector_to_array(one.getFeaturesCol()).alias("x"))
    n = data.count()
    if not n:
        raise ValueError("no rows to train on")
    layout, n_features = one._layout(data, n, sorted(a["idx"] for a in groups.get("binary", [])))
    plans = [r._plan(n_features) for r in regressors]
    cores = spark.sparkContext.defaultParallelism
    byte = np.uint8 if layout.n_bins <= 256 else np.int32
    wide = np.uint16 if len(layout.binary) < 1 << 16 else np.int32

    def unpacked(r):
        y = np.frombuffer(r[4])
        return (r[0], np.frombuffer(r[2], byte).reshape(len(layout.numeric), r[1]), np.frombuffer(r[3], wide).reshape(-1, r[1]), y,
                np.zeros(len(y)), np.zeros(len(y), np.int16))

    if n <= ALONE_ROWS or n <= ONE_TASK_ROWS and 2 * k >= cores:
        def grown(pairs):
            model, chunks = None, []
            for model, row in pairs:
                chunks.append(unpacked(row))
            yield model, grow(layout, plans[model], InTask(chunks))

        packed = cut_lineage(binned(data, layout, 1)).rdd.map(tuple)
        found = dict(spark.sparkContext.parallelize(range(k), k).cartesian(packed).mapPartitions(grown).collect())  # each task reads all chunks
        return [r._model(spark, found[i], layout, n_features) for i, r in enumerate(regressors)]

    tasks = max(1, min(cores, math.ceil(n / MIN_TASK_ROWS)), math.ceil(n / MAX_TASK_ROWS / cores) * cores if n > MAX_TASK_ROWS * cores else 0)
    packed, models = cut_lineage(binned(data, layout, tasks)), []
    for r, plan in zip(regressors, plans, strict=True):
        held = OverTasks(packed.rdd.map(tuple).map(unpacked), tasks)
        models.append(r._model(spark, grow(layout, plan, held), layout, n_features))
        held.close()
    return models


class HistogramGBTRegressor(GBTRegressor):
    """``GBTRegressor`` whose ``fit`` sums shared histograms; other losses, weights and wide nominal features go Spark ML's way."""

    def _plain(self, dataset: DataFrame) -> bool:
        groups = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        return (self.getLossType() == "squared" and "nominal" not in groups and self.getMinInfoGain() == 0
                and self.getMinWeightFractionPerNode() == 0 and self.getMaxDepth() > 0
                and not any(self.isSet(p) for p in ("weightCol", "validationIndicatorCol")))

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        return fit_together([self], dataset)[0] if self._plain(dataset) else super()._fit(dataset)

    def _plan(self, n_features: int) -> Plan:
        subset = math.ceil(float(self.getFeatureSubsetStrategy()) * n_features) if self._is_share() else n_features
        return Plan(self.getMaxIter(), self.getMaxDepth(), self.getStepSize(), self.getSubsamplingRate(), self.getSeed(), subset,
                    self.getMinInstancesPerNode())

    def _is_share(self) -> bool:
        try:
            return 0 < float(self.getFeatureSubsetStrategy()) <= 1
        except ValueError:
            if self.getFeatureSubsetStrategy() in ("all", "auto"):
                return False
            raise

    def _layout(self, data: DataFrame, n: int, binary: list[int]) -> tuple[Layout, int]:
        n_features = data.select(F.size("x")).first()[0]
        numeric = sorted(set(range(n_features)) - set(binary))
        share = min(1.0, max(self.getMaxBins() ** 2, 10_000) / n)  # the rows from which Spark ML takes its bins
        picked = data if share >= 1 else data.sample(False, share, self.getSeed())
        values = np.array([r[0] for r in picked.select(F.array(*[F.col("x")[i] for i in numeric])).collect()], float) if numeric else None
        return Layout(numeric, binary, [thresholds_of(values[:, i], min(self.getMaxBins(), n)) for i in range(len(numeric))]), n_features

    def _model(self, spark, trees: list[Tree], layout: Layout, n_features: int) -> GBTRegressionModel:
        """Write the trees as Spark ML saves them and read them back."""
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/boosted-{uuid.uuid4().hex}"

        def about(kind, uid, source, **more):
            params, default = ({p.name: v for p, v in m.items()} for m in (source._paramMap, source._defaultParamMap))
            return {"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                    "uid": uid, "paramMap": params, "defaultParamMap": default, **more}

        one = DecisionTreeRegressor(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol(),
                                    maxDepth=self.getMaxDepth(), maxBins=self.getMaxBins(), seed=self.getSeed())
        meta = [(i, json.dumps(about("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", one)), t.weight) for i, t in enumerate(trees)]
        nodes = [(i, node) for i, t in enumerate(trees) for node in saved_nodes(t, layout)]
        spark.createDataFrame([(json.dumps(about("GBTRegressionModel", self.uid, self, numFeatures=n_features, numTrees=len(trees))),)],
                              "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame(meta, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(nodes, "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,"
                              "gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,"
                              "numCategories:int>>").coalesce(1).write.parquet(f"{path}/data")
        return GBTRegressionModel.load(path)


def saved_nodes(tree: Tree, layout: Layout) -> list[tuple]:
    """Nodes in preorder; siblings that are leaves of equal prediction become one leaf."""
    value, out = tree.value.tolist(), []

    def leaf(i):
        return not tree.split[i] or leaf(2 * i + 1) and leaf(2 * i + 2) and value[2 * i + 1] == value[2 * i + 2]

    def put(i) -> int:
        own, n = len(out), float(tree.n[i])
        impurity = max((tree.q[i] - tree.s[i] ** 2 / n) / n, 0.0) if n else 0.0
        stats = (own, value[i], float(impurity), [n, float(tree.s[i]), float(tree.q[i])], int(n))
        out.append((*stats, -1.0, -1, -1, (-1, [], -1)))
        if not leaf(i):
            if tree.row[i] >= 0:
                split = (layout.numeric[tree.row[i]], [float(layout.thresholds[tree.row[i]][tree.cut[i]])], -1)
            else:
                split = (layout.binary[tree.slot[i]], [1.0 if tree.one_left[i] else 0.0], 2)
            out[own] = (*stats, float(tree.gain[i]), put(2 * i + 1), put(2 * i + 2), split)
        return own

    put(0)
    return out
