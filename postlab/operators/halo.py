"""Rows within a distance of one another, block by block, for tables too large for pairs of chunks.

Space is cut into boxes of about equal numbers of rows. A row goes to the block of its own box and, as a neighbour, to those whose
box is within eps of it; so a block meets every row near its own ones, what it tells of them is whole, and no partial sums are
shuffled. One shuffle of packed columns carries the rows (a column of few values as codes). A block holds its own rows, as a tree
of boxes, and neighbours pass by in runs of bounded length; a box of more than ``BLOCK_ROWS`` rows is dealt among several
blocks, each of which meets all its neighbours. The cuts come from a hash sample; they decide the work, never the result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which the cuts are made, rows that are packed together, and own rows of a block.
SAMPLE_ROWS, RUN_ROWS, BLOCK_ROWS = 20_000, 1 << 17, 400_000
#: Own rows that meet neighbours in one product, and the columns of it.
LEAF_ROWS, WIDE = 64, 4096
#: Square norms below which products are of single precision; pairs near the limit are tested in double precision.
SINGLE_BELOW = 1e4


def cut_boxes(sample: np.ndarray, parts: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(lows, highs) of up to ``parts`` boxes [low, high) that fill space."""
    d = sample.shape[1]
    done, todo = [], [(sample, np.full(d, -np.inf), np.full(d, np.inf))]
    while todo and len(done) + len(todo) < parts:
        todo.sort(key=lambda b: len(b[0]))
        x, low, high = todo.pop()
        spread = np.subtract(*np.quantile(x, [0.95, 0.05], axis=0)) if len(x) > 1 else np.zeros(d)
        axis = int(spread.argmax())
        cut = float(np.median(x[:, axis])) if len(x) > 1 else 0.0
        left = x[:, axis] < cut
        if not spread[axis] > 0 or not left.any():
            done.append((x, low, high))
            continue
        under, over = high.copy(), low.copy()
        under[axis], over[axis] = cut, cut
        todo += [(x[left], low, under), (x[~left], over, high)]
    boxes = done + todo
    return np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])


def _gap(x: np.ndarray, low, high) -> np.ndarray:
    """Square of how far values are outside [low, high]."""
    g = np.maximum(low - x, x - high)
    np.maximum(g, 0.0, out=g)
    g *= g
    return g


def home_of(x: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """The box of each row."""
    home = np.zeros(len(x), np.int64)
    for b, (low, high) in enumerate(zip(lows, highs, strict=True)):
        home[((x >= low) & ((x < high) | np.isinf(high))).all(1)] = b
    return home


def _pack(columns: list[np.ndarray]) -> bytes:
    out = []
    for c in columns:
        values, codes = np.unique(c, return_inverse=True)
        small = np.uint8 if len(values) <= 256 else np.uint16 if len(values) <= min(1 << 16, len(c) // 2) else None
        out.append(c if small is None else (values, codes.astype(small)))
    return pickle.dumps(out, protocol=5)


def _unpack(blob: bytes) -> list[np.ndarray]:
    return [c[0][c[1]] if isinstance(c, tuple) else c for c in pickle.loads(blob)]


class Tree:
    """Own rows in boxes halved down to ``LEAF_ROWS`` rows. A node's box is its parent's, narrowed along the axis of the cut."""

    def __init__(self, x: np.ndarray):
        self.order, self.x = np.arange(len(x)), x
        self.low, self.high = (x.min(0), x.max(0)) if len(x) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        self.root = self._node(0, len(x))
        self.x = x[self.order]

    def _node(self, start: int, end: int):
        if end - start <= LEAF_ROWS:
            return start, end
        rows = self.x[self.order[start:end]]
        axis = int((rows.max(0) - rows.min(0)).argmax())
        v = rows[:, axis]
        half = (end - start) // 2
        by = np.argpartition(v, half)
        self.order[start:end] = self.order[start:end][by]
        v = v[by]
        return (axis, (v[:half].min(), v[:half].max()), self._node(start, start + half),
                (v[half:].min(), v[half:].max()), self._node(start + half, end))

    def meet(self, others: np.ndarray, eps: float, test: Callable) -> None:
        """``test(start, end, found)`` of each leaf (a slice of ``self.x``) and the rows of ``others`` within eps of its box."""
        limit = eps * eps * (1 + 1e-9) + 1e-12
        columns = [np.ascontiguousarray(c) for c in others.T]
        apart = sum(_gap(c, low, high) for c, low, high in zip(columns, self.low, self.high, strict=True))
        found = np.flatnonzero(apart <= limit)

        def down(node, found, apart, low, high):
            if not len(found):
                return
            if len(node) == 2:
                test(*node, found)
                return
            axis = node[0]
            v = columns[axis][found]
            rest = apart - _gap(v, low[axis], high[axis])
            for bounds, child in ((node[1], node[2]), (node[3], node[4])):
                near = rest + _gap(v, *bounds)
                keep = np.flatnonzero(near <= limit)
                under, over = list(low), list(high)
                under[axis], over[axis] = bounds
                down(child, found[keep], near[keep], under, over)

        if len(self.x):
            down(self.root, found, apart[found], list(self.low), list(self.high))


def _products(own: np.ndarray, others: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, sure, maybe) over runs of the others: pairs within eps for certain, and those that may be."""
    middle = own.mean(0)
    a, b = own - middle, others - middle
    sa, sb = (a * a).sum(1), (b * b).sum(1)
    top = float(max(sa.max(), sb.max()))
    kind, slack = (np.float32, 1e-5 * (1 + top)) if top < SINGLE_BELOW else (np.float64, 1e-9 * (1 + top))
    left = np.column_stack([2 * a, eps * eps - sa, np.ones(len(a))]).astype(kind)
    right = np.vstack([b.T, np.ones(len(b)), -sb]).astype(kind)
    for at in range(0, len(b), WIDE):
        p = left @ right[:, at:at + WIDE]
        yield at, p >= kind(slack), p >= kind(-slack)


def _doubtful(own, others, at, sure, maybe, eps) -> tuple[np.ndarray, np.ndarray]:
    """The pairs near the limit that are within eps."""
    if np.count_nonzero(sure) == np.count_nonzero(maybe):
        return np.zeros(0, int), np.zeros(0, int)
    i, j = np.nonzero(maybe & ~sure)
    j = j + at
    near = ((own[i] - others[j]) ** 2).sum(1) <= eps * eps
    return i[near], j[near]


def _dealt(rows: DataFrame, n: int, d: int, eps: float, only_core: bool, with_keys: bool) -> tuple[DataFrame, np.ndarray]:
    """(block, kind, blob): own rows (kind 0) and neighbours (kind 1) of each block, sorted so within its partition; and each block's box."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("key")).limit(SAMPLE_ROWS).select("x").collect()
    cores = spark.sparkContext.defaultParallelism
    parts = max(min(n // 4096, 4 * cores), math.ceil(2 * n / BLOCK_ROWS), 1)
    lows, highs = cut_boxes(np.array([r[0] for r in sample], float).reshape(-1, d), parts, eps)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def count(batches):
        held = np.zeros(len(lows), np.int64)
        for batch in batches:
            held += np.bincount(home_of(matrix(batch), lows, highs), minlength=len(lows))
        yield pa.RecordBatch.from_pydict({"box": np.arange(len(lows)), "n": held})

    sizes = {r[0]: r[1] for r in rows.select("x").mapInArrow(count, "box long, n long").groupBy("box").agg(F.sum("n")).collect()}  # one row a box
    slices = [max(1, math.ceil(sizes.get(b, 0) / BLOCK_ROWS)) for b in range(len(lows))]
    first = np.concatenate([[0], np.cumsum(slices)])
    blocks = int(first[-1])
    # a number for each block whose hash is a partition of its own
    tokens: dict[int, int] = {}
    for r in spark.range(max(64, 40 * blocks)).select("id", F.pmod(F.hash("id"), F.lit(blocks)).alias("p")).collect():
        tokens.setdefault(r["p"], r["id"])
    token = [tokens.get(b, b) for b in range(blocks)]
    limit = eps * eps * (1 + 1e-9) + 1e-12

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            x, keys, core = (np.concatenate([h[i] for h in held]) for i in range(3))
            home = home_of(x, lows, highs)
            own = first[home] + keys % np.array(slices)[home]
            told = {"block": [], "kind": [], "blob": []}

            def tell(block, kind, at):
                columns = [*x[at].T]
                if with_keys or not kind:
                    columns += [keys[at], 2 * own[at] + core[at]]
                told["block"].append(token[block])
                told["kind"].append(2 * block + kind)
                told["blob"].append(_pack([np.ascontiguousarray(c) for c in columns]))

            for b in range(len(lows)):
                mine = np.flatnonzero(home == b)
                wide = np.flatnonzero(core) if only_core else np.arange(len(x))
                for axis in range(d):
                    if np.isfinite(lows[b, axis]) or np.isfinite(highs[b, axis]):
                        wide = wide[_gap(x[wide, axis], lows[b, axis], highs[b, axis]) <= limit]
                apart = sum(_gap(x[wide, axis], lows[b, axis], highs[b, axis]) for axis in range(d))
                wide = wide[apart <= limit]
                for s in range(slices[b]):
                    block = int(first[b]) + s
                    part, near = mine[own[mine] == block], wide[own[wide] != block]
                    if len(part):
                        tell(block, 0, part)
                    if len(near):
                        tell(block, 1, near)
            return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(told.items(), (pa.int64(), pa.int64(), pa.binary()), strict=True)})

        held, n_held = [], 0
        for batch in batches:
            held.append((matrix(batch), batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64),
                         batch.column("core").to_numpy(zero_copy_only=False).astype(bool)))
            n_held += batch.num_rows
            if n_held >= RUN_ROWS:
                yield flush(held)
                held, n_held = [], 0
        if n_held:
            yield flush(held)

    dealt = rows.select("key", "x", "core").mapInArrow(deal, "block long, kind long, blob binary")
    return dealt.repartition(blocks, "block").sortWithinPartitions("kind").select("kind", "blob"), lows


def _over_blocks(dealt: DataFrame, d: int, work: Callable, schema: str) -> DataFrame:
    """What ``work(block, own, runs)`` tells of each block: its own columns and runs of its neighbours' columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = ((kind, blob) for batch in batches for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True))
        for block, mine in groupby(records, key=lambda r: r[0] // 2):
            own, left = [], None
            for kind, blob in mine:
                if kind % 2:
                    left = blob
                    break
                own.append(_unpack(blob.as_py()))
            if not own:
                for _ in mine:  # neighbours of no rows
                    pass
                continue

            def runs(left=left, mine=mine):
                held, n = [], 0
                for blob in () if left is None else (left, *()):
                    held.append(_unpack(blob.as_py()))
                    n += len(held[-1][0])
                for _, blob in mine:
                    if n >= RUN_ROWS // 2:
                        yield [np.concatenate(c) for c in zip(*held, strict=True)]
                        held, n = [], 0
                    held.append(_unpack(blob.as_py()))
                    n += len(held[-1][0])
                if held:
                    yield [np.concatenate(c) for c in zip(*held, strict=True)]

            told = work(block, [np.concatenate(c) for c in zip(*own, strict=True)], runs())
            for at in range(0, len(next(iter(told.values()))), RUN_ROWS):
                yield pa.RecordBatch.from_pydict({k: v[at:at + RUN_ROWS] for k, v in told.items()})

    return dealt.mapInArrow(run, schema)


def neighbour_counts(rows: DataFrame, n: int, d: int, eps: float) -> DataFrame:
    """(key, n_near): rows within eps of each row (key, x, core), itself included."""
    def work(block: int, own: list[np.ndarray], runs) -> dict:
        tree = Tree(np.column_stack(own[:d]))
        counts = np.zeros(len(tree.x), np.int64)

        def against(others: np.ndarray) -> None:
            def test(start, end, found):
                mine, theirs = tree.x[start:end], others[found]
                for at, sure, maybe in _products(mine, theirs, eps):
                    counts[start:end] += [np.count_nonzero(r) for r in sure]
                    i, _ = _doubtful(mine, theirs, at, sure, maybe, eps)
                    if len(i):
                        counts[start:end] += np.bincount(i, minlength=end - start)

            tree.meet(others, eps, test)

        for at in range(0, len(tree.x), RUN_ROWS):
            against(tree.x[at:at + RUN_ROWS])
        for columns in runs:
            against(np.column_stack(columns[:d]))
        return {"key": own[d][tree.order], "n": counts}

    dealt, _ = _dealt(rows, n, d, eps, only_core=False, with_keys=False)
    return _over_blocks(dealt, d, work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n_near"))


class Parts:
    """Linked parts of numbered rows; a part's number is its smallest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def grow(self, n: int) -> None:
        self.up = np.concatenate([self.settled(), np.arange(len(self.up), len(self.up) + n)])

    def of(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while True:
            above = self.up[r]
            if (above == r).all():
                return r
            r = above

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.of(i), self.of(j)
        apart = i != j
        while apart.any():
            i, j = i[apart], j[apart]
            np.minimum.at(self.up, np.maximum(i, j), np.minimum(i, j))
            i, j = self.of(i), self.of(j)
            apart = i != j

    def settled(self) -> np.ndarray:
        self.up = self.of(np.arange(len(self.up)))
        return self.up


def linked(rows: DataFrame, n: int, d: int, eps: float) -> DataFrame:
    """(key, head, kind) over rows (key, x, core). Kind 0: a core row and the smallest core row of its part in its block; 1: a core row
    of another block that is linked to the part of that head; 2: a row that is no core row and the head of a part it touches."""
    def work(block: int, own: list[np.ndarray], runs) -> dict:
        tree = Tree(np.column_stack(own[:d]))
        keys, meta = own[d][tree.order], own[d + 1][tree.order]
        h, core = len(keys), meta % 2 == 1
        parts, every, later, touched = Parts(h), [keys], [np.zeros(h, bool)], []

        def against(others: np.ndarray, number: np.ndarray) -> None:
            def test(start, end, found):
                mine, theirs = tree.x[start:end], others[found]
                for at, sure, maybe in _products(mine, theirs, eps):
                    i, j = np.nonzero(sure)
                    more_i, more_j = _doubtful(mine, theirs, at, sure, maybe, eps)
                    i, j = np.concatenate([i, more_i]) + start, number[found[np.concatenate([j + at, more_j])]]
                    both = core[i]
                    parts.link(i[both], j[both])
                    if not both.all():
                        touched.append(np.unique(np.column_stack([i[~both], parts.of(j[~both])]), axis=0))

            tree.meet(others, eps, test)
            if len(touched) > 1:
                pairs = np.concatenate(touched)
                touched[:] = [np.unique(np.column_stack([pairs[:, 0], parts.of(pairs[:, 1])]), axis=0)]

        mine = np.flatnonzero(core)
        for at in range(0, len(mine), RUN_ROWS):
            against(tree.x[mine[at:at + RUN_ROWS]], mine[at:at + RUN_ROWS])
        for columns in runs:
            before = len(parts.up)
            parts.grow(len(columns[0]))
            every.append(columns[d])
            later.append(columns[d + 1] // 2 > block)
            against(np.column_stack(columns[:d]), np.arange(before, len(parts.up)))
        root, all_keys, after = parts.settled(), np.concatenate(every), np.concatenate(later)
        smallest = np.full(len(root), np.iinfo(np.int64).max)
        in_play = np.concatenate([core, np.ones(len(root) - h, bool)])
        np.minimum.at(smallest, root[in_play], all_keys[in_play])
        at = np.flatnonzero(after & (root < h))  # own rows have the smaller numbers, so a part with any has one for its root
        pairs = np.concatenate(touched) if touched else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.column_stack([keys[pairs[:, 0]], smallest[parts.of(pairs[:, 1])]]), axis=0)
        return {"key": np.concatenate([keys[mine], all_keys[at], pairs[:, 0]]), "head": np.concatenate([smallest[root[mine]], smallest[root[at]], pairs[:, 1]]),
                "kind": np.repeat([0, 1, 2], [len(mine), len(at), len(pairs)])}

    dealt, _ = _dealt(rows, n, d, eps, only_core=True, with_keys=True)
    return _over_blocks(dealt, d, work, "key long, head long, kind long")
