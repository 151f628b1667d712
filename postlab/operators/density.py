"""Density clustering (CLU-11): DBSCAN over all rows and all features, as joins.

Rows are indexed by cells of width eps over a few axes, those that split the rows best. The rows of a cell are dealt
into chunks of bounded size, each chunk packed into one table row, and a chunk meets the chunks of its own and the
neighbouring cells (each pair of chunks once): a block of several cells an axis gathers its chunks and those around it, so
a chunk is sent to a few blocks instead of to all its neighbours. Blocks are as wide as a bounded number of rows allows;
where even blocks of one cell hold more, pairs of chunks are joined one by one over the steps between cells, so those of a
crowded cell spread over many tasks. Every pair is tested exactly, over all features.

1. Neighbours are counted, a row itself included; rows with at least ``min_samples`` are core rows.
2. Core rows within eps are linked. A pair of chunks returns, per row, the smallest row of its linked part, never all links;
   components of these are the clusters, by label joins with chain halving.
3. A row that is no core row joins the first cluster among its core neighbours', else it is noise (-1).

Tables of more than ``PAIRED_ROWS`` rows are met box by box instead (``halo``), as pairs of chunks would be sent too often there.

Clusters are numbered by their smallest core row, which is the order in which a scan along the keys finds them. A row with a
null or NaN feature has no neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.operators import halo
from postlab.operators.star import dense_index
from postlab.session import cut_lineage, written

#: Rows of a chunk, and of a cell on average (more axes are used until then); most axes, as neighbours grow by three with each.
CHUNK, CELL_ROWS, MOST_AXES = 1024, 512, 5
#: Widths of a block in cells, and the rows that one may gather.
BLOCK_WIDTHS, BLOCK_ROWS = (6, 4, 3, 2, 1), 1_000_000
MAX_ROUNDS = 100
#: Rows up to which chunks are paired.
PAIRED_ROWS = 50_000


def default_min_samples(n: int) -> int:
    """2 % of the rows, between 3 and 50."""
    return min(max(3, int(n * 0.02)), 50)


def index_axes(rows: DataFrame, d: int, n: int, eps: float) -> list[int]:
    """The axes whose cells split the rows best, as many as bring a cell to ``CELL_ROWS`` rows if they were independent."""
    cells = rows.select(F.posexplode("x").alias("axis", "v")).groupBy("axis", F.floor(F.col("v") / eps).alias("cell")).count()
    shares = {r["axis"]: r["s"] / n ** 2 for r in cells.groupBy("axis").agg(F.sum(F.col("count").cast("double") ** 2).alias("s")).collect()}  # one row an axis
    axes, left = [], float(n)
    for axis in sorted(shares, key=shares.get)[:MOST_AXES]:
        if left <= CELL_ROWS:
            break
        axes.append(axis)
        left *= shares[axis]
    return axes or list(range(min(1, d)))


def chunks(rows: DataFrame, axes: list[int], eps: float) -> DataFrame:
    """(cell, chunk, keys, xs, cores): rows packed by cell and chunk."""
    rows = rows.withColumn("cell", F.array(*[F.floor(F.get("x", F.lit(a)) / eps).cast("bigint") for a in axes]))
    counts = cut_lineage(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.select(F.col("cell").alias("of"), F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    rows = rows.join(sizes, F.col("cell") == F.col("of")).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        return pd.DataFrame({"cell": [key[0]], "chunk": [key[1]], "keys": [pdf["key"].to_numpy(np.int64).tobytes()],
                             "xs": [np.stack(pdf["x"].to_list()).astype(np.float64).tobytes()],
                             "cores": [pdf["core"].to_numpy(bool).tobytes()]})

    # the cell travels as text, as an array is no pandas grouping key
    rows = rows.withColumn("cell", F.array_join(F.col("cell").cast("array<string>"), ","))
    return written(rows.select("key", "x", "core", "cell", "chunk").groupBy("cell", "chunk").applyInPandas(
        packed, "cell string, chunk int, keys binary, xs binary, cores binary"))


def _steps(axes: int) -> list[tuple[int, ...]]:
    """The steps to equal and neighbouring cells, one of each two opposite ones."""
    return [s for s in product((-1, 0, 1), repeat=axes) if s >= (0,) * axes]


def _blocks_of(axes: int, width: int) -> F.Column:
    """The blocks that meet a chunk's cell from one of their own cells, as texts."""
    cell = F.split("cell", ",").cast("array<bigint>")
    steps = F.array(*[F.array(*[F.lit(v) for v in s]) for s in _steps(axes)])
    block = F.transform(steps, lambda s: F.array_join(F.zip_with(cell, s, lambda u, v: F.floor((u - v) / F.lit(width))).cast("array<string>"), ","))
    return F.explode(F.array_distinct(block)).alias("block")


def block_width(found: DataFrame, axes: int, n: int) -> int:
    """The widest block that gathers a bounded number of rows, a part of all so that every core has blocks; 0 if none does."""
    sizes = written(found.groupBy("cell").agg(F.sum(F.length("cores")).alias("n")))
    for width in BLOCK_WIDTHS:
        most = sizes.select("n", _blocks_of(axes, width)).groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= BLOCK_ROWS and (width == 1 or most <= max(n // 16, CHUNK)):
            return width
    return 0


def chunk_pairs(found: DataFrame, axes: int) -> DataFrame:
    """Each pair of chunks in equal or neighbouring cells once."""
    cell = F.split("cell", ",").cast("array<bigint>")
    around = F.explode(F.array(*[F.array(*[F.lit(v) for v in s]) for s in _steps(axes)])).alias("step")
    a = found.select(*[F.col(c).alias(f"{c}_a") for c in found.columns], cell.alias("at"), around)
    a = a.withColumn("other", F.array_join(F.zip_with("at", "step", lambda u, v: u + v).cast("array<string>"), ",")).drop("at", "step")
    b = found.select(*[F.col(c).alias(f"{c}_b") for c in found.columns])
    return a.join(b, F.col("other") == F.col("cell_b")).filter("cell_a <> cell_b OR chunk_a <= chunk_b").drop("other")


@dataclass
class Chunk:
    keys: np.ndarray
    x: np.ndarray
    core: np.ndarray

    def __post_init__(self):
        self.square = (self.x * self.x).sum(1)
        self.top = float(self.square.max(initial=0.0))
        self.small = self.x.astype(np.float32) if self.top < SINGLE_BELOW else None


#: Square norms below which candidates come from single precision; every candidate is tested in double precision.
SINGLE_BELOW = 1e6


def _chunk(row, d: int, side: str = "") -> Chunk:
    keys, xs, cores = (getattr(row, f"{c}{side}") for c in ("keys", "xs", "cores"))
    return Chunk(np.frombuffer(keys, np.int64), np.frombuffer(xs, np.float64).reshape(-1, d), np.frombuffer(cores, bool))


def _near(a: Chunk, b: Chunk, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows within eps."""
    if a.small is not None and b.small is not None:
        product_, slack = a.small @ b.small.T, 1e-5
    else:
        product_, slack = a.x @ b.x.T, 1e-9
    limit = (a.square - eps * eps - slack * (1.0 + a.top + b.top)).astype(product_.dtype)
    product_ *= 2.0
    product_ -= limit[:, None]
    i, j = np.nonzero(product_ >= b.square.astype(product_.dtype))
    near = ((a.x[i] - b.x[j]) ** 2).sum(1) <= eps * eps
    return i[near], j[near]


def _over_pairs(found: DataFrame, axes: int, n: int, d: int, test: Callable, schema: str) -> DataFrame:
    """What ``test(a, b, same)`` tells of each pair of chunks, as frames; those of a block are summed up."""
    width, steps = block_width(found, axes, n), _steps(axes)
    if not width:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    yield from test(_chunk(row, d, "_a"), _chunk(row, d, "_b"), (row.cell_a, row.chunk_a) == (row.cell_b, row.chunk_b))

        return chunk_pairs(found, axes).mapInPandas(run, schema)

    names = [part.split()[0] for part in schema.split(", ")]

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        home, by_cell, told, held = tuple(map(int, key[0].split(","))), {}, [], 0
        for row in pdf.sort_values(["cell", "chunk"]).itertuples():
            by_cell.setdefault(tuple(map(int, row.cell.split(","))), []).append(_chunk(row, d))
        for cell, own in by_cell.items():
            if tuple(v // width for v in cell) != home:
                continue
            for step in steps:
                others = by_cell.get(tuple(u + v for u, v in zip(cell, step, strict=True)), ())
                for i, a in enumerate(own):
                    for b in others[i:] if others is own else others:
                        for frame in test(a, b, a is b):
                            told.append(frame)
                            held += len(frame)
                        if held > 4 * BLOCK_ROWS:
                            told = [_summed(pd.concat(told))]
                            held = len(told[0]) // 2
        return _summed(pd.concat(told)) if told else pd.DataFrame(columns=names)

    # a given number of partitions, as few bytes here are much work: adaptive merging would leave cores idle
    spark = found.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return found.select("*", _blocks_of(axes, width)).repartition(parts, "block").groupBy("block").applyInPandas(block, schema)


def _summed(told: pd.DataFrame) -> pd.DataFrame:
    """Counts of the same key added up, links told twice once."""
    return told.groupby("key", as_index=False)["n"].sum() if "n" in told else told.drop_duplicates()


def neighbour_counts(found: DataFrame, axes: int, n: int, d: int, eps: float) -> DataFrame:
    """(key, n_near): rows within eps, the row itself included."""
    def test(a: Chunk, b: Chunk, same: bool) -> Iterator[pd.DataFrame]:
        i, j = _near(a, b, eps)
        for chunk, at in [(a, i)] if same else [(a, i), (b, j)]:
            count = np.bincount(at, minlength=len(chunk.keys))
            yield pd.DataFrame({"key": chunk.keys[count > 0], "n": count[count > 0].astype(np.int64)})

    return _over_pairs(found, axes, n, d, test, "key long, n long").groupBy("key").agg(F.sum("n").alias("n_near"))


def _linked(found: DataFrame, axes: int, n: int, d: int, eps: float) -> DataFrame:
    """(key, head, core): for core rows the smallest core row of their linked part in a pair of chunks, for the others
    the heads of the parts they touch."""
    most = np.iinfo(np.int64).max

    def test(a: Chunk, b: Chunk, same: bool) -> Iterator[pd.DataFrame]:
        i, j = _near(a, b, eps)
        core_i, core_j = a.core[i], b.core[j]
        head_a, head_b = np.where(a.core, a.keys, most), np.where(b.core, b.keys, most)
        if same:
            head_b = head_a
        ci, cj = i[core_i & core_j], j[core_i & core_j]
        while len(ci):
            before = head_a.sum(dtype=object) + head_b.sum(dtype=object)
            np.minimum.at(head_a, ci, head_b[cj])
            np.minimum.at(head_b, cj, head_a[ci])
            if head_a.sum(dtype=object) + head_b.sum(dtype=object) == before:
                break
        for chunk, head in [(a, head_a)] if same else [(a, head_a), (b, head_b)]:
            moved = chunk.core & (head < chunk.keys)
            yield pd.DataFrame({"key": chunk.keys[moved], "head": head[moved], "core": True})
        sides = [(a, i, head_b[j], ~core_i & core_j)] + ([] if same else [(b, j, head_a[i], core_i & ~core_j)])
        for chunk, at, head, touch in sides:
            if touch.any():
                yield pd.DataFrame({"key": chunk.keys[at[touch]], "head": head[touch], "core": False}).drop_duplicates()

    return _over_pairs(found, axes, n, d, test, "key long, head long, core boolean")


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of the links (key, head) can reach. Every round a node takes the smallest
    root of its neighbours, then its root's root, so chains halve."""
    edges = cut_lineage(links.select(F.col("key").alias("a"), F.col("head").alias("b")).unionByName(
        links.select(F.col("head").alias("a"), F.col("key").alias("b"))).distinct())
    roots = cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    for _ in range(MAX_ROUNDS):
        near = edges.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("heard"))
        told = cut_lineage(roots.join(near, F.col("node") == F.col("a")).select(
            "node", F.least("root", "heard").alias("root"), (F.col("heard") < F.col("root")).alias("moved")))
        up = told.select(F.col("node").alias("mid"), F.col("root").alias("above"))
        roots = cut_lineage(told.join(up, F.col("root") == F.col("mid")).select("node", F.col("above").alias("root"), "moved",
                                                                               (F.col("above") < F.col("root")).alias("jumped")))
        if roots.filter("moved OR jumped").isEmpty():
            return roots.select("node", "root")
        roots = roots.select("node", "root")
    raise RuntimeError("cluster labels did not settle")


def _rows(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    x = F.array(*[F.col(c).cast("double") for c in cols])
    whole = df.select(F.col(key).alias("key"), x.alias("x"))
    return whole.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


def core_points(df: DataFrame, cols: list[str], eps: float = 0.75, min_samples: int | None = None, key: str = "post_id") -> DataFrame:
    """(key, n_near, is_core) of every row: rows within eps over all columns, itself included, and the core test."""
    n = df.count()
    rows = _rows(df, cols, key).withColumn("core", F.lit(False))
    if n > PAIRED_ROWS:
        counts = written(halo.neighbour_counts(rows, n, len(cols), eps))
    else:
        axes = index_axes(rows, len(cols), n, eps)
        counts = neighbour_counts(chunks(rows, axes, eps), len(axes), n, len(cols), eps)
    out = df.select(F.col(key).alias("own")).join(counts, F.col("own") == F.col("key"), "left")
    near = F.coalesce("n_near", F.lit(0)).cast("bigint")
    return out.select(F.col("own").alias(key), near.alias("n_near"), (near >= (min_samples or default_min_samples(n))).alias("is_core"))


def dbscan(df: DataFrame, cols: list[str], eps: float = 0.75, min_samples: int | None = None, key: str = "post_id") -> DataFrame:
    """(key, dbscan_cluster) of every row; -1 is noise."""
    d = len(cols)
    cores = written(core_points(df, cols, eps, min_samples, key).filter("is_core").select(F.col(key).alias("core_key")))
    if cores.isEmpty():
        return df.select(key, F.lit(-1).cast("int").alias("dbscan_cluster"))
    rows = _rows(df, cols, key).join(cores, F.col("key") == F.col("core_key"), "left")
    rows = written(rows.select("key", "x", F.col("core_key").isNotNull().alias("core")))
    n = df.count()
    if n > PAIRED_ROWS:
        linked = written(halo.linked(rows, n, d, eps))
        local = linked.filter("kind = 0").select(F.col("key").alias("core_key"), F.col("head").alias("part"))
        met = linked.filter("kind = 1").join(local, F.col("key") == F.col("core_key")).select(F.col("part").alias("key"), "head")
        roots = connected(written(met.distinct()))
        heads = local.join(roots, F.col("part") == F.col("node"), "left").select("core_key", F.coalesce("root", "part").alias("head"))
        border = linked.filter("kind = 2")
    else:
        axes = index_axes(rows, d, n, eps)
        linked = written(_linked(chunks(rows, axes, eps), len(axes), n, d, eps))
        roots = connected(linked.filter("core"))
        heads = cores.join(roots, F.col("core_key") == F.col("node"), "left").select("core_key", F.coalesce("root", "core_key").alias("head"))
        border = linked.filter("NOT core")
    heads = written(heads)
    numbers = dense_index(heads.select(F.col("head").alias("first")).distinct(), ["first"], "number", start=0)
    labels = written(heads.join(numbers, F.col("head") == F.col("first")).select("core_key", "number"))
    border = border.join(labels, F.col("head") == F.col("core_key")).groupBy("key").agg(F.min("number").alias("number"))
    every = labels.select(F.col("core_key").alias("key"), "number").unionByName(border.select("key", "number"))
    return df.select(F.col(key).alias("own")).join(every, F.col("own") == F.col("key"), "left").select(
        F.col("own").alias(key), F.coalesce("number", F.lit(-1)).cast("int").alias("dbscan_cluster"))
