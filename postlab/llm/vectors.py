"""Operator 5, embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. A fixed random rotation spreads that distance evenly;
the rotated vectors are split into blocks of ``BLOCK_DIMS`` coordinates, and each block has the share of the
squared-distance budget that its width has of all coordinates. If a pair is within the whole budget, then in at
least one block it is within the block's share, so joining every block under its own budget loses no pair.

Range join of a block: its first two coordinates are cut into cells as wide as the block's radius, so
partners lie in the same or an adjacent cell. Each pair of adjacent cells is met once, as one work unit; cells of
more than ``CHUNK`` vectors are cut into chunks and each pair of chunks is a unit. In a unit the block distances
(one matrix product) leave few candidates, whose cosine is computed in double precision from the given
components. A pair that several blocks find counts in the first of them. A unit returns each vector's number of links
and the smallest vector of its linked part, never the pairs.

Equal vectors collapse first; their copies count as links of one another and are not compared again.

Defined results: null, empty or zero vectors, vectors with a null or non-finite component, and rows with a null id
link with nothing; vectors of different length link with nothing; repeated rows count as other vectors; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.llm.common import written
from postlab.llm.graph import components

COSINE = 0.9
BLOCK_DIMS = 16
CHUNK = 16_384
#: Rows of a unit compared against all others at once.
TILE = 512
SEED = 5
#: Room for rounding in the filters; the final comparison has none.
SLACK = 1e-6
#: Adjacent cells, each unordered pair once.
FORWARD = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


@functools.cache
def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    return np.linalg.qr(np.random.default_rng([SEED, dims]).normal(size=(dims, dims)))[0]


def blocks(dims: int) -> list[tuple[int, int]]:
    return [(at, min(at + BLOCK_DIMS, dims)) for at in range(0, dims, BLOCK_DIMS)]


def rotated(unit: np.ndarray) -> np.ndarray:
    """Coordinates summed in a fixed order, so a vector has the same ones in every unit."""
    turn = rotation(unit.shape[1])
    out = np.zeros_like(unit)
    for k in range(unit.shape[1]):
        out += unit[:, k, None] * turn[k]
    return out


def budgets(dims: int, cosine: float) -> list[float]:
    return [(2 - 2 * cosine) * (b - a) / dims + SLACK for a, b in blocks(dims)]


def _parsed(vector) -> np.ndarray | None:
    if vector is None or any(v is None for v in vector):
        return None
    out = np.array(vector, np.float64)
    return out if len(out) and np.isfinite(out).all() and out.any() else None


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def celled(vectors: DataFrame, id_col: str, vector_col: str, cosine: float) -> DataFrame:
    """(row_id, h1, h2, dims, vector, cells) per row; all but the id are null where there is nothing to compare."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    cell_type = pa.list_(pa.struct([("block", pa.int32()), ("x", pa.int32()), ("y", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(5)]
            for doc, raw in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                v = _parsed(raw) if doc.is_valid else None
                if v is None:
                    for c in columns:
                        c.append(None)
                    continue
                dims, whole = len(v), xxhash.xxh3_128_intdigest((v + 0.0).tobytes())
                turned, cells = rotated(_unit(v[None]))[0], []
                for k, ((a, b), budget) in enumerate(zip(blocks(dims), budgets(dims, cosine), strict=True)):
                    width = budget ** 0.5 + SLACK
                    cells.append({"block": k, "x": int(np.floor(turned[a] / width)), "y": int(np.floor(turned[min(a + 1, b - 1)] / width))})
                for c, value in zip(columns, ((whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63), dims, v.tobytes(), cells), strict=True):
                    c.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), cell_type]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                                             names=["row_id", "h1", "h2", "dims", "vector", "cells"])

    return vectors.select(F.col(id_col).alias("row_id"), F.col(vector_col)).mapInArrow(
        run, f"row_id {id_type}, h1 long, h2 long, dims int, vector binary, cells array<struct<block:int,x:int,y:int>>")


def compare_unit(block: int, vectors: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray,
                 cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (weighted by copies) that this block finds first, and the smallest index of each linked part. Rows
    ``left`` are compared with rows ``right``; equal selections compare each pair once."""
    unit = _unit(vectors)
    turned = rotated(unit)
    a, b = blocks(vectors.shape[1])[block]
    limits = budgets(vectors.shape[1], cosine)
    part = turned[:, a:b].astype(np.float32)
    norm = (part * part).sum(axis=1)
    same = left is right
    links, label = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
    for at in range(0, len(left), TILE):
        rows = left[at:at + TILE]
        cols = right[at:] if same else right
        far = norm[rows, None] + norm[cols] - 2 * (part[rows] @ part[cols].T)
        i, j = np.nonzero(far <= limits[block] + SLACK)
        i, j = rows[i], cols[j]
        if same:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), 1 << 16):  # bounded memory where nearly all pairs are close
            p, q = i[cut:cut + (1 << 16)], j[cut:cut + (1 << 16)]
            near = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
            p, q = p[near], q[near]
            square = (turned[p] - turned[q]) ** 2
            first = np.full(len(p), -1)
            for k, (c, d) in reversed(list(enumerate(blocks(vectors.shape[1])))):
                first[square[:, c:d].sum(axis=1) <= limits[k]] = k
            p, q = p[first == block], q[first == block]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            while len(p):  # smallest label over the links found, until nothing moves
                low = np.minimum(label[p], label[q])
                before = label.copy()
                np.minimum.at(label, p, low)
                np.minimum.at(label, q, low)
                np.minimum.at(label, before[p], low)
                np.minimum.at(label, before[q], low)
                label = label[label]
                if (label == before).all():
                    break
    return links, label


def units_of(reps: DataFrame, chunk: int) -> DataFrame:
    """Deal the vectors to work units (dims, block, cell and chunk, adjacent cell and chunk)."""
    placed = reps.select("node", "dims", "vector", "copies", F.explode("cells").alias("c")).select(
        "node", "dims", "vector", "copies", "c.*")
    # at most (2 / cell width + 1) ** 2 cells a block, whatever the number of vectors
    cells = written(placed.groupBy("dims", "block", "x", "y").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")), "vector-cells")
    steps = F.array(*[F.struct(F.lit(dx * s).alias("dx"), F.lit(dy * s).alias("dy"), F.lit(s > 0).alias("ahead"))
                      for dx, dy in FORWARD for s in ((1, -1) if (dx, dy) != (0, 0) else (1,))])
    own = cells.withColumnRenamed("chunks", "own_chunks")
    other = cells.select(F.col("dims").alias("od"), F.col("block").alias("ob"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("chunks").alias("other_chunks"))
    pairs = own.withColumn("step", F.explode(steps)).select("*", "step.*").drop("step")
    hit = (F.col("od") == F.col("dims")) & (F.col("ob") == F.col("block")) & (F.col("ox") == F.col("x") + F.col("dx")) & (F.col("oy") == F.col("y") + F.col("dy"))
    pairs = pairs.join(other, hit).select("dims", "block", "x", "y", "dx", "dy", "ahead", "own_chunks", "other_chunks")
    rows = placed.join(F.broadcast(pairs), ["dims", "block", "x", "y"])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("own_chunks")).cast("int"))
    rows = rows.withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("other_chunks") - 1)))
    within = (F.col("dx") == 0) & (F.col("dy") == 0)
    here = F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.col("chunk").alias("n"))
    there = F.struct((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), F.col("facing").alias("n"))
    is_left = F.when(within, F.col("chunk") <= F.col("facing")).otherwise(F.col("ahead"))
    return rows.select("dims", "block", F.when(is_left, here).otherwise(there).alias("l"), F.when(is_left, there).otherwise(here).alias("r"),
                       is_left.alias("is_left"), "node", "vector", "copies")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                    chunk: int = CHUNK) -> DataFrame:
    """One row per vector: n_links, component_id, kept."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = written(celled(vectors, id_col, vector_col, cosine), "vector-rows")
    reps = rows.filter("vector IS NOT NULL").groupBy("h1", "h2", "dims").agg(
        F.min("row_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector"), F.any_value("cells").alias("cells"))
    reps = written(reps, "vector-classes")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = key[2], key[3]
        flags = pdf["is_left"].to_numpy()
        same = left == right
        if not same and (flags.all() or not flags.any()):
            return pd.DataFrame({"node": [], "links": [], "other": []})
        pdf = pdf.sort_values(["node", "is_left"])
        flags = pdf["is_left"].to_numpy()
        data = np.frombuffer(b"".join(pdf["vector"]), np.float64).reshape(len(pdf), -1)
        everyone = np.arange(len(pdf))
        links, label = compare_unit(int(key[1]), data, pdf["copies"].to_numpy(), everyone if same else np.flatnonzero(flags),
                                    everyone if same else np.flatnonzero(~flags), cosine)
        nodes = pdf["node"].to_numpy()
        hit = links > 0
        return pd.DataFrame({"node": nodes[hit], "links": links[hit], "other": nodes[label][hit]})

    units = units_of(reps, chunk).groupBy("dims", "block", "l", "r").applyInPandas(run, f"node {id_type}, links long, other {id_type}")
    units = written(units, "vector-units")
    links = written(units.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links")), "vector-links")
    labels = components(units.filter("node <> other").select("node", "other"), "node", "other")
    found = links.join(labels, F.col("linked") == F.col("node"), "left").select(F.col("linked").alias("found_node"), "links", "root")
    told = reps.select("h1", "h2", "dims", "node", "copies").join(found, F.col("node") == F.col("found_node"), "left")
    told = written(told.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("dims").alias("c3"), F.coalesce("root", "node").alias("component_id"),
                               (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-told")
    rows = rows.select("row_id", "h1", "h2", "dims")
    out = rows.join(told, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("dims") == F.col("c3")), "left")
    component = F.coalesce("component_id", "row_id")
    return out.select(F.col("row_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), (F.col("row_id").eqNullSafe(component)).alias("kept"))
