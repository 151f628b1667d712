"""DBSCAN against brute force, whatever the chunks and axes."""

import numpy as np
import pytest

from postlab.operators import density


def brute(x, eps, min_samples):
    """Labels by growing clusters from each unseen core row, in order."""
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core, label, k = near.sum(1) >= min_samples, np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = k
            while stack:
                at = stack.pop()
                for j in np.flatnonzero(near[at]):
                    if label[j] < 0:
                        label[j] = k
                        if core[j]:
                            stack.append(j)
            k += 1
    return near.sum(1), label


def frame(spark, x):
    cols = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "post_id long, " + ", ".join(f"{c} double" for c in cols)), cols


@pytest.mark.parametrize("chunk, cell_rows", [(1024, 512), (16, 4)])
def test_equals_brute_force_in_ten_features(spark, monkeypatch, chunk, cell_rows):
    monkeypatch.setattr(density, "CHUNK", chunk)
    monkeypatch.setattr(density, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(density, "MOST_AXES", 3)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, .28, (250, 10)), rng.normal(1.2, .25, (200, 10)), rng.uniform(-3, 3, (150, 10)),
                   np.linspace(0, 6, 120)[:, None] + np.zeros(10) + 4, np.zeros((30, 10)) - 5])
    x = x[rng.permutation(len(x))]
    df, cols = frame(spark, x)
    n_near, label = brute(x, 0.75, 5)
    got = {r.post_id: r.n_near for r in density.core_points(df, cols, 0.75, 5).collect()}
    assert [got[i] for i in range(len(x))] == n_near.tolist()
    got = {r.post_id: r.dbscan_cluster for r in density.dbscan(df, cols, 0.75, 5).collect()}
    assert [got[i] for i in range(len(x))] == label.tolist() and label.max() >= 3


@pytest.mark.parametrize("block_rows", [300, 1])
def test_blocks_of_any_width_and_pairs_one_by_one_agree(spark, monkeypatch, block_rows):
    monkeypatch.setattr(density, "CHUNK", 16)
    monkeypatch.setattr(density, "CELL_ROWS", 4)
    monkeypatch.setattr(density, "MOST_AXES", 2)
    monkeypatch.setattr(density, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, .5, (300, 3)), rng.uniform(-4, 4, (400, 3)), np.full((5, 3), 1e9)])
    df, cols = frame(spark, x)
    rows = density._rows(df, cols, "post_id").selectExpr("key", "x", "false AS core")
    width = density.block_width(density.chunks(rows, [0, 1], 0.75), 2, 10 ** 6)
    assert (width > 0) == (block_rows > 1)
    n_near, label = brute(x, 0.75, 5)
    got = {r.post_id: r.n_near for r in density.core_points(df, cols, 0.75, 5).collect()}
    assert [got[i] for i in range(len(x))] == n_near.tolist()
    got = {r.post_id: r.dbscan_cluster for r in density.dbscan(df, cols, 0.75, 5).collect()}
    assert [got[i] for i in range(len(x))] == label.tolist()


def test_a_chunk_goes_to_few_blocks(spark):
    """Neighbouring cells are met in blocks, so a chunk is not copied for each of its 122 neighbours."""
    cells = spark.range(6 ** 5).selectExpr("concat_ws(',', id % 6, floor(id / 6) % 6, floor(id / 36) % 6, floor(id / 216) % 6, floor(id / 1296)) AS cell")
    sent = cells.select(density._blocks_of(5, 3)).count()
    assert sent < 122 * 6 ** 5 // 10


def test_all_noise_nulls_and_far_axes(spark):
    x = np.zeros((40, 10))
    x[:, 9] = np.arange(40) * 5.0  # equal in nine features, far apart in the tenth
    df, cols = frame(spark, x)
    assert {r.dbscan_cluster for r in density.dbscan(df, cols, 0.75, 3).collect()} == {-1}
    odd = spark.createDataFrame([(1, None, 0.0), (2, float("nan"), 0.0), (3, 0.0, 0.0), (4, 0.1, 0.0)], "post_id long, a double, b double")
    got = {r.post_id: (r.n_near, r.is_core) for r in density.core_points(odd, ["a", "b"], 0.75, 2).collect()}
    assert got == {1: (0, False), 2: (0, False), 3: (2, True), 4: (2, True)}
    assert density.dbscan(df.limit(0), cols, 0.75, 3).count() == 0
