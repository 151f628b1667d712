"""Rows met box by box against brute force, whatever the boxes."""

import numpy as np
import pytest

from postlab.operators import density, halo
from tests.test_density import brute, frame


def rows(rng):
    x = np.vstack([rng.normal(0, .28, (250, 10)), rng.normal(1.2, .25, (200, 10)), rng.uniform(-3, 3, (150, 10)),
                   np.linspace(0, 6, 120)[:, None] + np.zeros(10) + 4, np.zeros((30, 10)) - 5, np.full((5, 10), 1e9)])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("block_rows", [400_000, 60])
def test_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(density, "PAIRED_ROWS", 0)
    monkeypatch.setattr(halo, "BLOCK_ROWS", block_rows)  # 60: many boxes, and some are dealt among several blocks
    x = rows(np.random.default_rng(block_rows))
    df, cols = frame(spark, x)
    n_near, label = brute(x, 0.75, 5)
    got = {r.post_id: r.n_near for r in density.core_points(df, cols, 0.75, 5).collect()}
    assert [got[i] for i in range(len(x))] == n_near.tolist()
    got = {r.post_id: r.dbscan_cluster for r in density.dbscan(df, cols, 0.75, 5).collect()}
    assert [got[i] for i in range(len(x))] == label.tolist() and label.max() >= 3


def test_rows_go_to_few_blocks(spark):
    """A row goes to its own box and those near it: far fewer copies than neighbouring cells."""
    rng = np.random.default_rng(2)
    x = rng.uniform(-1.73, 1.73, (6000, 10))
    df, cols = frame(spark, x)
    from postlab.session import written

    dealt, _ = halo._dealt(density._rows(df, cols, "post_id").selectExpr("key", "x", "false AS core"), 100_000, 10, 0.75, False, False)
    told = written(dealt).collect()
    own = sum(len(halo._unpack(r.blob)[0]) for r in told if r.kind % 2 == 0)
    near = sum(len(halo._unpack(r.blob)[0]) for r in told if r.kind % 2)
    assert own == 6000 and near < 9 * 6000 and len({r.kind // 2 for r in told}) >= 8


def test_packed_columns_come_back():
    rng = np.random.default_rng(3)
    columns = [rng.normal(size=5000), rng.integers(0, 9, 5000) / 7, rng.integers(0, 900, 5000).astype(float), rng.integers(0, 1 << 60, 5000)]
    blob = halo._pack(columns)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, halo._unpack(blob), strict=True))
    assert len(blob) < 5000 * (8 + 1 + 2 + 8) + 10_000


def test_a_tree_meets_what_is_near(monkeypatch):
    monkeypatch.setattr(halo, "LEAF_ROWS", 4)
    monkeypatch.setattr(halo, "WIDE", 7)
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e5):
        x, y = rng.normal(size=(300, 4)) * scale, rng.normal(size=(200, 4)) * scale
        tree, pairs = halo.Tree(x), []

        def test(start, end, found, tree=tree, y=y, pairs=pairs, scale=scale):
            for at, sure, maybe in halo._products(tree.x[start:end], y[found], 0.75 * scale):
                i, j = np.nonzero(sure)
                more = halo._doubtful(tree.x[start:end], y[found], at, sure, maybe, 0.75 * scale)
                pairs += [(int(tree.order[start + u]), int(found[v])) for u, v in [*zip(i, j + at), *zip(*more)]]

        tree.meet(y, 0.75 * scale, test)
        near = ((x[:, None] - y[None]) ** 2).sum(2) <= (0.75 * scale) ** 2
        assert sorted(pairs) == sorted(zip(*map(list, np.nonzero(near)), strict=True))
