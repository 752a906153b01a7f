"""Jobs over whole grids: the array kernels against sweeps and masks of single cells, and what the jobs move."""

import numpy as np
import pytest

from fieldtopo import registry
from fieldtopo.functions.masks import OFFSETS_6, OFFSETS_26
from fieldtopo.operators import whole_grids
from fieldtopo.sources import grids


def made(seed: int, n: int, shape=(4, 5, 6)) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(int(np.prod(shape))).reshape(shape) for _ in range(n)]).astype(np.int32)


def plain_arms(ranks: np.ndarray, offsets) -> np.ndarray:
    """Components of the cells before each cell that it touches, by labels spread anew at every cell."""
    out, label = np.zeros(ranks.shape, int), {}
    for p in sorted(np.ndindex(ranks.shape), key=lambda p: ranks[p]):
        near = [(p[0] + dz, p[1] + dy, p[2] + dx) for dx, dy, dz in offsets]
        found = {label[q] for q in near if q in label}
        out[p] = len(found)
        label = {q: p if v in found else v for q, v in label.items()} | {p: p}
    return out


@pytest.mark.parametrize("offsets", [OFFSETS_26, OFFSETS_6])
def test_arms_equal_labels_spread_anew(offsets):
    ranks = made(1, 5)
    smooth = np.argsort(np.argsort((np.indices((4, 5, 6)).sum(0) * 7 % 5).ravel(), kind="stable")).reshape(1, 4, 5, 6).astype(np.int32)
    for r in (ranks, smooth):
        assert (whole_grids.arms(r, offsets) == np.stack([plain_arms(g, offsets) for g in r])).all()


def test_masks_equal_single_neighbours():
    ranks = made(2, 2, (3, 4, 5))
    mask = whole_grids.lower_mask(ranks)
    for g, z, y, x in np.ndindex(ranks.shape):
        want = 0
        for i, (dx, dy, dz) in enumerate(OFFSETS_26):
            q = (z + dz, y + dy, x + dx)
            if all(0 <= c < n for c, n in zip(q, ranks.shape[1:], strict=True)) and ranks[(g, *q)] < ranks[g, z, y, x]:
                want |= 1 << i
        assert mask[g, z, y, x] == want


@pytest.mark.parametrize("name", ["block_criticals", "block_euler", "block_tree_classes"])
def test_the_table_is_dealt_out_once_and_no_neighbourhood_moves(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan


def test_sparse_and_dense_grids_agree(spark, sf_dir):
    sparse = {(r.grid_id, r.id): r.val for r in grids.sparse_blocks(spark, sf_dir).where("id IS NOT NULL").collect()}
    dense = {(r.grid_id, r.id): r.val for r in grids.shipped_blocks(spark, sf_dir).where("val <> 0").collect()}
    assert {k: v for k, v in sparse.items() if v} == dense
