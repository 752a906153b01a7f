"""Trees of bricks and contour trees against sweeps and pruning in one piece."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtopo.functions.masks import OFFSETS_6, OFFSETS_26
from fieldtopo.operators import bricks, contour_tree
from fieldtopo.sources.grids import Dims


def volume(spark, dims, seed, kind="noise", keys=()):
    """Cells with ord and rev; values of few levels, so that ties are many."""
    rng = np.random.default_rng(seed)
    rows, orders = [], {}
    for key in keys or [None]:
        z, y, x = np.meshgrid(*(np.arange(n) for n in (dims.nz, dims.ny, dims.nx)), indexing="ij")
        smooth = np.sin(x / 2.0 + rng.random()) + np.cos(y / 3.0) * np.sin(z / 2.0 + 1)
        value = {"noise": rng.integers(0, 9, dims.n), "smooth": (smooth.ravel() * 20).astype(int), "slope": (x + y + z).ravel(), "flat": np.zeros(dims.n, int)}[kind]
        order = np.lexsort((np.arange(dims.n), value))
        rank = np.empty(dims.n, int)
        rank[order] = np.arange(dims.n)
        orders[key] = rank
        cells = zip(x.ravel().tolist(), y.ravel().tolist(), z.ravel().tolist(), rank.tolist(), strict=True)
        rows += [(key if key is not None else 0, i, *c, dims.n - 1 - c[3]) for i, c in enumerate(cells)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "grid_id long, id long, x int, y int, z int, ord long, rev long")
    return (df if keys else df.drop("grid_id")), orders


def swept(rank, dims, offsets):
    """Each cell's upper by union-find over the whole volume."""
    root, up = list(range(dims.n)), {}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.argsort(rank).tolist():
        x, y, z = i % dims.nx, i // dims.nx % dims.ny, i // dims.slice
        for dx, dy, dz in offsets:
            a, b, c = x + dx, y + dy, z + dz
            if 0 <= a < dims.nx and 0 <= b < dims.ny and 0 <= c < dims.nz:
                j = (c * dims.ny + b) * dims.nx + a
                if rank[j] < rank[i] and (r := find(j)) != i:
                    root[r] = up[r] = i
    return {i: up.get(i) for i in range(dims.n)}


@pytest.mark.parametrize("dims,side,kind", [(Dims(7, 6, 5), 2, "noise"), (Dims(9, 5, 8), 3, "smooth"), (Dims(8, 8, 8), 4, "noise"), (Dims(5, 5, 5), 8, "noise"), (Dims(11, 1, 3), 2, "noise"), (Dims(6, 6, 6), 2, "slope"), (Dims(4, 4, 4), 1, "flat")])
def test_brick_trees_equal_one_sweep(spark, monkeypatch, dims, side, kind):
    monkeypatch.setattr(bricks, "RANKS", 16)  # branches in several blocks
    df, orders = volume(spark, dims, side, kind)
    for rank, order, offsets in ((orders[None], "ord", OFFSETS_26), (dims.n - 1 - orders[None], "rev", OFFSETS_6)):
        cells = df.withColumn("ord", F.col(order))
        got = {r.node: r.upper for r in bricks.tree(cells, dims, offsets, side=side).collect()}
        assert got == swept(rank, dims, offsets)


def test_brick_trees_by_grid_and_in_shares(spark, monkeypatch):
    dims, keys = Dims(10, 6, 4), (3, 7)
    real = bricks.SHARE
    monkeypatch.setattr(bricks, "SHARE", 1)
    df, orders = volume(spark, dims, 5, keys=keys)
    got = {(r.grid_id, r.node): r.upper for r in bricks.tree(df, dims, keys=("grid_id",), side=2).collect()}
    assert got == {(k, i): u for k in keys for i, u in swept(orders[k], dims, OFFSETS_26).items()}
    assert real > 1


def trees_of(spark, dims, rank, key=None):
    up, down = swept(rank, dims, OFFSETS_26), swept(dims.n - 1 - rank, dims, OFFSETS_6)
    return [(key, i, up[i], down[i]) for i in range(dims.n)]


def pruned(rank, dims):
    up, down = swept(rank, dims, OFFSETS_26), swept(dims.n - 1 - rank, dims, OFFSETS_6)
    none = lambda v: -1 if v is None else v
    return set(contour_tree.peel([none(up[i]) for i in range(dims.n)], [none(down[i]) for i in range(dims.n)]))


@pytest.mark.parametrize("kind,most", [("noise", 1 << 17), ("noise", 1), ("smooth", 1), ("slope", 20)])
def test_contour_edges_in_rounds_equal_leaf_by_leaf(spark, kind, most):
    dims, keys = Dims(5, 4, 4), (0, 4)
    _, orders = volume(spark, dims, 9, kind, keys)
    rows = list(itertools.chain(*(trees_of(spark, dims, orders[k], k) for k in keys)))
    trees = spark.createDataFrame(rows, "grid_id long, node long, join_up long, split_down long")
    got = {(r.grid_id, r.lower, r.upper) for r in contour_tree.contour_edges(trees, ["grid_id"], most).collect()}
    want = {(k, *e) for k in keys for e in pruned(orders[k], dims)}
    assert got == want and len(got) == len(keys) * (dims.n - 1)


def test_contour_trees_are_trees_whose_level_sets_are_counted(spark):
    """At every cut between two ranks, as many edges cross it as the cut has contours: components below and above that touch, less one for
    each way around (their graph is a tree in a box)."""
    dims = Dims(4, 4, 3)
    _, orders = volume(spark, dims, 3)
    rank = orders[None]
    edges = pruned(rank, dims)
    place = [(i % dims.nx, i // dims.nx % dims.ny, i // dims.slice) for i in range(dims.n)]

    def parts(cells, near):
        left, n = set(cells), 0
        while left:
            n, stack = n + 1, [left.pop()]
            while stack:
                p = place[stack.pop()]
                for q in [q for q in left if near([abs(a - b) for a, b in zip(p, place[q], strict=True)])]:
                    left.discard(q)
                    stack.append(q)
        return n

    for cut in range(1, dims.n):
        below = [i for i in range(dims.n) if rank[i] < cut]
        above = [i for i in range(dims.n) if rank[i] >= cut]
        crossing = sum(rank[a] < cut <= rank[b] for a, b in edges)
        assert crossing == parts(below, lambda d: max(d) <= 1) + parts(above, lambda d: sum(d) == 1) - 1


def test_group_edges_and_induced_labels(spark):
    """A part's contours that an edge takes in, counted at a cut just over its lower end."""
    dims = Dims(5, 5, 2)
    df, orders = volume(spark, dims, 12)
    rank = orders[None]
    cells = df.withColumn("pair", F.lit(1).cast("long"))
    edges = contour_tree.group_edges(cells, ["pair"])
    assert {(r.lower, r.upper) for r in edges.collect()} == pruned(rank, dims)
    flat = [o for o in OFFSETS_26 if o[2] == 0], [o for o in OFFSETS_6 if o[2] == 0]
    part = contour_tree.group_edges(cells.where("z = 0"), ["pair"], *flat)
    labels = {(r.lower, r.upper): r.label for r in contour_tree.induced_labels(edges, part, ["pair"]).collect()}
    mine = [(r.lower, r.upper) for r in part.collect()]
    for cut in range(1, dims.n):  # labels of the edges that cross a cut add up to the part's edges that cross it
        assert sum(v for (a, b), v in labels.items() if rank[a] < cut <= rank[b]) == sum(rank[a] < cut <= rank[b] for a, b in mine)
    assert contour_tree.group_edges(cells.limit(0), ["pair"]).count() == 0
