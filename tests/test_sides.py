"""Carving from the sides against a slow version that looks through all cells for each step."""

from __future__ import annotations

import numpy as np
import pytest

from fieldtopo.functions.masks import OFFSETS_26
from fieldtopo.operators import sides
from fieldtopo.operators.carve import strict_test

NX, NY, NZ = 5, 4, 4


def grid(seed):
    rng = np.random.default_rng(seed)
    n = NX * NY * NZ
    val = [int(v) or 1 for v in rng.integers(-9, 10, n)]
    known = [bool(k) for k in rng.random(n) < 0.8]
    return [(7, i, i % NX, i // NX % NY, i // (NX * NY), val[i], known[i]) for i in range(n)]


def near(i):
    x, y, z = i % NX, i // NX % NY, i // (NX * NY)
    out = []
    for dx, dy, dz in OFFSETS_26:
        a, b, c = x + dx, y + dy, z + dz
        out.append((c * NY + b) * NX + a if 0 <= a < NX and 0 <= b < NY and 0 <= c < NZ else None)
    return out


def plain(rows, features, which):
    val, known = [r[5] for r in rows], [r[6] for r in rows]
    n = len(rows)
    carved, wait, order = {}, {-1: set(), 1: set()}, []

    def take(i, s, how=0):
        carved[i] = (s, len(order), how)
        order.append(i)
        known[i], val[i] = True, s * abs(val[i])
        for j in near(i):
            if j is not None and j not in carved and j not in wait[-1] | wait[1] and (val[j] * s > 0 or not known[j]):
                wait[s].add(j)
                known[j], val[j] = True, s * abs(val[j])

    def free(i, s):
        mask = 0
        for b, j in enumerate(near(i)):
            other = s < 0 if j is None else j not in carved or (known[j] and val[j] * s < 0)
            mask |= other << b
        return not strict_test(mask ^ sides.ALL if s < 0 else mask)

    if "o" in which:
        wait[1] = {i for i in range(n) if None in near(i) and (val[i] > 0 or not known[i])}
    if "i" in which:
        take(min(range(n), key=lambda i: (val[i], i)), -1)
    for opening in range(features + 1):
        while wait[-1] or wait[1]:
            _, side, i = min((-abs(val[i]), -s, i) for s in (-1, 1) for i in wait[s])
            wait[-side].discard(i)
            if i not in carved and free(i, -side):
                take(i, -side)
        if opening < features:
            for s in [s for s, k in ((-1, "i"), (1, "o")) if k in which]:
                left = [(-abs(val[i]), i) for i in range(n) if i not in carved and val[i] * s > 0]
                if left:
                    take(min(left)[1], s, opening + 1)
    return {i: (*carved.get(i, (0, -1, 0)), val[i]) for i in range(n)}


@pytest.mark.parametrize("seed,features,which", [(1, 0, "io"), (2, 3, "io"), (3, 2, "i"), (4, 1, "o"), (5, 60, "io")])
def test_fronts_equal_a_search_for_each_step(spark, seed, features, which):
    rows = grid(seed)
    other = [(9, *r[1:]) for r in grid(seed + 100)]
    df = spark.createDataFrame(rows + other, "grid_id long, id long, x int, y int, z int, val long, known boolean").repartition(3)
    got = {(r.grid_id, r.id): (r.side, r.rank, r.opened, r.new_val) for r in sides.carve_sides(df, ["grid_id"], features, which).collect()}
    assert got == {(g, i): v for g, part in ((7, rows), (9, other)) for i, v in plain(part, features, which).items()}


def test_carving_keeps_topology_until_features_open(spark):
    """Without openings, what the outside front leaves is one ball-like piece: it never comes apart and has no tunnel of its own."""
    rows = [(0, i, i % 6, i // 6 % 6, i // 36, 5 if i % 7 else -3, True) for i in range(216)]
    df = spark.createDataFrame(rows, "grid_id long, id long, x int, y int, z int, val long, known boolean")
    out = {r.id: r for r in sides.carve_sides(df, ["grid_id"], 0, "o").collect()}
    ranks = sorted(r.rank for r in out.values() if r.rank >= 0)
    assert ranks == list(range(len(ranks))) and all(r.new_val == rows[r.id][5] for r in out.values() if rows[r.id][6] and r.rank < 0)


def plain_spans(rows, inside, least=None, life=None):
    n, val, known = len(rows), [r[5] for r in rows], [r[6] for r in rows]
    order = {i: k for k, i in enumerate(sorted(range(n), key=lambda i: (val[i], i)))}
    once = [strict_test(sum(1 << b for b, j in enumerate(near(i)) if j is not None and order[j] > order[i])) for i in range(n)]
    way, rank, life, queue, waits = (1 if inside else -1), {}, life or [0] * n, [], set()
    parent = list(range(n))

    def take(i):
        rank[i] = len(rank)
        for j in near(i):
            if j is not None and j not in rank:
                if j not in waits:
                    queue.append((way * val[j], j))
                    waits.add(j)
                    parent[j] = i if inside else parent[j]
                if not inside:
                    parent[j] = i

    if inside:
        take(min(order, key=order.get))
    else:
        border = [i for i in range(n) if None in near(i) and (val[i] > 0 or not known[i])]
        queue += [(-val[i], i) for i in border]
        waits |= set(border)
    while queue and (least is not None or max(life) < n):
        at, i = min(queue)
        queue.remove((at, i))
        waits.discard(i)
        if i in rank:
            continue
        mask = sum(1 << b for b, j in enumerate(near(i)) if (inside if j is None else j not in rank))
        if (least is not None and life[i] >= least) or not strict_test(mask ^ sides.ALL if inside else mask):
            take(i)
        elif least is None and once[i] and (life[i] == 0 or at != way * val[i]):
            life[i] += 1
            queue.append((way * val[i] + life[i], i))
    return {i: (rank.get(i, n - 1), parent[i], life[i]) for i in range(n)}


@pytest.mark.parametrize("inside", [True, False])
def test_life_spans_equal_a_search_for_each_step(spark, inside):
    rows = grid(11)
    df = spark.createDataFrame(rows, "grid_id long, id long, x int, y int, z int, val long, known boolean")
    spans = sides.life_spans(df, ["grid_id"], inside)
    got = {r.id: (r.rank, r.parent, r.life) for r in spans.collect()}
    assert got == plain_spans(rows, inside) and max(v[2] for v in got.values()) > 0
    forced = sides.carve_by_life(df.join(spans.select("grid_id", "id", "life"), ["grid_id", "id"]), ["grid_id"], 2, inside)
    assert {r.id: (r.rank, r.parent, r.life) for r in forced.collect()} == plain_spans(rows, inside, 2, [got[i][2] for i in range(len(rows))])


def test_extra_features(spark):
    rows = [(1, i, s, i, o, v) for i, (s, o, v) in enumerate([(-1, 1, -9), (-1, 2, -5), (-1, 3, -4), (1, 1, 8), (1, 2, 7), (1, 3, 6), (1, 4, 5), (1, 5, 3), (1, 6, 9)])]
    rows += [(2, 0, -1, 0, 1, -3), (2, 1, 1, 1, 1, 3)]
    df = spark.createDataFrame(rows, "grid_id long, id long, side int, rank long, opened int, new_val long")
    assert {r.grid_id: r.extra for r in sides.extra_features(df, ["grid_id"], 2).collect()} == {1: 2, 2: 0}


def test_cells_left_get_the_other_sign(spark):
    rows = [(1, 0, -1, 0, 0, -4), (1, 1, 0, -1, 0, 5), (1, 2, 0, -1, 0, 6), (1, 3, 0, -1, 0, -7), (2, 0, 0, -1, 0, -7), (2, 1, 1, 0, 0, 3)]
    df = spark.createDataFrame(rows, "grid_id long, id long, side int, rank long, opened int, new_val long")
    got = {(r.grid_id, r.id): r.fixed for r in sides.fixed(df, ["grid_id"]).collect()}
    assert got == {(1, 0): -4, (1, 1): 1, (1, 2): 1, (1, 3): 1, (2, 0): -1, (2, 1): 3}
    assert {r.fixed for r in sides.fixed(df, ["grid_id"], -1).where("id = 3").collect()} == {1}


def test_grids_of_one_extent_share_their_neighbours():
    import pandas as pd

    made = [sides._Grid(pd.DataFrame(grid(k), columns=["grid_id", "id", "x", "y", "z", "val", "known"]).sort_values("id")) for k in (3, 4)]
    assert made[0].bits is made[1].bits and made[0].near is made[1].near
    assert all(sides.LAST // bit in {b for b, back in made[0].bits[j] if back == i} for i in range(made[0].n) for bit, j in made[0].bits[i])
