"""Orders, stencils, floods, trees, files and carving on small made-up grids."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtopo.operators import carve, flood, mesh, order, query, stencil, trees
from fieldtopo.sources import volumes
from fieldtopo.sources.grids import Dims, address, coordinates

DIMS = Dims(6, 5, 4)


def grid(spark, seed=1, top=9, dims=DIMS):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(top)) for i in range(dims.n)]
    return spark.createDataFrame(rows, "id long, val long").select("id", *coordinates(dims), "val"), dict(rows)


def test_addresses_turn_back(spark):
    cells, _ = grid(spark)
    assert cells.where(address(DIMS) != F.col("id")).count() == 0
    four = Dims(3, 2, 4, 5)
    assert spark.range(four.n).select("id", *coordinates(four)).where(address(four, t="t") != F.col("id")).count() == 0


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_ranks_and_running_extremes(spark, monkeypatch, block):
    monkeypatch.setattr(order, "BLOCK", block)
    cells, val = grid(spark)
    want = {i: r for r, i in enumerate(sorted(val, key=lambda i: (val[i], i)))}
    ranked = order.ranked(cells)
    assert {r.id: r.ord for r in ranked.collect()} == want
    falling = {r.id: r.ord for r in order.ranked(cells, descending=True).collect()}
    assert falling == {i: len(val) - 1 - r for i, r in want.items()}
    carved = cells.withColumn("carve", (F.col("id") * 7) % DIMS.n)
    up = {r.carve: r.m for r in order.running_extreme(carved, "val", "carve", "m").collect()}
    by = {r.carve: r.val for r in carved.collect()}
    assert all(up[c] == max(by[k] for k in range(c + 1)) for c in by)


def test_blocks_hold_the_neighbours(spark):
    cells, val = grid(spark)
    for r in stencil.block(cells, "val").collect():
        for k, v in enumerate(r.around):
            x, y, z = r.x + k % 3 - 1, r.y + k // 3 % 3 - 1, r.z + k // 9 - 1
            inside = 0 <= x < DIMS.nx and 0 <= y < DIMS.ny and 0 <= z < DIMS.nz
            assert v == (val[(z * DIMS.ny + y) * DIMS.nx + x] if inside else None)


def _flood(cells: set, offsets):
    left, out = set(cells), []
    while left:
        part, stack = set(), [left.pop()]
        while stack:
            p = stack.pop()
            part.add(p)
            for o in offsets:
                q = tuple(a + b for a, b in zip(p, o, strict=True))
                if q in left:
                    left.discard(q)
                    stack.append(q)
        out.append(part)
    return out


def test_components_and_distances(spark):
    cells, _ = grid(spark, top=10)
    low = cells.where("val < 3")
    got: dict = {}
    named = {r.id: (r.x, r.y, r.z) for r in low.collect()}
    for r in flood.labelled(low, [], stencil.OFFSETS_26).collect():
        got.setdefault(r.label, set()).add(named[r.id])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, _flood(set(named.values()), stencil.OFFSETS_26)))
    dist = {r.id: r.dist for r in flood.distances(cells.withColumn("seed", F.col("id") == 0)).collect()}
    assert dist == {r.id: r.x + r.y + r.z for r in cells.collect()}


def test_pointers_are_followed(spark):
    chain = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(50)], "id long, at long")
    assert {r["at"] for r in flood.follow(chain).collect()} == {0}


def test_join_trees_follow_the_sublevel_components(spark):
    cells, val = grid(spark, seed=3)
    ranked = order.ranked(cells).withColumn("g", F.lit(1))
    rows = {r.id: r for r in ranked.collect()}
    upper = {r.node: r.upper for r in trees.sweep_tree(ranked, ["g"]).collect()}
    place = {(r.x, r.y, r.z): r.id for r in rows.values()}
    for i in rows:
        first = None
        for p in sorted(rows.values(), key=lambda r: r.ord):
            if p.ord > rows[i].ord:
                level = {(r.x, r.y, r.z) for r in rows.values() if r.ord <= p.ord}
                part = next(c for c in _flood(level, stencil.OFFSETS_26) if (p.x, p.y, p.z) in c)
                if any(place[q] == i for q in part):
                    first = p.id
                    break
        assert upper[i] == first
    kept = trees.contracted(trees.sweep_tree(ranked, ["g"]), ["g"]).collect()
    assert {r.node for r in kept} >= {r.upper for r in kept if r.upper is not None}


def test_windows_cover_their_slices(spark):
    cells, _ = grid(spark, dims=Dims(2, 2, 9))
    got = query.windows(cells, 4, 2, 9).select("window_id", "z").distinct().collect()
    assert sorted((r.window_id, r.z) for r in got) == [(w, w * 2 + k) for w in range(3) for k in range(4)]


def test_window_components_count_minima_and_overlaps(spark):
    cells, _ = grid(spark, seed=5, dims=Dims(5, 5, 8))
    got = query.window_components(order.ranked(cells), 3, 4, 2, 8).collect()
    assert {r.window_id for r in got} == {0, 1, 2}
    for r in got:
        assert r.n_minima >= 1 and r.n_cells >= r.n_minima and r.left_overlap >= 0
    for w in range(3):
        part = {(r.x, r.y, r.z) for r in cells.where(f"val <= 3 AND z BETWEEN {2 * w} AND {2 * w + 3}").collect()}
        assert sorted(len(c) for c in _flood(part, stencil.OFFSETS_26)) == sorted(r.n_cells for r in got if r.window_id == w)


def test_surfaces_are_closed_inside_the_grid(spark):
    dims = Dims(6, 6, 6)
    cells = spark.range(dims.n).select("id", *coordinates(dims))
    ball = F.col("x").between(1, 4) & F.col("y").between(1, 4) & F.col("z").between(1, 4) & ~(F.col("x").between(2, 3) & F.col("y").between(2, 3))
    tris = mesh.voxel_faces(cells, dims, ball)  # a square ring: a torus
    assert mesh.edges(tris).where("n <> 2").count() == 0
    chi = mesh.vertices(tris).count() - mesh.edges(tris).count() + tris.count()
    assert chi == 0 and mesh.labelled(tris).agg(F.max("label")).first()[0] == 1
    total = mesh.vertex_normals(tris, dims).agg(*[F.sum(c) for c in ("px", "py", "pz")]).first()
    assert tuple(total) == (0, 0, 0)


def test_carving_is_a_permutation_with_fewer_criticals(spark):
    cells, _ = grid(spark, seed=9, top=60, dims=Dims(9, 9, 3))
    got = carve.carve(cells, ["z"], 30).collect()
    for z in range(3):
        assert sorted(r.ord for r in got if r.z == z) == list(range(81))
    original = order.ranked_within(cells, ["z"])
    both = original.join(spark.createDataFrame([(r.id, r.ord) for r in got], "id long, carve long"), "id")
    both = stencil.block(stencil.block(both, "ord", axes="xy"), "carve", axes="xy", name="after")
    from fieldtopo.functions.masks import changes_topology_2d as critical

    n = both.agg(F.count_if(critical(stencil.slice_mask("ord"))).alias("a"), F.count_if(critical(stencil.slice_mask("carve", "after"))).alias("b")).first()
    assert n.b < n.a


@pytest.mark.parametrize("suffix", [".v", ".vb", ".v2", ".vo"])
def test_volume_files_turn_back(spark, tmp_path, suffix):
    cells, val = grid(spark)
    root = f"file://{tmp_path}/volume"
    assert volumes.write_slabs(cells.withColumn("val", F.col("val") - (4 if suffix == ".v2" else 0)), DIMS, root, suffix, slices=3).count() == 2
    got = {r.id: r.val for r in volumes.read_slabs(spark, root, suffix).collect()}
    assert got == {i: (float(v) if suffix != ".v2" else (1.0 if v >= 4 else -1.0)) for i, v in val.items()}


def test_bitmap_layout():
    values, known = np.array([1.0, -1.0, 1.0, 1.0, -1.0, 1.0, 1.0, -1.0]), np.array([1, 1, 0, 1, 1, 1, 1, 1], bool)
    data = volumes.encode(".v2", (8, 1, 1), values, known)
    assert len(data) == 12 + 2 * 2 and data[12] == 0b01101101  # a spare byte where n is a multiple of eight
    assert volumes.decode(".v2", data)[1].tolist() == [1, -1, 0, 1, -1, 1, 1, -1]


def test_tree_rows(spark):
    edges = spark.createDataFrame([(1, 3), (2, 3), (3, None)], "node long, upper long")
    got = {r.id: (r.up, r.down) for r in volumes.tree_rows(edges).collect()}
    assert got == {1: ([3], []), 2: ([3], []), 3: ([], [1, 2])}


def _carved_plainly(rows, feature, test, offsets):
    """The rule step by step: a list instead of a heap, masks from sets of places."""
    place = {p: (i, v) for i, p, v in rows}
    queue = [[v, len(rows) + 1, i, p] for i, p, v in rows]
    waiting, done, out = {p for _, p, _ in rows}, {}, {}
    while queue:
        least = min(queue)
        queue.remove(least)
        v, stamp, i, p = least
        waiting.discard(p)
        if p in done:
            continue
        near = [tuple(a + d for a, d in zip(p, o, strict=True)) for o in offsets]
        if done and test(sum(1 << b for b, q in enumerate(near) if q in done)):
            original = stamp == len(rows) + 1
            if original and abs(v - place[p][1]) < feature:
                queue.append([v + 1, stamp, i, p])
                continue
            if not original:
                if stamp < len(done):
                    queue.append([v, len(done), i, p])
                continue
        first = not done
        done[p] = len(done)
        out[i] = done[p], v
        if not first:
            for q in near:
                if q in place and q not in done and q not in waiting:
                    queue.append([v, len(done), place[q][0], q])
                    waiting.add(q)
    return out


@pytest.mark.parametrize("kind", ["slice", "volume", "both"])
def test_carving_equals_the_rule_step_by_step(spark, kind):
    test = {"slice": carve.flat_test, "volume": carve.strict_test, "both": carve.combo_test}[kind]
    cells, val = grid(spark, 5, 30, Dims(5, 5, 3))
    keys = ["z"] if kind == "slice" else ["g"]
    cells = cells.withColumn("g", F.lit(0))
    got = {r.id: (r.ord, r.new_val) for r in carve.carve(cells, keys, 6, test).collect()}
    rows = [(r.id, (r.x, r.y) if kind == "slice" else (r.x, r.y, r.z), r.val, r.z if kind == "slice" else 0) for r in cells.collect()]
    want = {}
    for g in {r[3] for r in rows}:
        want |= _carved_plainly([r[:3] for r in rows if r[3] == g], 6, test, [o for o in stencil.OFFSETS_8] if kind == "slice" else list(stencil.OFFSETS_26))
    assert got == want
    if kind == "slice":
        whole = sorted((r.new_val, r.z, r.ord, r.order) for r in carve.merged(carve.carve(cells, keys, 6, test), "z").collect())
        assert [r[3] for r in whole] == list(range(75))


@pytest.mark.parametrize("test", [carve.strict_4d_test, carve.combo_4d_test])
def test_carving_of_a_series_equals_the_rule_step_by_step(spark, test):
    from fieldtopo.functions.arrays import OFFSETS_80

    rng = random.Random(3)
    rows = [(i, i % 3, i // 3 % 3, i // 9 % 2, i // 18, rng.randrange(12), 0) for i in range(54)]
    cells = spark.createDataFrame(rows, "id long, x int, y int, z int, t int, val long, g int")
    got = {r.id: (r.ord, r.new_val) for r in carve.carve(cells, ["g"], 4, test).collect()}
    assert got == _carved_plainly([(r[0], r[1:5], r[5]) for r in rows], 4, test, OFFSETS_80)


def test_strict_rule_equals_the_column_test(spark):
    masks = [random.Random(i).getrandbits(26) for i in range(300)] + [0, (1 << 26) - 1, 1, 1 << 4, 1 << 12]
    from fieldtopo.functions.masks import changes_topology

    got = {r.m: r.c for r in spark.createDataFrame([(m,) for m in masks], "m long").select("m", changes_topology(F.col("m")).alias("c")).collect()}
    assert all(got[m] == carve.strict_test(m) for m in masks)


@pytest.mark.parametrize("suffix", [".v", ".vb", ".raw", ".v2", ".vo"])
def test_single_files_are_read_by_ranges(spark, tmp_path, monkeypatch, suffix):
    cells, val = grid(spark)
    monkeypatch.setattr(volumes, "CELLS", 17)
    volumes.write_slabs(cells, DIMS, f"file://{tmp_path}/a", suffix, slices=DIMS.nz).collect()
    got = volumes.read_volume(spark, f"file://{tmp_path}/a/slab-000000{suffix}", suffix).collect()
    assert {(r.id, r.x, r.y, r.z) for r in got} == {(r.id, r.x, r.y, r.z) for r in cells.collect()}
    assert all(r.val == ((1.0 if val[r.id] >= 0 else -1.0) if suffix == ".v2" else val[r.id]) for r in got)


@pytest.mark.parametrize("suffix", [".v4d", ".v4db", ".vo4d"])
def test_step_files(spark, tmp_path, suffix):
    dims = Dims(3, 2, 4, 3)
    cells = spark.range(dims.n).select("id", *coordinates(dims), (F.col("id") * 7 % 50).alias("val"))
    one = Dims(3, 2, 4)
    volumes.write_steps(cells, one, f"file://{tmp_path}/s", suffix).collect()
    for t in range(3):
        got = volumes.read_volume(spark, f"file://{tmp_path}/s/step-{t:06d}{suffix}", suffix).orderBy("id").collect()
        assert [int(r.val) for r in got] == [r.val for r in cells.where(F.col("t") == t).orderBy("id").collect()]


def test_flood_from_a_seed_above_the_level(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0), (1, 1, 0, 0), (5, 5, 0, 0)], "id long, x int, y int, z int")
    assert [r.id for r in flood.filled(cells, 9).collect()] == [9]
    assert [r.id for r in flood.filled(cells.where("id < 0"), 9).collect()] == [9]
    assert sorted(r.id for r in flood.filled(cells, 0).collect()) == [0, 1]
