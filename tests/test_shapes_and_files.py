"""Marching cubes, voxelisation, filters, 4-D tests and files, against plain versions, closed forms and round trips."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtopo.functions import arrays
from fieldtopo.operators import filters, marching, mesh, voxelise
from fieldtopo.sources import mesh_files, synthetic, volumes
from fieldtopo.sources.grids import Dims
from fieldtopo.sources.shared import written


def path_of(spark, suffix):
    return written(spark.range(1), "test")[1] + suffix


def test_every_case_cuts_its_cube():
    for case in range(256):
        tris = marching.triangles_of(case)
        sides = Counter((t[i], t[(i + 1) % 3]) for t in tris for i in range(3))
        assert {e for t in tris for e in t} == {k for k, (a, b, _) in enumerate(marching.EDGES) if (case >> a & 1) != (case >> b & 1)}
        assert max(sides.values(), default=1) == 1
        for a, b in sides:  # open sides lie on a face, inner ones on none
            assert bool(marching._FACES_OF[a] & marching._FACES_OF[b]) == ((b, a) not in sides)


def test_neighbouring_cubes_meet_without_gaps(spark):
    """Noise on a grid: every edge is held by two triangles, once in either direction."""
    rng = np.random.default_rng(1)
    dims = Dims(6, 5, 7)
    rows = [(i, i % 6, i // 6 % 5, i // 30, int(v)) for i, v in enumerate(rng.integers(0, 2, dims.n))]
    lattice = marching.with_margin(spark.createDataFrame(rows, "id long, x int, y int, z int, val long"), dims, 9)
    tris = marching.surface(lattice, dims, 1).collect()
    sides = Counter(p for r in tris for p in ((r.a, r.b), (r.b, r.c), (r.c, r.a)))
    assert tris and set(sides.values()) == {1} and all((b, a) in sides for a, b in sides)
    assert {r.v for r in marching.vertices(lattice, 1).collect()} == {v for r in tris for v in (r.a, r.b, r.c)}


@pytest.mark.parametrize("name,chi", [("sphere", 2), ("torus", 0)])
def test_known_surfaces_and_back(spark, name, chi):
    dims = Dims(20, 20, 12)
    shape = synthetic.sphere(4.3, 9.1, 9.2, 5.4) if name == "sphere" else synthetic.torus(6.1, 2.3, 9.1, 9.2, 5.4)
    cells = synthetic.field(spark, dims, shape).cache()
    lattice = marching.with_margin(cells, dims, 10**6)
    tris, verts = marching.surface(lattice, dims, 0).cache(), marching.vertices(lattice, 0)
    edges = mesh.edges(tris)
    assert verts.count() - edges.count() + tris.count() == chi and edges.where("n <> 2").count() == 0
    want = {r.id for r in cells.where("val < 0").collect()}
    assert {r.id for r in voxelise.voxelised(tris, verts, dims).collect()} == want
    for axis in "xyz":
        assert {r.id for r in voxelise.voxelised(tris, verts, dims, axis).collect()} == want


def test_masks_override_signs(spark):
    rows = [(v, o, k, c) for v in (-3.0, 0.0, 5.0) for o in (True, False) for k in (True, False) for c in (True, False)]
    df = spark.createDataFrame(rows, "v double, o boolean, k boolean, c boolean")
    plain, marked = marching.masked(F.col("v"), F.col("o"), F.col("k")), marching.masked(F.col("v"), F.col("o"), F.col("k"), F.col("c"), 1)
    for r in df.select("*", plain[0].alias("pv"), plain[1].alias("ps"), marked[0].alias("mv"), marked[1].alias("ms")).collect():
        signed = abs(r.v) * (1 if r.o else -1)
        assert (r.pv, r.ps) == ((signed, 0) if r.k else (r.v, 1))
        want = (signed, 0 if r.k else 1) if r.c else (-0.5, 1) if r.v > 0 or not r.k else (r.v, 0)
        assert (r.mv, r.ms) == want


def test_shafts_one_after_the_other(spark):
    rng = np.random.default_rng(4)
    dims = Dims(7, 3, 8)
    inside = rng.integers(0, 2, (dims.nz, dims.ny, dims.nx)).astype(bool)
    inside[:, 0, :] = np.indices((8, 7)).sum(0) % 2 == 0  # a board, where every cell stands alone
    rows = [(int((z * 3 + y) * 7 + x), x, y, z, bool(inside[z, y, x])) for z in range(8) for y in range(3) for x in range(7)]
    got = {r.id: r.inside for r in voxelise.without_shafts(spark.createDataFrame(rows, "id long, x int, y int, z int, inside boolean"), dims).collect()}
    now = inside.copy()
    for y, x, z in itertools.product(range(3), range(1, 6), range(1, 7)):
        if all(now[z + dz, y, x + dx] != now[z, y, x] for dx, dz in ((-1, 0), (0, -1), (1, 0), (0, 1))):
            now[z, y, x] = ~now[z, y, x]
    assert got == {i: bool(now[z, y, x]) for i, x, y, z, _ in rows} and (now != inside).any()


def test_straight_distances(spark):
    rng = np.random.default_rng(2)
    dims = Dims(6, 5, 4)
    holes = set(rng.choice(dims.n, 40, replace=False).tolist())
    cells = {i: (i % 6, i // 6 % 5, i // 30) for i in range(dims.n) if i not in holes}
    seeds = sorted(cells)[:2]
    df = spark.createDataFrame([(i, *p, i in seeds) for i, p in cells.items()], "id long, x int, y int, z int, seed boolean")
    best = {i: 0.0 for i in seeds}
    while True:  # until nothing gets nearer
        new = {j: min([best.get(j, math.inf)] + [best[i] + math.dist(cells[i], q) for i in best if max(abs(a - b) for a, b in zip(cells[i], q, strict=True)) <= 1]) for j, q in cells.items()}
        new = {j: v for j, v in new.items() if v < math.inf}
        if new == best:
            break
        best = new
    for delta in (0.5, 100.0):
        got = {r.id: r.dist for r in filters.straight_distances(df, delta=delta).collect()}
        assert got.keys() == best.keys() and all(abs(got[i] - best[i]) < 1e-9 for i in best)


def test_signs_stay_in_the_gaussian(spark):
    dims = Dims(6, 6, 6)
    rng = np.random.default_rng(3)
    rows = [(i, i % 6, i // 6 % 6, i // 36, float(v), bool(k)) for i, (v, k) in enumerate(zip(rng.normal(0, 2, dims.n), rng.integers(0, 2, dims.n), strict=True))]
    got = filters.gaussian(spark.createDataFrame(rows, "id long, x int, y int, z int, val double, known boolean"), dims, 3).collect()
    old = {r[0]: r for r in rows}
    moved = 0
    for r in got:
        v, fixed = old[r.id][4], old[r.id][5] or not all(1 <= c <= 4 for c in (r.x, r.y, r.z))
        assert (r.val == v) if fixed else (r.val < 0) == (v < 0) and abs(r.val) >= filters.LEAST
        moved += r.val != v
    assert moved > 10


def test_4d_strict_test_equals_graph_search():
    rng = np.random.default_rng(6)
    lo, hi = (np.bitwise_and.reduce(rng.integers(0, 1 << 40, (3, 400)), axis=0) for _ in range(2))
    lo[:200] &= rng.integers(0, 1 << 40, 200) & rng.integers(0, 1 << 40, 200)
    hi[:200] &= rng.integers(0, 1 << 40, 200) & rng.integers(0, 1 << 40, 200)
    lo[0], hi[0], lo[1], hi[1] = 0, 0, (1 << 40) - 1, (1 << 40) - 1

    def one(cells):
        left, stack = set(cells), []
        if not left:
            return False
        stack.append(left.pop())
        while stack:
            p = stack.pop()
            for q in [q for q in left if sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1]:
                left.discard(q)
                stack.append(q)
        return not left

    want = []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        marked = {o for i, o in enumerate(arrays.OFFSETS_80) if (a >> i if i < 40 else b >> (i - 40)) & 1}
        closed = {q for q in arrays.OFFSETS_80 if any(all(c in (0, d) for c, d in zip(p, q, strict=True)) for p in marked)}
        rest = set(arrays.OFFSETS_80) - closed
        want.append(not (one(closed) and one(rest)) or sum((-1) ** o.count(0) for o in rest) != 1)
    got = arrays.strict_4d_array(lo, hi)
    assert got.tolist() == want and not all(want)


def test_table_of_masks(spark):
    rows = {r.chunk: bytes(r.bits) for r in arrays.table_rows(spark, 18).collect()}
    bits = np.unpackbits(np.frombuffer(b"".join(rows[k] for k in sorted(rows)), np.uint8), bitorder="little").astype(bool)
    assert sorted(rows) == [0, 1, 2, 3] and (bits == arrays.strict_array(np.arange(1 << 18))).all()
    masks = spark.createDataFrame([([0, 3, 5],), ([],), ([1 << 14 | 1 << 15, 1],), ([1],)], "m array<long>")
    got = [r.c for r in masks.select(arrays.any_strict(F.col("m")).alias("c")).collect()]
    assert got == [bool(arrays.strict_array(np.array(m, np.int64)).any()) for m in ([0, 3, 5], [], [1 << 14 | 1 << 15, 1], [1])]


@pytest.mark.parametrize("suffix", [".t", ".tb", ".bin"])
def test_mesh_files(spark, suffix, monkeypatch):
    monkeypatch.setattr(mesh_files, "ROWS", 7)
    monkeypatch.setattr(mesh_files, "BYTES", 50)
    rng = np.random.default_rng(8)
    tris = [(i, *map(int, rng.integers(0, 25, 3)), i % 3) for i in range(40)]
    verts = [(i, *map(float, rng.normal(0, 100, 3).astype(np.float32)), i % 2) for i in range(25)]
    path = path_of(spark, suffix)
    mesh_files.write_mesh(spark.createDataFrame(tris, mesh_files.TRIANGLES), spark.createDataFrame(verts, mesh_files.VERTICES), path)
    t, v = mesh_files.read_mesh(spark, path)
    blank = (lambda r: (*r[:-1], 0)) if suffix == ".bin" else (lambda r: r)
    assert sorted(map(tuple, t.collect())) == [blank(r) for r in tris]
    for a, b in zip(sorted(map(tuple, v.collect())), map(blank, verts), strict=True):
        assert a[0] == b[0] and a[4] == b[4] and np.allclose(a[1:4], b[1:4], rtol=1e-6)


def test_text_meshes_without_labels(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mesh_files, "BYTES", 9)
    file = tmp_path / "two.t"
    file.write_text("2 4\n0 1 2\n1 2   3\n\n0 0 0\n1 0 0 0 1.5\n0\n-1e-3 2 3")
    t, v = mesh_files.read_mesh(spark, f"file://{file}")
    assert sorted(map(tuple, t.collect())) == [(0, 0, 1, 2, 0), (1, 1, 2, 3, 0)]
    assert sorted(map(tuple, v.collect())) == [(0, 0.0, 0.0, 0.0, 0), (1, 1.0, 0.0, 0.0, 0), (2, 0.0, 1.5, 0.0, 0)][:2] + [(2, 0.0, 1.5, 0.0, 0), (3, -0.001, 2.0, 3.0, 0)]


def test_tree_and_octree_files(spark, monkeypatch):
    monkeypatch.setattr(mesh_files, "ROWS", 5)
    monkeypatch.setattr(mesh_files, "NODES", 3)
    rows = [(i * 2, [i * 2 + 2] * (i < 11), [j for j in (i * 2 - 2,) if j >= 0] * (1 + i % 2)) for i in range(12)]
    path = path_of(spark, ".ctb")
    mesh_files.write_tree(spark.createDataFrame(rows, mesh_files.TREE).repartition(3), path)
    assert sorted(map(tuple, mesh_files.read_tree(spark, path).collect())) == rows
    nodes = [(0, 0, 0, 0, 0.5, 1)] + [(1, k % 2, k // 2 % 2, k // 4, float(k), 1 if k == 5 else 4) for k in range(8)] + [(2, 2 + k % 2, k // 2 % 2, 2 + k // 4, -float(k), 8) for k in range(8)]
    path = path_of(spark, ".dfo")
    mesh_files.write_octree(spark.createDataFrame(nodes, mesh_files.OCTREE).repartition(4), 2, path)
    assert sorted(map(tuple, mesh_files.read_octree(spark, path).collect())) == sorted(nodes)


def test_raw_slabs(spark):
    dims = Dims(4, 3, 5)
    root = path_of(spark, "")
    cells = spark.range(dims.n).select("id", F.floor(F.col("id") / 12).alias("z"), (F.col("id") * 7).alias("val"))
    volumes.write_slabs(cells, dims, root, ".raw", 2).collect()
    assert {r.id: r.val for r in volumes.read_slabs(spark, root, ".raw").collect()} == {i: float(i * 7) for i in range(dims.n)}
