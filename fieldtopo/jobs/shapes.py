"""Jobs over meshes turned back into volumes, over filters in passes, and over mesh, tree and octree files."""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import functions as F

from ..operators import bricks, filters, marching, mesh, order, voxelise
from ..operators.order import numbered
from ..sources import grids, mesh_files, volumes
from ..sources.grids import EVENTS, LI, LI_SMALL
from ..sources.shared import written
from .common import ORDERED, job
from .isosurface import _cuts_sql, _lattice, _mesh_sql
from .relations import _JOIN
from .surface import ISO, ISO_SMALL

NEAR = 1e-6


def _mesh(spark, sf_dir, small=True):
    """Triangles and vertices of an isosurface."""
    lattice, dims, iso = _lattice(spark, sf_dir, small)
    return marching.surface(lattice, dims, iso), marching.vertices(lattice, iso), dims


def _between(spark, sf_dir, small=True):
    """The surface half way between the level and the value below it, so that no cell centre lies on it."""
    lattice, dims, iso = _lattice(spark, sf_dir, small)
    lattice = lattice.withColumn("val", 2 * F.col("val"))
    return marching.surface(lattice, dims, 2 * iso - 1), marching.vertices(lattice, 2 * iso - 1), dims


@job(f"\n---\nSELECT id FROM g WHERE val < {ISO_SMALL}", "li_small", "id")
def voxelised_small(spark, sf_dir):
    """The cells inside the small grid's isosurface, from its triangles alone: those below the level."""
    return voxelise.voxelised(*_between(spark, sf_dir))


@job(f"\n---\nSELECT id FROM g WHERE val < {ISO}", "li", "id")
def voxelised_surface(spark, sf_dir):
    """The same for the large grid."""
    return voxelise.voxelised(*_between(spark, sf_dir, False))


@job(f"\n---\nSELECT id FROM g WHERE val < {ISO}", "li", "id")
def voxelised_along_y(spark, sf_dir):
    """Inside by parity along one axis."""
    return voxelise.voxelised(*_between(spark, sf_dir, False), axes="y")


_NEAR_SQL = " ".join(f"abs({a} - round({a})) < {NEAR} AS n{a}," for a in "xyz")


@job(f"{_mesh_sql(LI, ISO)}, s AS (SELECT *, 0 AS suspect FROM p), {_cuts_sql(ISO)}, k AS (SELECT v, {_NEAR_SQL} 1 AS one FROM cuts), c AS (SELECT CASE WHEN nx AND ny AND nz THEN 'all' WHEN nx AND ny THEN 'z' WHEN ny AND nz THEN 'x' WHEN nx AND nz THEN 'y' ELSE 'off' END AS axis FROM k)\n---\nSELECT axis, count(*) AS n FROM c GROUP BY axis", "li", "n", "axis")
def crossing_lists(spark, sf_dir):
    """A surface's vertices by the axis whose scan line they lie on; 'all': at a cell centre, which tells nothing."""
    verts = _mesh(spark, sf_dir, False)[1]
    return verts.groupBy(voxelise.crossing_axis(F.col("x"), F.col("y"), F.col("z"), NEAR).alias("axis")).agg(F.count("*").alias("n"))


@job()
def shafts_removed(spark, sf_dir):
    """Cells that differ from their four neighbours in the plane of x and z, flipped one after the other."""
    cells = grids.shipped(spark, sf_dir).select("id", "x", "y", "z", (F.col("val") < ISO).alias("inside"))
    return voxelise.without_shafts(cells, LI).select("id", "inside")


# --- filters ---

_WEIGHTS: dict[tuple[int, int, int], float] = defaultdict(float)
for _w, _terms in ((filters.W_CORNER, filters._CORNER_TERMS), (filters.W_EDGE, filters._EDGE_TERMS), (filters.W_FACE, filters._FACE_TERMS), (filters.W_CELL, [(0, 0, 0)])):
    for _o in _terms:
        _WEIGHTS[_o] += _w
_PASSES = 3


def _gaussian_sql() -> str:
    inner = " AND ".join(f"c.{a} BETWEEN 1 AND {n - 2}" for a, n in zip("xyz", LI[:3], strict=True))
    parts = [f"w(dx, dy, dz, w) AS (VALUES {', '.join(f'({x}, {y}, {z}, {v!r}::DOUBLE)' for (x, y, z), v in _WEIGHTS.items())})", f"c0 AS (SELECT id, x, y, z, (val - {ISO})::DOUBLE AS val, val > 0 AS known FROM g)"]
    for k in range(_PASSES):
        parts.append(f"m{k} AS (SELECT c.id, sum(w * n.val) / {filters.NORM} AS mean FROM c{k} c CROSS JOIN w JOIN c{k} n ON n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz GROUP BY c.id)")
        parts.append(f"c{k + 1} AS (SELECT c.id, c.x, c.y, c.z, CASE WHEN {inner} AND NOT known THEN CASE WHEN val < 0 THEN least(mean, {-filters.LEAST}) ELSE greatest(mean, {filters.LEAST}) END ELSE val END AS val, known FROM c{k} c JOIN m{k} USING (id))")
    return ", ".join(parts)


@job(f"{_gaussian_sql()}\n---\nSELECT id, CAST(floor(val * 4096 + 0.5) AS BIGINT) AS val FROM c{_PASSES}", "li", "id val")
def masked_gaussian(spark, sf_dir):
    """Three passes of the masked Gaussian: cells without any shipment are unknown and get what their neighbours suggest, on their side of
    the level. In 4096ths."""
    cells = grids.shipped(spark, sf_dir).withColumn("known", F.col("val") > 0).withColumn("val", F.col("val") - ISO)
    return filters.gaussian(cells, LI, _PASSES).select("id", F.floor(F.col("val") * 4096 + 0.5).alias("val"))


_PINS = {(3, 2): 12.0, (8, 1): -1.0}


def _relaxed_sql() -> str:
    pin = " ".join(f"WHEN c.x = {x} AND c.y = {y} THEN {v}" for (x, y), v in _PINS.items())
    parts = ["c0 AS (SELECT id, x, y, z, val::DOUBLE AS val FROM g)"]
    for k in range(4):
        mean = "(count(*) * any_value(c.val) + sum(n.val)) / (2 * count(*))"
        value = f"CASE {pin} ELSE {mean} END" if k < 3 else mean
        parts.append(f"c{k + 1} AS (SELECT c.id, c.x, c.y, c.z, {value} AS val FROM c{k} c JOIN c{k} n ON n.z = c.z AND abs(n.x - c.x) + abs(n.y - c.y) = 1 GROUP BY c.id, c.x, c.y, c.z)")
    return ", ".join(parts)


@job(f"{_relaxed_sql()}\n---\nSELECT id, CAST(floor(val * 4096 + 0.5) AS BIGINT) AS val FROM c4", "events", "id val")
def relaxed_slices(spark, sf_dir):
    """Four passes of relaxation in every slice, two cells pinned in the first three. In 4096ths."""
    return filters.relaxed(grids.activity(spark, sf_dir), EVENTS, _PINS, 4, 3).select("id", F.floor(F.col("val") * 4096 + 0.5).alias("val"))


@job()
def straight_distance(spark, sf_dir):
    """The way over vertex neighbours, in straight steps, to the nearest of the eight least cells. In 4096ths."""
    cells = order.ranked(grids.shipped_small(spark, sf_dir)).withColumn("seed", F.col("ord") < 8)
    return filters.straight_distances(cells).select("id", F.floor(F.col("dist") * 4096 + 0.5).cast("long").alias("dist"))


# --- files ---


def _at(spark, suffix):
    _, root = written(spark.range(1), "files")
    return f"{root}-{uuid.uuid4().hex}{suffix}"


def _numbered_mesh(spark, sf_dir):
    """The large surface with vertices numbered without gaps; a label tells triangles with a vertex in the first slice."""
    tris, verts, _ = _mesh(spark, sf_dir, False)
    names = numbered(mesh.vertices(tris), [F.col("v")], "n")
    named = verts.join(names, "v").select(F.col("n").alias("v"), "x", "y", "z", (F.col("z") < 1).cast("int").alias("label"))
    for corner in "abc":
        tris = tris.join(names.withColumnsRenamed({"v": corner, "n": f"n{corner}"}), corner)
    dense = numbered(tris.select("t", "na", "nb", "nc"), [F.col("t")], "n").select(F.col("n").alias("t"), *[F.col(f"n{k}").alias(k) for k in "abc"])
    low = named.where("label = 1").select(F.col("v").alias("a"), F.lit(1).alias("label"))
    return dense.join(low, "a", "left").select("t", "a", "b", "c", F.coalesce("label", F.lit(0)).alias("label")), named


_NUMBERED = f"""{_mesh_sql(LI, ISO)}, s AS (SELECT *, 0 AS suspect FROM p), {_cuts_sql(ISO)}, names AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS n, CASE WHEN z < 1 THEN 1 ELSE 0 END AS low FROM cuts),
nt AS (SELECT row_number() OVER (ORDER BY t) - 1 AS t, ka.n AS a, kb.n AS b, kc.n AS c, ka.low AS label FROM tris JOIN names ka ON ka.v = a JOIN names kb ON kb.v = b JOIN names kc ON kc.v = c)"""


def _files_of(spark, sf_dir, suffix):
    path = _at(spark, suffix)
    mesh_files.write_mesh(*_numbered_mesh(spark, sf_dir), path)
    return mesh_files.read_mesh(spark, path)


@job(f"{_NUMBERED}\n---\nSELECT t, a, b, c, label FROM nt", "li", "t a b c label")
def mesh_text_file(spark, sf_dir):
    """The surface written as a text mesh file and read back by ranges of bytes: triangles with labels."""
    return _files_of(spark, sf_dir, ".t")[0]


@job(f"{_NUMBERED}\n---\nSELECT t, a, b, c, label FROM nt", "li", "t a b c label")
def mesh_binary_file(spark, sf_dir):
    """The surface written as a binary mesh file and read back: triangles with labels."""
    return _files_of(spark, sf_dir, ".tb")[0]


@job(f"{_NUMBERED}\n---\nSELECT n AS v, CAST(floor(CAST(x AS FLOAT) * 64 + 0.25) AS BIGINT) AS x, CAST(floor(CAST(y AS FLOAT) * 64 + 0.25) AS BIGINT) AS y, CAST(floor(CAST(z AS FLOAT) * 64 + 0.25) AS BIGINT) AS z FROM names JOIN cuts USING (v)", "li", "v x y z")
def mesh_timed_file(spark, sf_dir):
    """The surface written as a mesh file of one time, vertices first, and read back: its vertices in 64ths."""
    verts = _files_of(spark, sf_dir, ".bin")[1]
    return verts.select("v", *[F.floor(F.col(a) * 64 + 0.25).alias(a) for a in "xyz"])


@job(f"{_JOIN}\n---\nSELECT t.node AS id, CASE WHEN t.upper IS NULL THEN '' ELSE CAST(t.upper AS VARCHAR) END AS up, coalesce((SELECT string_agg(CAST(u.node AS VARCHAR), ' ' ORDER BY u.node) FROM tree u WHERE u.upper = t.node), '') AS down FROM tree t", "li_small", "id", "up down", recursive=True)
def tree_file(spark, sf_dir):
    """The volume's join tree written as a tree file and read back: every node's neighbours above and below."""
    edges, path = bricks.tree(order.ranked(grids.shipped_small(spark, sf_dir)), LI_SMALL, side=4), _at(spark, ".ctb")
    mesh_files.write_tree(volumes.tree_rows(edges), path)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return mesh_files.read_tree(spark, path).select("id", text("up"), text("down"))


@job(f"{ORDERED}, seed AS (SELECT z, arg_min(id, ord) AS seed FROM o WHERE z % 4 = 0 GROUP BY z)\n---\nSELECT seed, z AS first, z + 3 AS last FROM seed", "li_small", "seed first last")
def seed_file(spark, sf_dir):
    """The least cell of every fourth slice written as a seed file of windows, and read back."""
    seeds = order.ranked(grids.shipped_small(spark, sf_dir)).where("z % 4 = 0").groupBy("z").agg(F.min_by("id", "ord").alias("seed"))
    lines = seeds.select(F.concat_ws(" ", "seed", "z", F.col("z") + 3).alias("value"))
    path = _at(spark, "")
    lines.unionByName(seeds.agg(F.count("*").cast("string").alias("value"))).coalesce(1).write.text(path)
    return mesh_files.read_seeds(spark, path)
