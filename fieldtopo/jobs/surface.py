"""Jobs over surfaces: cube cases, edge crossings, voxel-face meshes, components and Betti numbers, parity voxelisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import flood, mesh, order, stencil
from ..sources import grids
from ..sources.grids import LI, LI_SMALL
from .common import ORDERED, job

ISO, ISO_SMALL = 70, 1750


def _corner_sql(nx: int, ny: int, d) -> str:
    return f"(((z + {d[2]}) * {ny + 1} + y + {d[1]}) * {nx + 1} + x + {d[0]})"


def _tri_sql(nx: int, ny: int, nz: int, iso: int) -> str:
    """Triangles of every sign change between face neighbours, stated pair by pair."""
    parts = []
    for f, (step, corners) in enumerate(mesh.FACES.items()):
        p = [_corner_sql(nx, ny, d) for d in corners]
        join = " AND ".join(f"n.{a} = m.{a} + {k}" for a, k in zip("xyz", step, strict=True))
        for k, (i, j, m) in enumerate(((0, 1, 2), (0, 2, 3))):
            turned = [p[0], p[3], p[2], p[1]]
            parts.append(f"SELECT id * 6 + {2 * f + k} AS t, CASE WHEN i THEN {p[i]} ELSE {turned[i]} END AS a, CASE WHEN i THEN {p[j]} ELSE {turned[j]} END AS b, CASE WHEN i THEN {p[m]} ELSE {turned[m]} END AS c FROM (SELECT m.id, m.x, m.y, m.z, m.val < {iso} AS i FROM g m JOIN g n ON {join} WHERE (m.val < {iso}) <> (n.val < {iso}))")
    return "tris AS (" + " UNION ALL ".join(parts) + ")"


_TRIS, _TRIS_SMALL = _tri_sql(16, 16, 84, ISO), _tri_sql(8, 8, 12, ISO_SMALL)
_EDGES = "sides AS (SELECT least(a, b) AS u, greatest(a, b) AS v, t FROM tris UNION ALL SELECT least(b, c), greatest(b, c), t FROM tris UNION ALL SELECT least(c, a), greatest(c, a), t FROM tris), edges AS (SELECT u, v, count(*) AS n FROM sides GROUP BY ALL)"


def _tris(spark, sf_dir):
    return mesh.voxel_faces(grids.shipped(spark, sf_dir), LI, F.col("val") < ISO)


def _tris_small(spark, sf_dir):
    return mesh.voxel_faces(grids.shipped_small(spark, sf_dir), LI_SMALL, F.col("val") < ISO_SMALL)


_BITS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]  # corner of each bit of a cube's case


@job("\n---\nSELECT cfg, count(*) AS n FROM (SELECT " + " + ".join(f"CASE WHEN c{i}.val < {ISO} THEN {1 << i} ELSE 0 END" for i in range(8)) + " AS cfg FROM g c0 " + " ".join(f"JOIN g c{i} ON c{i}.x = c0.x + {d[0]} AND c{i}.y = c0.y + {d[1]} AND c{i}.z = c0.z + {d[2]}" for i, d in enumerate(_BITS) if i) + ") GROUP BY cfg", "li", "cfg n")
def cube_cases(spark, sf_dir):
    """How often each of the 256 marching-cubes cases occurs: bit i is set where corner i lies below the isovalue."""
    cells = stencil.block(grids.shipped(spark, sf_dir).withColumn("below", F.col("val") < ISO), "below")
    whole = (F.col("x") < LI.nx - 1) & (F.col("y") < LI.ny - 1) & (F.col("z") < LI.nz - 1)
    cfg = sum((F.when(stencil.at(d), 1 << i).otherwise(0) for i, d in enumerate(_BITS)), F.lit(0))
    return cells.where(whole).groupBy(cfg.alias("cfg")).agg(F.count("*").alias("n"))


@job(" \n---\n" + " UNION ALL ".join(f"SELECT {i} AS axis, a.id, greatest(0, least(1000, floor(1000.0::DOUBLE * ({ISO} - a.val) / (b.val - a.val)))) AS per_mille FROM g a JOIN g b ON b.x = a.x + {d[0]} AND b.y = a.y + {d[1]} AND b.z = a.z + {d[2]} WHERE (a.val < {ISO}) <> (b.val < {ISO})" for i, d in enumerate([(1, 0, 0), (0, 1, 0), (0, 0, 1)])), "li", "axis id per_mille")
def edge_crossings(spark, sf_dir):
    """Where the isosurface crosses the grid's edges, in thousandths of the edge."""
    cells = stencil.block(grids.shipped(spark, sf_dir), "val")
    steps = F.array(*[F.struct(F.lit(i).alias("axis"), stencil.at(d).alias("far")) for i, d in enumerate([(1, 0, 0), (0, 1, 0), (0, 0, 1)])])
    each = cells.select("id", "val", F.explode(steps).alias("s")).select("id", "val", "s.axis", "s.far").where((F.col("val") < ISO) != (F.col("far") < ISO))
    t = F.floor(1000.0 * (ISO - F.col("val")) / (F.col("far") - F.col("val")))
    return each.select("axis", "id", F.greatest(F.lit(0), F.least(F.lit(1000), t)).alias("per_mille"))


@job(f"{_TRIS}\n---\nSELECT t, a, b, c FROM tris", "li", "t a b c")
def voxel_face_mesh(spark, sf_dir):
    return _tris(spark, sf_dir)


@job(f"{_TRIS}, {_EDGES}\n---\nSELECT n AS triangles, count(*) AS n_edges FROM edges GROUP BY n", "li", "triangles n_edges")
def mesh_connectivity(spark, sf_dir):
    """Edges by the number of triangles that hold them: 1 is a boundary, 2 a manifold, more a junction."""
    return mesh.edges(_tris(spark, sf_dir)).groupBy(F.col("n").alias("triangles")).agg(F.count("*").alias("n_edges"))


@job(f"{_TRIS}, {_EDGES}\n---\nSELECT v AS vertex, count(*) AS n_boundary FROM (SELECT u AS v FROM edges WHERE n = 1 UNION ALL SELECT v FROM edges WHERE n = 1) GROUP BY v", "li", "vertex n_boundary")
def boundary_vertices(spark, sf_dir):
    open_edges = mesh.edges(_tris(spark, sf_dir)).where("n = 1")
    return open_edges.select(F.explode(F.array("u", "v")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("n_boundary"))


@job(f"{_TRIS}, {_EDGES}\n---\nSELECT s.t, s.u, s.v, o.t AS partner FROM sides s JOIN sides o ON s.u = o.u AND s.v = o.v AND s.t <> o.t JOIN edges e ON e.u = s.u AND e.v = s.v WHERE e.n = 2", "li", "t u v partner")
def edge_partners(spark, sf_dir):
    """The triangle on the other side of each manifold edge."""
    tris = _tris(spark, sf_dir)
    sides = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    held = tris.select("t", F.explode(sides).alias("e")).groupBy("e.u", "e.v").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n")).where("n = 2")
    pair = F.array(F.struct(F.col("t0").alias("t"), F.col("t1").alias("partner")), F.struct(F.col("t1").alias("t"), F.col("t0").alias("partner")))
    return held.select("u", "v", F.explode(pair).alias("p")).select("p.t", "u", "v", "p.partner")


def _place(v, nx, ny):
    return [f"{v} % {nx + 1}", f"({v} // {nx + 1}) % {ny + 1}", f"{v} // {(nx + 1) * (ny + 1)}"]


_CORNERS = "pos AS (SELECT t, a, b, c, " + ", ".join(f"{e} AS {v}{i}" for v in "abc" for i, e in enumerate(_place(v, 16, 16))) + " FROM tris)"
_CROSS = ", ".join(f"(b{(i + 1) % 3} - a{(i + 1) % 3}) * (c{(i + 2) % 3} - a{(i + 2) % 3}) - (b{(i + 2) % 3} - a{(i + 2) % 3}) * (c{(i + 1) % 3} - a{(i + 1) % 3}) AS n{i}" for i in range(3))


@job(f"{_TRIS}, {_CORNERS}, nrm AS (SELECT a, b, c, {_CROSS} FROM pos)\n---\nSELECT v, sum(n0) AS px, sum(n1) AS py, sum(n2) AS pz FROM (SELECT a AS v, n0, n1, n2 FROM nrm UNION ALL SELECT b, n0, n1, n2 FROM nrm UNION ALL SELECT c, n0, n1, n2 FROM nrm) GROUP BY v", "li", "v px py pz")
def vertex_normals(spark, sf_dir):
    return mesh.vertex_normals(_tris(spark, sf_dir), LI)


@job(f"{_TRIS}, {_CORNERS}\n---\nSELECT min(least(a0, b0, c0)) AS lo_x, max(greatest(a0, b0, c0)) AS hi_x, min(least(a1, b1, c1)) AS lo_y, max(greatest(a1, b1, c1)) AS hi_y, min(least(a2, b2, c2)) AS lo_z, max(greatest(a2, b2, c2)) AS hi_z, count(*) AS n_triangles FROM pos", "li", "lo_x hi_x lo_y hi_y lo_z hi_z n_triangles")
def mesh_bounds(spark, sf_dir):
    """Bounding box over all corners of the triangles."""
    placed = _tris(spark, sf_dir).select("t", F.explode(F.array("a", "b", "c")).alias("v")).select("t", *mesh.corner_place(LI, "v"))
    return placed.agg(*[f(f"v{a}").alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))], (F.count("*") / 3).cast("long").alias("n_triangles"))


@job(f"{_TRIS}, {_CORNERS}\n---\nSELECT t, a, c AS b, b AS c FROM pos WHERE a2 >= 40 AND b2 >= 40 AND c2 >= 40", "li", "t a b c")
def crop_and_reorient(spark, sf_dir):
    """Triangles above a plane, turned over."""
    tris = _tris(spark, sf_dir)
    above = [mesh.corner_place(LI, k)[2] >= 40 for k in "abc"]
    return tris.where(above[0] & above[1] & above[2]).select("t", "a", F.col("c").alias("b"), F.col("b").alias("c"))


_COMPONENTS = f"""{_TRIS_SMALL}, {_EDGES},
links AS (SELECT u AS a, v AS b FROM edges UNION SELECT v, u FROM edges),
reach(s, v) AS (SELECT a, a FROM links UNION SELECT r.s, l.b FROM reach r JOIN links l ON l.a = r.v),
root AS (SELECT s, max(v) AS root FROM reach GROUP BY s),
rooted AS (SELECT t.*, root FROM tris t JOIN root ON root.s = t.a),
names AS (SELECT root, row_number() OVER (ORDER BY min(t)) AS label FROM rooted GROUP BY root),
lab AS (SELECT t, a, b, c, label FROM rooted JOIN names USING (root))"""


@job(f"{_COMPONENTS}\n---\nSELECT t, a, b, c, label FROM lab", "li_small", "t a b c label", recursive=True)
def mesh_components(spark, sf_dir):
    return mesh.labelled(_tris_small(spark, sf_dir))


@job(f"{_COMPONENTS}\n---\nSELECT n_vertices, n_edges, n_triangles, n_components, n_boundary, n_vertices - n_edges + n_triangles AS chi, 2 * n_components - (n_vertices - n_edges + n_triangles) AS b1 FROM (SELECT (SELECT count(DISTINCT a) FROM links) AS n_vertices, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM tris) AS n_triangles, (SELECT count(*) FROM names) AS n_components, (SELECT count(*) FROM edges WHERE n = 1) AS n_boundary)", "li_small", "n_vertices n_edges n_triangles n_components n_boundary chi b1", recursive=True)
def betti_numbers(spark, sf_dir):
    """Counts, Euler characteristic and 2 * components - chi: the first Betti number where no edge is a boundary (n_boundary 0)."""
    tris = _tris_small(spark, sf_dir)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = n(mesh.vertices(tris), "n_vertices").crossJoin(n(mesh.edges(tris), "n_edges")).crossJoin(n(tris, "n_triangles"))  # single rows
    parts = parts.crossJoin(mesh.labelled(tris).agg(F.coalesce(F.max("label"), F.lit(0)).alias("n_components"))).crossJoin(n(mesh.edges(tris).where("n = 1"), "n_boundary"))
    chi = F.col("n_vertices") - F.col("n_edges") + F.col("n_triangles")
    return parts.select("*", chi.alias("chi"), (2 * F.col("n_components") - chi).alias("b1"))


@job(f"{_COMPONENTS}, size AS (SELECT label, count(*) AS n FROM lab GROUP BY label), best AS (SELECT label FROM size ORDER BY n DESC, label LIMIT 1)\n---\nSELECT t, label, label = (SELECT label FROM best) AS largest FROM lab WHERE label IN (SELECT label FROM size WHERE n >= 12)", "li_small", "t label", "largest", recursive=True)
def large_components(spark, sf_dir):
    """Components of at least a dozen triangles, the largest one marked."""
    tris = mesh.labelled(_tris_small(spark, sf_dir))
    sizes = tris.groupBy("label").agg(F.count("*").alias("n"))
    best = sizes.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("best"))
    kept = sizes.where("n >= 12").crossJoin(F.broadcast(best))  # one row
    return tris.join(kept, "label").select("t", "label", (F.col("label") == F.col("best")).alias("largest"))


@job(f"""\n---\nSELECT id, count(*) FILTER (flip) OVER (PARTITION BY x, z ORDER BY y) % 2 = 1 AS odd FROM (SELECT *, (val < {ISO}) <> (coalesce(lag(val) OVER (PARTITION BY x, z ORDER BY y), {ISO}) < {ISO}) AS flip FROM g)""", "li", "id", "odd")
def inside_by_parity(spark, sf_dir):
    """Inside again from the crossings along y: a cell is inside after an odd number of them."""
    w = Window.partitionBy("x", "z").orderBy("y")
    flip = (F.col("val") < ISO) != (F.coalesce(F.lag("val").over(w), F.lit(ISO)) < ISO)
    crossed = grids.shipped(spark, sf_dir).withColumn("flip", flip.cast("int"))
    return crossed.select("id", (F.sum("flip").over(w) % 2 == 1).alias("odd"))


_FLOOD = f"""s AS (SELECT id, x, y, z, val < {ISO_SMALL} AS inside FROM g),
near AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1)"""


@job(f"""{_FLOOD}, seeds AS (SELECT DISTINCT a.id FROM s a JOIN near n ON n.a = a.id JOIN s b ON b.id = n.b WHERE a.inside <> b.inside),
d(id, dist) AS (SELECT id, 0 FROM seeds UNION SELECT n.b, d.dist + 1 FROM d JOIN near n ON n.a = d.id WHERE d.dist < 30)
---
SELECT id, min(dist) AS dist FROM d GROUP BY id""", "li_small", "id dist", recursive=True)
def layered_distance(spark, sf_dir):
    """Steps over faces to the nearest cell beside a sign change."""
    cells = stencil.block(grids.shipped_small(spark, sf_dir).withColumn("inside", F.col("val") < ISO_SMALL), "inside")
    changes = [F.coalesce(stencil.at(o) != F.col("inside"), F.lit(False)).cast("int") for o in stencil.OFFSETS_6]
    return flood.distances(cells.select("id", "x", "y", "z", (F.greatest(*changes) == 1).alias("seed")))


@job(f"""{ORDERED}, n AS (SELECT a.id AS a, b.id AS b FROM o a JOIN o b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.id <> b.id WHERE b.val <= {ISO_SMALL} AND a.val <= {ISO_SMALL}),
f(id) AS (SELECT arg_min(id, ord) FROM o UNION SELECT n.b FROM f JOIN n ON n.a = f.id)
---
SELECT id FROM f""", "li_small", "id", recursive=True)
def flood_from_minimum(spark, sf_dir):
    """The cells at or below a level that the grid's least cell floods to, over vertex neighbours."""
    cells = order.ranked(grids.shipped_small(spark, sf_dir))
    seed = cells.where("ord = 0").select("id").first()["id"]  # one row
    return flood.filled(cells.where(F.col("val") <= ISO_SMALL), seed)


@job(f"""p AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.z = b.z AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 WHERE a.val < {ISO_SMALL} AND b.val < {ISO_SMALL}),
r(id, v) AS (SELECT a, a FROM p UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.v),
c AS (SELECT id, max(v) AS label, id // 64 AS z FROM r GROUP BY id)
---
SELECT c.z, c.label, d.label AS next_label, count(*) AS shared FROM c JOIN c d ON d.z = c.z + 1 AND d.id = c.id + 64 GROUP BY ALL""", "li_small", "z label next_label shared", recursive=True)
def slice_tracking(spark, sf_dir):
    """Contours of each slice and those of the next that lie above them."""
    inside = grids.shipped_small(spark, sf_dir).where(F.col("val") < ISO_SMALL)
    named = flood.labelled(inside, ["z"], [o for o in stencil.OFFSETS_26 if o[2] == 0])
    after = named.select((F.col("z") - 1).alias("z"), (F.col("id") - LI_SMALL.slice).alias("id"), F.col("label").alias("next_label"))
    return named.join(after, ["z", "id"]).groupBy("z", "label", "next_label").agg(F.count("*").alias("shared"))
