"""Jobs over isosurfaces by marching cubes: triangles, vertices, labels under masks, components and Betti numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import marching, mesh
from ..sources import grids
from ..sources.grids import LI, LI_SMALL, Dims
from .common import job
from .surface import _EDGES, ISO, ISO_SMALL

OUTSIDE = 1 << 16


def _lattice_sql(dims: Dims) -> str:
    big = marching.padded(dims)
    return f"""p AS (SELECT i AS id, i % {big.nx} - 1 AS x, (i // {big.nx}) % {big.ny} - 1 AS y, i // {big.slice} - 1 AS z, coalesce(g.val, {OUTSIDE}) AS val
  FROM range({big.n}) r(i) LEFT JOIN g ON g.x = i % {big.nx} - 1 AND g.y = (i // {big.nx}) % {big.ny} - 1 AND g.z = i // {big.slice} - 1)"""


def _mesh_sql(dims: Dims, iso: int) -> str:
    """Cubes' cases, to which every cell adds a bit for each cube that it is a corner of, and the rows of the case table."""
    rows = ", ".join(map(str, marching.case_rows(dims)))
    corners = ", ".join(f"({marching.corner_offset(dims, k)}, {1 << k}, {x}, {y}, {z})" for k, (x, y, z) in enumerate(marching.CORNERS))
    return f"""{_lattice_sql(dims)}, rows(cfg, k, da, db, dc) AS (VALUES {rows}), corners(far, bit, dx, dy, dz) AS (VALUES {corners}),
cubes AS (SELECT p.id - far AS id, sum(CASE WHEN val < {iso} THEN bit ELSE 0 END) AS cfg FROM p JOIN corners ON x - dx BETWEEN -1 AND {dims.nx - 1} AND y - dy BETWEEN -1 AND {dims.ny - 1} AND z - dz BETWEEN -1 AND {dims.nz - 1} GROUP BY p.id - far),
tris AS (SELECT id * 8 + k AS t, 3 * id + da AS a, 3 * id + db AS b, 3 * id + dc AS c FROM cubes JOIN rows USING (cfg))"""


def _cuts_sql(iso: int) -> str:
    parts = []
    for axis, name in enumerate("xyz"):
        at = ", ".join(f"a.{o} + {'greatest(0.0, least(1.0, (' + str(iso) + ' - a.val) / (b.val - a.val)::DOUBLE))' if o == name else '0.0'} AS {o}" for o in "xyz")
        near = " AND ".join(f"b.{o} = a.{o} + {int(o == name)}" for o in "xyz")
        parts.append(f"SELECT 3 * a.id + {axis} AS v, {at}, a.suspect | b.suspect AS label FROM s a JOIN s b ON {near} WHERE (a.val < {iso}) <> (b.val < {iso})")
    return "cuts AS (" + " UNION ALL ".join(parts) + ")"


def _lattice(spark, sf_dir, small: bool = False):
    dims = LI_SMALL if small else LI
    return marching.with_margin((grids.shipped_small if small else grids.shipped)(spark, sf_dir), dims, OUTSIDE), dims, ISO_SMALL if small else ISO


def _surface(spark, sf_dir, small: bool = False):
    return marching.surface(*_lattice(spark, sf_dir, small))


@job(f"{_mesh_sql(LI, ISO)}\n---\nSELECT t, a, b, c FROM tris", "li", "t a b c")
def isosurface_triangles(spark, sf_dir):
    """Triangles of the isosurface; a vertex is named by the grid edge that it lies on."""
    return _surface(spark, sf_dir)


@job(f"{_mesh_sql(LI, ISO)}, s AS (SELECT *, 0 AS suspect FROM p), {_cuts_sql(ISO)}\n---\nSELECT v, CAST(floor(x * 4096 + 0.5) AS BIGINT) AS x, CAST(floor(y * 4096 + 0.5) AS BIGINT) AS y, CAST(floor(z * 4096 + 0.5) AS BIGINT) AS z FROM cuts", "li", "v x y z")
def isosurface_vertices(spark, sf_dir):
    """The surface's vertices, in 4096ths of a cell."""
    lattice, _, iso = _lattice(spark, sf_dir)
    at = [F.floor(F.col(a) * 4096 + 0.5).alias(a) for a in "xyz"]
    return marching.vertices(lattice, iso).select("v", *at)


@job(f"{_mesh_sql(LI, ISO)}, {_EDGES}\n---\nSELECT (SELECT count(DISTINCT v) FROM (SELECT u AS v FROM edges UNION ALL SELECT v FROM edges)) AS n_vertices, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM edges WHERE n <> 2) AS n_odd, (SELECT count(*) FROM tris) AS n_triangles", "li", "n_vertices n_edges n_odd n_triangles")
def isosurface_counts(spark, sf_dir):
    """Vertices, edges, edges that other than two triangles hold (a closed surface has none), triangles."""
    tris = _surface(spark, sf_dir)
    held = mesh.edges(tris).agg(F.count("*").alias("n_edges"), F.count_if(F.col("n") != 2).alias("n_odd"))
    rows = mesh.vertices(tris).agg(F.count("*").alias("n_vertices")).crossJoin(held).crossJoin(tris.agg(F.count("*").alias("n_triangles")))  # single rows
    return rows.select("n_vertices", "n_edges", "n_odd", "n_triangles")


_PARTS = f"""{_mesh_sql(LI_SMALL, ISO_SMALL)}, {_EDGES}, links AS (SELECT u AS a, v AS b FROM edges UNION SELECT v, u FROM edges),
reach(s, v) AS (SELECT a, a FROM links UNION SELECT r.s, l.b FROM reach r JOIN links l ON l.a = r.v), root AS (SELECT s, max(v) AS root FROM reach GROUP BY s),
rooted AS (SELECT t.*, root FROM tris t JOIN root ON root.s = t.a),
per AS (SELECT root, count(*) AS n_triangles, min(t) AS first FROM rooted GROUP BY root),
named AS (SELECT *, row_number() OVER (ORDER BY first) AS label FROM per)"""


@job(f"{_PARTS}\n---\nSELECT label, n_triangles, (SELECT count(*) FROM root q WHERE q.root = n.root) - n_triangles * 3 // 2 + n_triangles AS chi FROM named n", "li_small", "label n_triangles chi", recursive=True)
def isosurface_components(spark, sf_dir):
    """Every component of the surface with its triangles and its Euler characteristic (2 less two for each handle)."""
    tris = mesh.labelled(_surface(spark, sf_dir, True))
    corners = tris.select("label", F.explode(F.array("a", "b", "c")).alias("v")).distinct().groupBy("label").agg(F.count("*").alias("n"))
    sizes = tris.groupBy("label").agg(F.count("*").alias("n_triangles")).join(corners, "label")
    return sizes.select("label", "n_triangles", (F.col("n") - (F.col("n_triangles") / 2).cast("long")).alias("chi"))


@job(f"{_PARTS}, best AS (SELECT root FROM named ORDER BY n_triangles DESC, label LIMIT 1)\n---\nSELECT t, a, b, c FROM rooted WHERE root = (SELECT root FROM best)", "li_small", "t a b c", recursive=True)
def isosurface_largest(spark, sf_dir):
    """The component with most triangles (of equal ones, the first)."""
    tris = mesh.labelled(_surface(spark, sf_dir, True))
    best = tris.groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return tris.join(F.broadcast(best), "label").select("t", "a", "b", "c")  # one row


# Cells without any shipment are unknown; whether a cell is outside comes from the majority of the slice below, not from its own value.
_MASK_SQL = f"""k AS (SELECT g.*, g.val > 0 AS known, coalesce(b.val >= {ISO}, true) AS outside FROM g LEFT JOIN g b ON b.x = g.x AND b.y = g.y AND b.z = g.z - 1)"""


def _masked(spark, sf_dir):
    from pyspark.sql import Window

    below = F.lag("val").over(Window.partitionBy("x", "y").orderBy("z"))
    cells = grids.shipped(spark, sf_dir).withColumn("outside", F.coalesce(below >= ISO, F.lit(True)))
    value, suspect = marching.masked(F.col("val") - ISO, F.col("outside"), F.col("val") > 0)
    cells = cells.withColumn("suspect", suspect.cast("long")).withColumn("val", value)
    lattice = marching.with_margin(cells, LI, OUTSIDE, ("val", "suspect"))
    return lattice.withColumn("suspect", F.coalesce("suspect", F.lit(0)))


_MASKED_SQL = _mesh_sql(LI, 0).replace("LEFT JOIN g ON", "LEFT JOIN w g ON") + f", s AS (SELECT p.*, coalesce(w.suspect, 0) AS suspect FROM p LEFT JOIN w USING (x, y, z)), {_cuts_sql(0)}"
_MASKED_SQL = f"{_MASK_SQL}, w AS (SELECT x, y, z, CASE WHEN known THEN abs(val - {ISO}) * CASE WHEN outside THEN 1 ELSE -1 END ELSE val - {ISO} END AS val, CASE WHEN known THEN 0 ELSE 1 END AS suspect FROM k), {_MASKED_SQL}"


@job(f"{_MASKED_SQL}\n---\nSELECT t.t, ma.label | mb.label | mc.label AS label, ma.label = 0 AND mb.label = 0 AND mc.label = 0 AS kept FROM tris t JOIN cuts ma ON ma.v = t.a JOIN cuts mb ON mb.v = t.b JOIN cuts mc ON mc.v = t.c", "li", "t label", "kept")
def masked_isosurface(spark, sf_dir):
    """The surface of a volume whose signs come from a mask (outside where the cell below is at or above the level, in known cells), each
    triangle with the union of its vertices' labels (1: an end of the edge is unknown), and whether it stays when holes are left open."""
    lattice = _masked(spark, sf_dir)
    tris, labels = marching.surface(lattice, LI, 0), marching.vertices(lattice, 0, "suspect").select("v", "label")
    kept = marching.without_holes(tris, labels).select("t", F.lit(True).alias("kept"))
    for corner in "abc":
        tris = tris.join(labels.withColumnsRenamed({"v": corner, "label": f"l{corner}"}), corner)
    each = tris.select("t", F.col("la").bitwiseOR(F.col("lb")).bitwiseOR(F.col("lc")).alias("label"))
    return each.join(kept, "t", "left").select("t", "label", F.coalesce("kept", F.lit(False)).alias("kept"))
