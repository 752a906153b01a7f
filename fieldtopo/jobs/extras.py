"""Jobs over roots and cuts of trees, distances from known cells, planes of triangles, and further volume files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.masks import OFFSETS_6, OFFSETS_26
from ..operators import flood, order, stencil, trees, voxelise
from ..sources import grids, volumes
from ..sources.grids import EVENTS, LI, LI_SMALL
from .common import NEIGHBOURS_26, ORDERED, STRICT_TEST, job
from .isosurface import _cuts_sql, _mesh_sql
from .relations import _FACE, _JOIN, _tree_sql, _volume_tree
from .shapes import _at, _mesh
from .surface import _FLOOD, ISO, ISO_SMALL
from .topology import CUT

_FLAT_SQL = _tree_sql("z", "(SELECT *, id AS node FROM g)", "val, id", "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.z = b.z", "j")
_FLAT_SPLIT = _tree_sql("z", "(SELECT *, id AS node FROM g)", "val DESC, id DESC", _FACE)


@job(f"{_FLAT_SQL}, {_FLAT_SPLIT}\n---\nSELECT j.z, j.node AS join_root, s.node AS split_root FROM jtree j JOIN tree s ON s.z = j.z WHERE j.upper IS NULL AND s.upper IS NULL", "events", "z join_root split_root", recursive=True)
def tree_roots(spark, sf_dir):
    """The one node of every slice's join tree that has none above it, and the one of its split tree that has none below."""
    cells = order.ranked_within(grids.activity(spark, sf_dir), ["z"])
    flat = lambda offsets: [o for o in offsets if o[2] == 0]
    up = trees.sweep_tree(cells, ["z"], flat(OFFSETS_26)).where("upper IS NULL").select("z", F.col("node").alias("join_root"))
    down = trees.sweep_tree(order.reversed_order(cells, EVENTS.slice), ["z"], flat(OFFSETS_6)).where("upper IS NULL").select("z", F.col("node").alias("split_root"))
    return up.join(down, "z")


@job(f"{_JOIN}, anc(node, here) AS (SELECT node, node FROM tree WHERE val <= {CUT} UNION SELECT a.node, u.node FROM anc a JOIN tree t ON t.node = a.here JOIN tree u ON u.node = t.upper WHERE u.val <= {CUT})\n---\nSELECT a.node, arg_max(a.here, t.ord) AS ancestor FROM anc a JOIN tree t ON t.node = a.here GROUP BY a.node", "li_small", "node ancestor", recursive=True)
def volume_isovalue_ancestors(spark, sf_dir):
    """The highest node at or below the cut over every node of the volume's join tree: pointers are followed in steps that double."""
    cells, edges = _volume_tree(spark, sf_dir)
    val = cells.select(F.col("id").alias("node"), "val")
    low = edges.join(val, "node").where(F.col("val") <= CUT).join(val.select(F.col("node").alias("upper"), F.col("val").alias("top")), "upper", "left")
    goes = F.when(F.col("top") <= CUT, F.col("upper")).otherwise(F.col("node"))
    return flood.follow(low.select(F.col("node").alias("id"), goes.alias("at"))).select(F.col("id").alias("node"), F.col("at").alias("ancestor"))


@job(f"{_JOIN}, anc(node, here) AS (SELECT node, node FROM tree WHERE val <= {CUT} UNION SELECT a.node, u.node FROM anc a JOIN tree t ON t.node = a.here JOIN tree u ON u.node = t.upper WHERE u.val <= {CUT}), top AS (SELECT a.node, arg_max(a.here, t.ord) AS ancestor FROM anc a JOIN tree t ON t.node = a.here GROUP BY a.node)\n---\nSELECT ancestor, count(*) AS n_cells, min(node) AS least FROM top GROUP BY ancestor", "li_small", "ancestor n_cells least", recursive=True)
def cells_below_edges(spark, sf_dir):
    """Cells below the edge of the join tree that the cut crosses, for each of these edges by its lower node."""
    return volume_isovalue_ancestors(spark, sf_dir).groupBy("ancestor").agg(F.count("*").alias("n_cells"), F.min("node").alias("least"))


@job(f"""{_FLOOD}, seeds AS (SELECT id FROM g WHERE val % 7 = 0),
d(id, dist) AS (SELECT id, 0 FROM seeds UNION SELECT n.b, d.dist + 1 FROM d JOIN near n ON n.a = d.id WHERE d.dist < 30)
---
SELECT d.id, min(dist) AS dist, any_value(s.inside) AS inside FROM d JOIN s USING (id) GROUP BY d.id""", "li_small", "id dist", "inside", recursive=True)
def distance_from_known(spark, sf_dir):
    """Steps over faces from the cells that count as known (every seventh level), with the side that each cell is on."""
    cells = grids.shipped_small(spark, sf_dir).withColumn("seed", F.col("val") % 7 == 0)
    found = flood.distances(cells.select("id", "x", "y", "z", "seed"))
    return found.join(cells.select("id", (F.col("val") < ISO_SMALL).alias("inside")), "id")


_DIFF = lambda p, q: [f"({p}.{o} - {q}.{o})" for o in "xyz"]
_U, _W = _DIFF("kb", "ka"), _DIFF("kc", "ka")
_N = [f"({_U[(i + 1) % 3]} * {_W[(i + 2) % 3]} - {_U[(i + 2) % 3]} * {_W[(i + 1) % 3]})" for i in range(3)]
_PLANE_SQL = f"""{_mesh_sql(LI, ISO)}, s AS (SELECT *, 0 AS suspect FROM p), {_cuts_sql(ISO)},
n AS (SELECT t.t, {", ".join(f"{e} AS n{i}" for i, e in enumerate(_N))}, ka.x AS ax, ka.y AS ay, ka.z AS az FROM tris t JOIN cuts ka ON ka.v = t.a JOIN cuts kb ON kb.v = t.b JOIN cuts kc ON kc.v = t.c),
d AS (SELECT t, (n0 * (7.5 - ax) + n1 * (7.5 - ay) + n2 * (41.5 - az)) / sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS d FROM n WHERE n0 * n0 + n1 * n1 + n2 * n2 > 1e-18)"""


@job(f"{_PLANE_SQL}\n---\nSELECT t, CAST(floor(d * 1024 + 0.5) AS BIGINT) AS dist FROM d", "li", "t dist")
def plane_distances(spark, sf_dir):
    """The signed distance of the grid's middle from the plane of every triangle (those without an area left out). In 1024ths."""
    tris, verts, _ = _mesh(spark, sf_dir, False)
    k = voxelise.placed(tris, verts)
    u, w = ([F.col(f"{c}{o}") - F.col(f"a{o}") for o in "xyz"] for c in "bc")
    n = [u[(i + 1) % 3] * w[(i + 2) % 3] - u[(i + 2) % 3] * w[(i + 1) % 3] for i in range(3)]
    rows = k.select("t", *[e.alias(f"n{i}") for i, e in enumerate(n)], "ax", "ay", "az").withColumn("area", F.expr("n0 * n0 + n1 * n1 + n2 * n2")).where("area > 1e-18")
    dist = F.expr("(n0 * (7.5D - ax) + n1 * (7.5D - ay) + n2 * (41.5D - az)) / sqrt(area)")
    return rows.select("t", F.floor(dist * 1024 + 0.5).alias("dist"))


_LATER = f"""{ORDERED}, {NEIGHBOURS_26}, m3 AS (SELECT a.id, a.z, coalesce(bit_or(CASE WHEN b.ord > a.ord THEN CAST(1 AS BIGINT) << CAST(off.bit AS INT) ELSE 0 END), 0) AS mask
  FROM o a CROSS JOIN off LEFT JOIN o b ON b.x = a.x + off.dx AND b.y = a.y + off.dy AND b.z = a.z + off.dz GROUP BY ALL)"""


@job(f"{_LATER},\n{STRICT_TEST.format(source='m3')}\n---\nSELECT id, critical FROM m3 JOIN test3 USING (mask)", "li_small", "id", "critical", recursive=True)
def initially_critical(spark, sf_dir):
    """Whether a cell is critical in the filtration by the outside rule: over its later neighbours, those beyond the grid being earlier."""
    cells = order.ranked(grids.shipped_small(spark, sf_dir))
    mask = F.lit((1 << 26) - 1).bitwiseXOR(stencil.lower_mask("ord", outside=True))
    return stencil.block(cells, "ord").select("id", arrays.strict(mask).alias("critical"))


# --- files ---


@job(f"\n---\nSELECT id, val < {ISO} AS carved, val > 0 AS known FROM g", "li", "id", "carved known")
def bitmap_files(spark, sf_dir):
    """Two masks of the grid written as bitmaps in one file, and read back by ranges."""
    cells = grids.shipped(spark, sf_dir).select("id", (F.col("val") < ISO).alias("carved"), (F.col("val") > 0).alias("known"))
    path = _at(spark, ".carve")
    volumes.write_bitmaps(cells, ["carved", "known"], LI.n, path)
    return volumes.read_bitmaps(spark, path, LI.n, 2).select("id", F.col("bit0").alias("carved"), F.col("bit1").alias("known"))


@job("\n---\nSELECT id, x, y, z, val FROM g", "li_small", "id x y z val")
def text_volume(spark, sf_dir):
    """The small grid written as a text volume with x slowest, a line for each, and read back by ranges of bytes."""
    cells = grids.shipped_small(spark, sf_dir)
    at = (F.col("x") * LI_SMALL.ny + F.col("y")) * LI_SMALL.nz + F.col("z")
    lines = cells.select(at.alias("k"), F.col("val").cast("string").alias("value")).unionByName(spark.createDataFrame([(-1, f"{LI_SMALL.nx} {LI_SMALL.ny} {LI_SMALL.nz}")], "k long, value string"))
    root = _at(spark, "")
    lines.repartition(1).sortWithinPartitions("k").select("value").write.text(root)
    file = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(root).select("path").first()["path"]  # one name
    return volumes.read_dat(spark, file).withColumn("val", F.col("val").cast("long"))
