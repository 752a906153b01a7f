"""Jobs over trees, meshes, octrees and masks as relations: volume trees, mesh clean-up and transforms, octree queries, seeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.masks import OFFSETS_3D, OFFSETS_6, OFFSETS_26, changes_topology, changes_topology_2d
from ..operators import bricks, flood, mesh, order, pyramid, query, stencil, trees
from ..sources import grids
from ..sources.grids import EVENTS, LI, LI_4D, LI_SMALL
from .common import NEIGHBOURS_26, ORDERED, RING_TEST, STRICT_TEST, VOLUME_MASK, job
from .reshape import _LEVELS, _RUNS, _pyramid, _runs
from .surface import _COMPONENTS, _CORNERS, _CROSS, _EDGES, _TRIS, _tris, _tris_small

ISO, ISO_SMALL = 70, 1750

# --- orders, reads and values ---


@job(f"{ORDERED}\n---\nSELECT id, t, ord FROM o", "li_4d", "id t ord")
def order_4d(spark, sf_dir):
    """Rank of every cell of the 4-D grid by value, then id."""
    return order.ranked(grids.shipped_4d(spark, sf_dir)).select("id", "t", "ord")


@job("\n---\nSELECT a.id, coalesce(b.val, 1000000000) AS next_step, coalesce(c.val, 1000000000) AS next_x FROM g a LEFT JOIN g b ON b.x = a.x AND b.y = a.y AND b.z = a.z AND b.t = a.t + 1 LEFT JOIN g c ON c.x = a.x + 1 AND c.y = a.y AND c.z = a.z AND c.t = a.t", "li_4d", "id next_step next_x")
def sentinel_reads_4d(spark, sf_dir):
    """Reads beyond the last step or column see a wall."""
    cells = grids.shipped_4d(spark, sf_dir)
    after = lambda a: F.coalesce(F.lead("val").over(Window.partitionBy(*[c for c in "xyzt" if c != a]).orderBy(a)), F.lit(1_000_000_000))
    return cells.select("id", after("t").alias("next_step"), after("x").alias("next_x"))


@job("r AS (SELECT min(val) AS least FROM g)\n---\nSELECT id, val + 1000 AS val, least FROM g, r", "li", "id val least")
def add_constant(spark, sf_dir):
    """Values moved by a constant, beside the least of them before."""
    cells = grids.shipped(spark, sf_dir)
    return cells.crossJoin(F.broadcast(cells.agg(F.min("val").alias("least")))).select("id", (F.col("val") + 1000).alias("val"), "least")  # one row


@job(f"\n---\nSELECT x, y, z FROM g WHERE val < {ISO} INTERSECT SELECT y, x, z FROM g WHERE val < {ISO}", "li", "x y z")
def voxel_intersection(spark, sf_dir):
    """Voxels that a set and its transpose share."""
    inside = grids.shipped(spark, sf_dir).where(F.col("val") < ISO)
    return inside.select("x", "y", "z").intersect(inside.select(F.col("y").alias("x"), F.col("x").alias("y"), "z"))


@job(f"{NEIGHBOURS_26}\n---\nSELECT a.id, count(*) FILTER ((b.val < {ISO}) = (a.val < {ISO}) AND (a.val < {ISO} OR abs(dx) + abs(dy) + abs(dz) = 1)) AS joined FROM g a CROSS JOIN off LEFT JOIN g b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.id", "li", "id joined")
def dual_adjacency(spark, sf_dir):
    """Like neighbours under dual connectivity: vertex steps between inside cells, face steps between outside ones."""
    cells = stencil.block(grids.shipped(spark, sf_dir).withColumn("inside", F.col("val") < ISO), "inside")
    like = lambda offs: sum((F.coalesce(stencil.at(o) == F.col("inside"), F.lit(False)).cast("long") for o in offs), F.lit(0).cast("long"))
    return cells.select("id", F.when(F.col("inside"), like(OFFSETS_26)).otherwise(like(OFFSETS_6)).alias("joined"))


@job("s AS (SELECT id, max(val) OVER (PARTITION BY t ORDER BY id DESC) AS carve FROM g), k AS (SELECT g.*, row_number() OVER (ORDER BY s.carve, g.id) - 1 AS carve FROM g JOIN s USING (id))\n---\nSELECT id, max(val) OVER (ORDER BY carve) AS up_val FROM k", "li_4d", "id up_val")
def monotone_clamp_4d(spark, sf_dir):
    """Running maximum of 4-D values along an order: that of each step's running maxima from its end."""
    cells = grids.shipped_4d(spark, sf_dir).withColumn("key", F.max("val").over(Window.partitionBy("t").orderBy(F.desc("id"))))
    return order.running_extreme(order.ranked(cells, "key", name="carve"), "val", "carve", "up_val").select("id", "up_val")


_SMOOTHED = "w AS (SELECT a.id, 2 * a.val + coalesce(sum(b.val), 0) + a.val * (6 - count(b.id)) AS total FROM g a LEFT JOIN g b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND b.id IN (a.id - 1, a.id + 1, a.id - 16, a.id + 16, a.id - 256, a.id + 256) GROUP BY a.id, a.val)"


@job(f"{_SMOOTHED}, n AS (SELECT id, row_number() OVER (ORDER BY total // 8, id) - 1 AS ord FROM w)\n---\nSELECT o.id, coalesce(CASE WHEN o.z % 3 = 0 THEN NULL ELSE n.ord END, o.ord) AS ord FROM (SELECT *, row_number() OVER (ORDER BY val, id) - 1 AS ord FROM g) o JOIN n USING (id)", "li", "id ord")
def resolved_order(spark, sf_dir):
    """The order in use: the simplified one where a slice has been simplified, else the initial one."""
    cells = stencil.block(grids.shipped(spark, sf_dir), "val")
    smooth = cells.select("id", "z", "val", F.floor((2 * F.col("val") + stencil.total(OFFSETS_6, default=F.col("val"))) / 8).alias("smooth"))
    both = order.ranked(order.ranked(smooth, "smooth", name="later"), "val")
    return both.select("id", F.coalesce(F.when(F.col("z") % 3 != 0, F.col("later")), F.col("ord")).alias("ord"))


@job(f"m AS (SELECT *, val < {ISO} AS i FROM g), c AS (SELECT z, x, y, i <> lag(i) OVER (PARTITION BY z, x ORDER BY y) AS flip FROM m)\n---\nSELECT z, x, y, row_number() OVER (ORDER BY z, x, y) - 1 AS place FROM (SELECT DISTINCT z, x, y FROM c WHERE flip)", "li", "z x y place")
def sign_change_list(spark, sf_dir):
    """Sign changes along y in the order z, x, y, each once."""
    inside = F.col("val") < ISO
    flip = inside != F.lag(inside).over(Window.partitionBy("z", "x").orderBy("y"))
    changes = grids.shipped(spark, sf_dir).withColumn("flip", flip).where("flip").select("z", "x", "y").dropDuplicates()
    return order.numbered(changes, [F.col("z"), F.col("x"), F.col("y")], "place")


# --- masks and critical cells ---

_UPPER = f"""{ORDERED}, {NEIGHBOURS_26},
up AS (SELECT a.id, a.z, bit_or(CASE WHEN b.id IS NULL OR b.ord > a.ord THEN CAST(1 AS BIGINT) << CAST(off.bit AS INT) ELSE 0 END) AS later, bit_or(CASE WHEN b.ord > a.ord THEN CAST(1 AS BIGINT) << CAST(off.bit AS INT) ELSE 0 END) AS known
  FROM o a CROSS JOIN off LEFT JOIN o b ON b.x = a.x + off.dx AND b.y = a.y + off.dy AND b.z = a.z + off.dz GROUP BY ALL),
sided AS (SELECT id, z, xor(later, 67108863) AS mask, 'inside' AS side FROM up UNION ALL SELECT id, z, known, 'outside' FROM up)"""


@job(f"{_UPPER},\n{STRICT_TEST.format(source='sided')}\n---\nSELECT z, side, count(*) FILTER (critical) AS n_critical, count(*) AS n FROM sided JOIN test3 USING (mask) GROUP BY ALL", "li_small", "z n_critical n", "side", recursive=True)
def criticals_by_side(spark, sf_dir):
    """Critical cells by their later neighbours: from inside (what lies beside the grid is later, then the complement) and from outside (it is earlier)."""
    falling = query.link_terms(order.ranked(grids.shipped_small(spark, sf_dir), descending=True).withColumn("one", F.lit(True)))
    ring = stencil.block(falling.withColumnRenamed("mask", "known"), "one")
    beside = sum((F.when(stencil.at(o).isNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, o in enumerate(OFFSETS_26)), F.lit(0).cast("long"))
    inside = F.col("known").bitwiseOR(beside).bitwiseXOR(F.lit((1 << 26) - 1))
    sides = F.array(F.struct(F.lit("inside").alias("side"), inside.alias("mask")), F.struct(F.lit("outside").alias("side"), F.col("known").alias("mask")))
    each = ring.select("z", F.explode(sides).alias("s")).select("z", "s.side", "s.mask")  # a column of its own: the test looks at it often
    return each.groupBy("z", "side").agg(F.count_if(changes_topology(F.col("mask"))).alias("n_critical"), F.count("*").alias("n"))


@job(f"{VOLUME_MASK}, m2 AS (SELECT id, (mask >> 9) & 255 AS mask FROM m3), {RING_TEST},\n{STRICT_TEST.format(source='m3')}\n---\nSELECT m3.z, count(*) FILTER (transitions <> 2 OR test3.critical) AS n_combo, count(*) FILTER (transitions <> 2) AS n_slice, count(*) FILTER (test3.critical) AS n_volume FROM m3 JOIN m2 USING (id) JOIN test2 ON test2.mask = m2.mask JOIN test3 ON test3.mask = m3.mask GROUP BY m3.z", "li_small", "z n_combo n_slice n_volume", recursive=True)
def combo_criticals(spark, sf_dir):
    """Cells critical in their slice, in the volume, or in either, by slice."""
    cells = query.link_terms(order.ranked(grids.shipped_small(spark, sf_dir)))
    flat, whole = changes_topology_2d(F.shiftright("mask", 9).bitwiseAND(F.lit(255))), changes_topology(F.col("mask"))
    return cells.groupBy("z").agg(F.count_if(flat | whole).alias("n_combo"), F.count_if(flat).alias("n_slice"), F.count_if(whole).alias("n_volume"))


_SIGNS = f"""{NEIGHBOURS_26}, s AS (SELECT *, val - {ISO_SMALL} AS f, (x + y) % 2 = 0 AS carved FROM g),
mk AS (SELECT a.id, bit_or(CASE WHEN b.id IS NULL OR NOT b.carved OR b.f > 0 THEN CAST(1 AS BIGINT) << CAST(off.bit AS INT) ELSE 0 END) AS inward, bit_or(CASE WHEN b.id IS NOT NULL AND (NOT b.carved OR b.f < 0) THEN CAST(1 AS BIGINT) << CAST(off.bit AS INT) ELSE 0 END) AS outward
  FROM s a CROSS JOIN off LEFT JOIN s b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.id),
masks_ AS (SELECT id, xor(inward, 67108863) AS mask, 'inside' AS side FROM mk UNION ALL SELECT id, outward, 'outside' FROM mk)"""


@job(f"{_SIGNS},\n{STRICT_TEST.format(source='masks_')}\n---\nSELECT id, side, mask, critical FROM masks_ JOIN test3 USING (mask)", "li_small", "id mask", "side critical", recursive=True)
def side_checks(spark, sf_dir):
    """The dual masks of two-sided carving: a neighbour counts inside unless carved and negative (complemented), outside if uncarved or
    negative; and whether the cell would change the topology on that side."""
    cells = grids.shipped_small(spark, sf_dir).withColumn("s", F.struct((F.col("val") - ISO_SMALL).alias("f"), ((F.col("x") + F.col("y")) % 2 == 0).alias("carved")))
    around = stencil.block(cells, "s")

    def bits(test):
        return sum((F.when(test(stencil.at(o)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, o in enumerate(OFFSETS_26)), F.lit(0).cast("long"))

    inward = bits(lambda s: s.isNull() | ~s["carved"] | (s["f"] > 0)).bitwiseXOR(F.lit((1 << 26) - 1))
    outward = bits(lambda s: s.isNotNull() & (~s["carved"] | (s["f"] < 0)))
    sides = F.array(*[F.struct(F.lit(k).alias("side"), m.alias("mask")) for k, m in (("inside", inward), ("outside", outward))])
    each = around.select("id", F.explode(sides).alias("m")).select("id", "m.side", "m.mask")
    return each.withColumn("critical", changes_topology(F.col("mask")))


@job("\n---\nSELECT id, x = 0 OR y = 0 OR z = 0 OR x = 7 OR y = 7 OR z = 11 AS border FROM g WHERE (x = 0 OR y = 0 OR z = 0 OR x = 7 OR y = 7 OR z = 11) AND (val - 1750 > 0 OR val = 1750)", "li_small", "id", "border")
def outer_boundary_seed(spark, sf_dir):
    """Positive or unknown cells of the six border faces, each once."""
    d, f = LI_SMALL, F.col("val") - ISO_SMALL
    border = F.greatest(*[(F.col(a).isin(0, n - 1)).cast("int") for a, n in zip("xyz", d[:3], strict=True)]) == 1
    return grids.shipped_small(spark, sf_dir).where(border & ((f > 0) | (f == 0))).select("id", border.alias("border"))


@job(f"\n---\nSELECT id, CASE WHEN val < {ISO} THEN 0 WHEN val > {2 * ISO} THEN 4000 ELSE val + 100 END AS val FROM g", "li", "id val")
def clamp_by_label(spark, sf_dir):
    """Values by what a cell was carved as: inside (0), outside (4000), or not at all (100 more)."""
    v = F.col("val")
    return grids.shipped(spark, sf_dir).select("id", F.when(v < ISO, 0).when(v > 2 * ISO, 4000).otherwise(v + 100).alias("val"))


@job(f"\n---\nSELECT a.id, a.val < {ISO} AS outside, bool_or((b.val < {ISO}) <> (a.val < {ISO})) AS boundary FROM g a LEFT JOIN g b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND b.id IN (a.id - 1, a.id + 1, a.id - 16, a.id + 16, a.id - 256, a.id + 256) GROUP BY a.id, a.val", "li", "id", "outside boundary")
def threshold_marks(spark, sf_dir):
    """Cells below a threshold, and those with a face neighbour on its other side."""
    cells = stencil.block(grids.shipped(spark, sf_dir).withColumn("outside", F.col("val") < ISO), "outside")
    differs = F.greatest(*[F.coalesce(stencil.at(o) != F.col("outside"), F.lit(False)).cast("int") for o in OFFSETS_6]) == 1
    return cells.select("id", "outside", differs.alias("boundary"))


# --- trees of volumes and of pairs of slices ---


def _tree_sql(keys: str, source: str, ordering: str, near: str, p: str = "") -> str:
    """The augmented tree of a sweep by its definition: the next cell whose component holds the node's. p: a prefix of the parts' names."""
    part = f"PARTITION BY {keys} " if keys else ""
    same = f"a.{keys} = b.{keys} AND " if keys else ""
    cols = f"o.{keys}, " if keys else ""
    return f"""{p}o AS (SELECT *, row_number() OVER ({part}ORDER BY {ordering}) - 1 AS ord FROM {source}),
{p}n AS (SELECT a.node AS a, b.node AS b, b.ord AS bord FROM {p}o a JOIN {p}o b ON {same}{near} WHERE a.node <> b.node),
{p}reach(p, pord, c) AS (SELECT node, ord, node FROM {p}o UNION SELECT r.p, r.pord, n.b FROM {p}reach r JOIN {p}n n ON n.a = r.c AND n.bord <= r.pord),
{p}ups AS (SELECT r.c, arg_min(r.p, r.pord) AS upper FROM {p}reach r JOIN {p}o o ON o.node = r.c WHERE r.pord > o.ord GROUP BY r.c),
{p}tree AS (SELECT {cols}o.node, o.ord, o.val, ups.upper FROM {p}o o LEFT JOIN {p}ups ups ON ups.c = o.node)"""


_VERTEX, _FACE = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1", "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1"
_JOIN, _SPLIT = _tree_sql("", "(SELECT *, id AS node FROM g)", "val, id", _VERTEX), _tree_sql("", "(SELECT *, id AS node FROM g)", "val DESC, id DESC", _FACE)


def _volume_tree(spark, sf_dir, split=False):
    """The volume's cells and its tree, from bricks of 4 cells a side."""
    cells = order.ranked(grids.shipped_small(spark, sf_dir), descending=split)
    return cells, bricks.tree(cells, LI_SMALL, OFFSETS_6 if split else OFFSETS_26, side=4)


@job(f"{_JOIN}\n---\nSELECT node, coalesce(upper, -1) AS upper FROM tree", "li_small", "node upper", recursive=True)
def volume_join_tree(spark, sf_dir):
    """The augmented join tree of a volume (-1: the root)."""
    return _volume_tree(spark, sf_dir)[1].fillna(-1, ["upper"]).select("node", "upper")


@job(f"{_SPLIT}\n---\nSELECT node, coalesce(upper, -1) AS upper FROM tree", "li_small", "node upper", recursive=True)
def volume_split_tree(spark, sf_dir):
    """The augmented split tree of a volume: the sweep downwards over face neighbours."""
    return _volume_tree(spark, sf_dir, True)[1].fillna(-1, ["upper"]).select("node", "upper")


_BOTH = _tree_sql("", "(SELECT *, id AS node FROM g)", "val, id", _VERTEX, "j")


@job(f"{_BOTH},\n{_SPLIT},\nj AS (SELECT upper AS node, count(*) AS down FROM jtree WHERE upper IS NOT NULL GROUP BY upper), s AS (SELECT upper AS node, count(*) AS up FROM tree WHERE upper IS NOT NULL GROUP BY upper), d AS (SELECT g.id AS node, coalesce(j.down, 0) AS down, coalesce(s.up, 0) AS up FROM g LEFT JOIN j ON j.node = g.id LEFT JOIN s ON s.node = g.id)\n---\nSELECT node, up, down, up = down + 1 AND up <= 2 AS positive, down = up + 1 AND down <= 2 AS negative, up = 1 AND down = 1 AS neutral, up >= 3 OR down >= 3 OR up + down >= 4 AS complex FROM d", "li_small", "node up down", "positive negative neutral complex", recursive=True)
def contour_tree_degrees(spark, sf_dir):
    """Every cell as a node of the volume's contour tree: its upper degree is that of the split tree, its lower that of the join tree;
    and the four classes of criticals by degree."""
    down = trees.degrees(_volume_tree(spark, sf_dir)[1], []).select("node", "down")
    up = trees.degrees(_volume_tree(spark, sf_dir, True)[1], []).select("node", F.col("down").alias("up"))
    u, d = F.col("up"), F.col("down")
    classes = {"positive": (u == d + 1) & (u <= 2), "negative": (d == u + 1) & (d <= 2), "neutral": (u == 1) & (d == 1), "complex": (u >= 3) | (d >= 3) | (u + d >= 4)}
    return down.join(up, "node").withColumns(classes).select("node", "up", "down", *classes)


_PAIRS = "(SELECT p.z AS pair, g.*, g.id + p.z * 10000 AS node FROM g JOIN (SELECT DISTINCT z FROM g) p ON g.z BETWEEN p.z AND p.z + 1 WHERE p.z < 29)"


def _pair_tree(spark, sf_dir, split=False):
    cells = grids.activity(spark, sf_dir).withColumn("pair", F.explode(F.array(F.col("z") - 1, F.col("z")))).where(F.col("pair").between(0, EVENTS.nz - 2))
    ranks = order.ranked_within(cells, ["pair"]) if not split else cells.withColumn("ord", (F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("val"), F.desc("id"))) - 1).cast("long"))
    return trees.sweep_tree(ranks, ["pair"], OFFSETS_6 if split else OFFSETS_26)


@job(f"{_tree_sql('pair', _PAIRS, 'val, node', _VERTEX)}\n---\nSELECT pair, node - pair * 10000 AS node, coalesce(upper - pair * 10000, -1) AS upper FROM tree", "events", "pair node upper", recursive=True)
def pair_join_trees(spark, sf_dir):
    """The augmented join tree of every pair of consecutive slices."""
    return _pair_tree(spark, sf_dir).fillna(-1, ["upper"])


@job(f"{_tree_sql('pair', _PAIRS, 'val DESC, node DESC', _FACE)}\n---\nSELECT pair, node - pair * 10000 AS node, coalesce(upper - pair * 10000, -1) AS upper FROM tree", "events", "pair node upper", recursive=True)
def pair_split_trees(spark, sf_dir):
    """The augmented split tree of every pair of consecutive slices."""
    return _pair_tree(spark, sf_dir, True).fillna(-1, ["upper"])


@job(f"{_JOIN}\n---\nSELECT t.node, t.val, coalesce((SELECT string_agg(lpad(CAST(u.node AS VARCHAR), 6, '0'), ' ' ORDER BY u.node) FROM tree u WHERE u.upper = t.node), '') AS below, coalesce(CAST(t.upper AS VARCHAR), '') AS above FROM tree t", "li_small", "node val", "below above", recursive=True)
def tree_dump(spark, sf_dir):
    """Each node of the volume's join tree as text: what is below it, its value, what is above."""
    cells, edges = _volume_tree(spark, sf_dir)
    down = edges.where("upper is not null").groupBy(F.col("upper").alias("node")).agg(F.array_join(F.array_sort(F.collect_list(F.lpad(F.col("node").cast("string"), 6, "0"))), " ").alias("below"))
    named = edges.join(down, "node", "left").join(cells.select(F.col("id").alias("node"), "val"), "node")
    return named.select("node", "val", F.coalesce("below", F.lit("")).alias("below"), F.coalesce(F.col("upper").cast("string"), F.lit("")).alias("above"))


@job(f"{_JOIN}, k AS (SELECT node, (SELECT count(*) FROM tree u WHERE u.upper = t.node) AS down, upper FROM tree t), crit AS (SELECT node FROM k WHERE down <> 1 OR upper IS NULL), up(node, here) AS (SELECT node, node FROM tree UNION SELECT up.node, t.upper FROM up JOIN tree t ON t.node = up.here WHERE t.upper IS NOT NULL AND up.here NOT IN (SELECT node FROM crit))\n---\nSELECT up.node, up.here AS parent FROM up JOIN crit ON crit.node = up.here", "li_small", "node parent", recursive=True)
def critical_parents(spark, sf_dir):
    """The critical node that each cell's branch of the join tree ends in (a critical cell: itself), by following pointers."""
    edges = _volume_tree(spark, sf_dir)[1]
    deg = trees.degrees(edges, [])
    stays = (F.col("down") != 1) | (F.col("up") == 0)
    pointers = edges.join(deg, "node").select(F.col("node").alias("id"), F.when(stays, F.col("node")).otherwise(F.col("upper")).alias("at"))
    return flood.follow(pointers).select(F.col("id").alias("node"), F.col("at").alias("parent"))


# --- meshes ---


@job(f"{_TRIS}, used AS (SELECT a AS v FROM tris UNION SELECT b FROM tris UNION SELECT c FROM tris), k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS n FROM used)\n---\nSELECT t, ka.n AS a, kb.n AS b, kc.n AS c FROM tris JOIN k ka ON ka.v = a JOIN k kb ON kb.v = b JOIN k kc ON kc.v = c", "li", "t a b c")
def dense_vertices(spark, sf_dir):
    """Triangles over vertices numbered without gaps, unused ones left out."""
    tris = _tris(spark, sf_dir)
    names = order.numbered(mesh.vertices(tris), [F.col("v")], "n")
    for corner in "abc":
        tris = tris.withColumnRenamed(corner, "v").join(names, "v").drop("v").withColumnRenamed("n", corner)
    return tris.select("t", "a", "b", "c")


@job(f"{_TRIS}, {_CORNERS}, nrm AS (SELECT t, {_CROSS} FROM pos)\n---\nSELECT t, n0 * n0 + n1 * n1 + n2 * n2 AS squared, CAST(floor(1000 * 0.5 * sqrt(CAST(n0 * n0 + n1 * n1 + n2 * n2 AS DOUBLE))) AS BIGINT) AS area_milli FROM nrm", "li", "t squared area_milli")
def triangle_areas(spark, sf_dir):
    """Half the length of each triangle's cross product, in thousandths."""
    each = mesh.vertex_normals(_tris(spark, sf_dir), LI, per="t")
    squared = F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz")
    return each.select("t", squared.alias("squared"), F.floor(1000 * 0.5 * F.sqrt(squared.cast("double"))).alias("area_milli"))


@job(f"{_TRIS}, {_CORNERS}, nrm AS (SELECT a, b, c, {_CROSS} FROM pos), s AS (SELECT v, sum(n0) AS px, sum(n1) AS py, sum(n2) AS pz FROM (SELECT a AS v, n0, n1, n2 FROM nrm UNION ALL SELECT b, n0, n1, n2 FROM nrm UNION ALL SELECT c, n0, n1, n2 FROM nrm) GROUP BY v)\n---\nSELECT v, CASE WHEN px = 0 AND py = 0 AND pz = 0 THEN 0 ELSE CAST(floor(1000 * px / sqrt(CAST(px * px + py * py + pz * pz AS DOUBLE))) AS BIGINT) END AS ux, CASE WHEN px = 0 AND py = 0 AND pz = 0 THEN 0 ELSE CAST(floor(1000 * pz / sqrt(CAST(px * px + py * py + pz * pz AS DOUBLE))) AS BIGINT) END AS uz FROM s", "li", "v ux uz")
def unit_normals(spark, sf_dir):
    """Normals of length one, in thousandths; vertices whose triangles cancel get none (0)."""
    n = mesh.vertex_normals(_tris(spark, sf_dir), LI)
    length = F.sqrt((F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz")).cast("double"))
    return n.select("v", *[F.when(length == 0, 0).otherwise(F.floor(1000 * F.col(p) / length)).alias(u) for p, u in (("px", "ux"), ("pz", "uz"))])


_PLACED = f"{_TRIS}, {_CORNERS}, vs AS (SELECT DISTINCT v, v % 17 AS x, (v // 17) % 17 AS y, v // 289 AS z FROM (SELECT a AS v FROM tris UNION ALL SELECT b FROM tris UNION ALL SELECT c FROM tris))"


def _vertices(spark, sf_dir):
    return mesh.vertices(_tris(spark, sf_dir)).select("v", *[c.alias(a) for c, a in zip(mesh.corner_place(LI, "v"), "xyz", strict=True)])


@job(f"{_PLACED}, box AS (SELECT min(x) + max(x) AS sx, min(y) + max(y) AS sy, min(z) + max(z) AS sz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS axis FROM vs)\n---\nSELECT v, CAST(floor(1000 * CAST(2 * x - sx AS DOUBLE) / axis) AS BIGINT) AS x, CAST(floor(1000 * CAST(2 * y - sy AS DOUBLE) / axis) AS BIGINT) AS y, CAST(floor(1000 * CAST(2 * z - sz AS DOUBLE) / axis) AS BIGINT) AS z FROM vs, box", "li", "v x y z")
def fit_to_unit(spark, sf_dir):
    """Vertices moved to the box's centre and scaled to -1..1 by its longest side, in thousandths."""
    placed = _vertices(spark, sf_dir)
    spread = F.greatest(*[F.max(a) - F.min(a) for a in "xyz"])
    box = placed.agg(*[(F.min(a) + F.max(a)).alias(f"s{a}") for a in "xyz"], spread.alias("axis"))
    return placed.crossJoin(F.broadcast(box)).select("v", *[F.floor(1000 * (2 * F.col(a) - F.col(f"s{a}")).cast("double") / F.col("axis")).alias(a) for a in "xyz"])  # one row


@job(f"{_PLACED}\n---\nSELECT v, copy, x + dx AS x, y + dy AS y, z - 4 AS z FROM vs, (VALUES (0, -4, -4), (1, 4, -4), (2, -4, 4), (3, 4, 4)) c(copy, dx, dy)", "li", "v copy x y z")
def translated_copies(spark, sf_dir):
    """Four copies moved by 4 along x and y either way and by -4 along z."""
    moves = F.array(*[F.struct(F.lit(i).alias("copy"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate([(-4, -4), (4, -4), (-4, 4), (4, 4)])])
    each = _vertices(spark, sf_dir).withColumn("m", F.explode(moves))
    return each.select("v", "m.copy", (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), (F.col("z") - 4).alias("z"))


@job(f"{_COMPONENTS}, size AS (SELECT label, count(*) AS n FROM lab GROUP BY label), best AS (SELECT label FROM size ORDER BY n DESC, label LIMIT 1)\n---\nSELECT t, label FROM lab WHERE label <> (SELECT label FROM best)", "li_small", "t label", recursive=True)
def without_largest(spark, sf_dir):
    """All components but the largest (of equal ones, the first)."""
    tris = mesh.labelled(_tris_small(spark, sf_dir))
    best = tris.groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return tris.join(F.broadcast(best), "label", "left_anti").select("t", "label")  # one row


_MARKS = f"{_TRIS}, {_EDGES}, mark AS (SELECT DISTINCT v, CASE WHEN v % 17 < 4 THEN 1 ELSE 0 END + CASE WHEN (v // 17) % 17 < 4 THEN 2 ELSE 0 END AS label FROM (SELECT a AS v FROM tris UNION ALL SELECT b FROM tris UNION ALL SELECT c FROM tris)), lt AS (SELECT t, ma.label | mb.label | mc.label AS label FROM tris JOIN mark ma ON ma.v = a JOIN mark mb ON mb.v = b JOIN mark mc ON mc.v = c)"


def _labelled_triangles(spark, sf_dir):
    def label(k):
        at = mesh.corner_place(LI, k)
        return F.when(at[0] < 4, 1).otherwise(0) + F.when(at[1] < 4, 2).otherwise(0)

    tris = _tris(spark, sf_dir)
    return tris.withColumn("label", label("a").bitwiseOR(label("b")).bitwiseOR(label("c")).cast("int"))


@job(f"{_MARKS}\n---\nSELECT t, label, label = 0 AS kept FROM lt", "li", "t label", "kept")
def triangle_labels(spark, sf_dir):
    """The union of each triangle's vertex labels (1: near x = 0, 2: near y = 0), and which stay when labelled ones are left out as holes."""
    return _labelled_triangles(spark, sf_dir).select("t", "label", (F.col("label") == 0).alias("kept"))


@job(f"{_MARKS}\n---\nSELECT s.u, s.v, count(*) AS triangles, min(label) AS least, max(label) AS most FROM sides s JOIN lt USING (t) GROUP BY s.u, s.v HAVING count(*) = 1 OR (min(label) = 0 AND max(label) > 0)", "li", "u v triangles least most")
def label_borders(spark, sf_dir):
    """Edges without an opposite, or between a triangle without a label and one with."""
    sides = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    held = _labelled_triangles(spark, sf_dir).select("label", F.explode(sides).alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("triangles"), F.min("label").alias("least"), F.max("label").alias("most"))
    return held.where("triangles = 1 OR (least = 0 AND most > 0)")


@job(f"{_TRIS}\n---\nSELECT t, CASE WHEN (a <= b AND b <= c) OR (b <= c AND c <= a) OR (c <= a AND a <= b) THEN 1 ELSE -1 END AS turn FROM tris", "li", "t turn")
def triangle_turns(spark, sf_dir):
    """Whether a triangle's corners rise around it (1) or fall (-1)."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rises = ((a <= b) & (b <= c)) | ((b <= c) & (c <= a)) | ((c <= a) & (a <= b))
    return _tris(spark, sf_dir).select("t", F.when(rises, 1).otherwise(-1).alias("turn"))


@job(f"e AS (SELECT a.id, a.x, a.y, a.z FROM g a JOIN g b ON b.z = a.z AND b.y = a.y AND b.x = a.x + 1 WHERE (a.val < {ISO}) <> (b.val < {ISO}))\n---\nSELECT g.id, (SELECT count(*) FROM e WHERE e.y = g.y AND e.z = g.z AND e.x < g.x) % 2 = 1 AS odd FROM g", "li", "id", "odd")
def parity_from_mesh(spark, sf_dir):
    """Inside by parity along x, from the mesh: a cell is inside after an odd number of faces across its row."""
    tris = _tris(spark, sf_dir).where((F.col("t") % 6).isin(0, 1)).select(F.floor(F.col("t") / 6).alias("id")).distinct()
    crossed = grids.shipped(spark, sf_dir).join(tris.withColumn("crossed", F.lit(1)), "id", "left")
    before = Window.partitionBy("y", "z").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    return crossed.select("id", (F.coalesce(F.sum("crossed").over(before), F.lit(0)) % 2 == 1).alias("odd"))


@job(f"\n---\nSELECT min(y) FILTER (val < {ISO}) AS min_inside, max(y) FILTER (val < {ISO}) AS max_inside, min(y) FILTER (val >= {ISO}) AS min_outside, max(y) FILTER (val >= {ISO}) AS max_outside FROM g WHERE x BETWEEN 1 AND 14 AND y BETWEEN 1 AND 14 AND z BETWEEN 1 AND 82", "li", "min_inside max_inside min_outside max_outside")
def inside_extent(spark, sf_dir):
    """How far inside and outside reach along y, borders aside."""
    inner = grids.shipped(spark, sf_dir).where(F.col("x").between(1, LI.nx - 2) & F.col("y").between(1, LI.ny - 2) & F.col("z").between(1, LI.nz - 2))
    side = {"inside": F.col("val") < ISO, "outside": F.col("val") >= ISO}
    return inner.agg(*[f(F.when(c, F.col("y"))).alias(f"{n}_{k}") for k, c in side.items() for n, f in (("min", F.min), ("max", F.max))])


@job(f"\n---\nSELECT (x - 1) // 3 AS x, (y - 1) // 3 AS y, (z - 1) // 3 AS z, 2 * sum(CASE WHEN val < {ISO} THEN -1 ELSE 1 END) - 1 AS value_54ths FROM g WHERE x BETWEEN 1 AND 12 AND y BETWEEN 1 AND 12 AND z BETWEEN 1 AND 81 GROUP BY (x - 1) // 3, (y - 1) // 3, (z - 1) // 3", "li", "x y z value_54ths")
def reduced_signs(spark, sf_dir):
    """Means of signs over 3x3x3 blocks from cell 1 on, less half a cell's share; times 54 to stay whole."""
    third = [F.floor((F.col(a) - 1) / 3).alias(a) for a in "xyz"]
    whole = [F.col(a).between(1, (n - 2) // 3 * 3) for a, n in zip("xyz", LI[:3], strict=True)]
    sign = F.when(F.col("val") < ISO, -1).otherwise(1)
    return grids.shipped(spark, sf_dir).where(whole[0] & whole[1] & whole[2]).groupBy(*third).agg((2 * F.sum(sign) - 1).alias("value_54ths"))


# --- octrees ---


@job(f"{_LEVELS}, anc AS (SELECT g.id, p.level, p.f, p.unknown FROM g JOIN pyr p ON p.ix = g.x >> p.level AND p.iy = g.y >> p.level AND p.iz = g.z >> p.level)\n---\nSELECT id, max(f) FILTER (level = 2) AS at_two, bool_or(unknown AND level > 0) AS any_unknown, max(level) AS depth, coalesce(arg_max(f, level) FILTER (f <> 0), 0) AS leaf_value FROM anc GROUP BY id", "li", "id at_two depth leaf_value", "any_unknown")
def ancestor_lookups(spark, sf_dir):
    """Of every cell: its ancestor's value at level 2, whether any ancestor is unknown, the tree's depth, and the value of the coarsest
    unmixed cell over it."""
    keys = grids.shipped(spark, sf_dir).select("id", "x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("level"))
    keys = keys.select("id", "level", *[F.expr(f"CAST(shiftright({a}, level) AS BIGINT)").alias(f"i{a}") for a in "xyz"])
    found = keys.join(_pyramid(spark, sf_dir), ["level", "ix", "iy", "iz"])
    leaf = F.max_by(F.when(F.col("f") != 0, F.col("f")), F.when(F.col("f") != 0, F.col("level")))
    return found.groupBy("id").agg(F.max(F.when(F.col("level") == 2, F.col("f"))).alias("at_two"), F.bool_or(F.col("unknown") & (F.col("level") > 0)).alias("any_unknown"), F.max("level").alias("depth"), F.coalesce(leaf, F.lit(0)).alias("leaf_value"))


@job(f"{_LEVELS}\n---\nSELECT a.ix, a.iy, a.iz, count(b.f) AS present, count(*) FILTER ((b.f < 0) <> (a.f < 0)) AS differing FROM pyr a LEFT JOIN pyr b ON b.level = 1 AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 WHERE a.level = 1 GROUP BY a.ix, a.iy, a.iz", "li", "ix iy iz present differing")
def octree_neighbours(spark, sf_dir):
    """The 27 cells around each cell of level 1: how many there are, and how many have another sign."""
    level = _pyramid(spark, sf_dir).where("level = 1").select("ix", "iy", "iz", "f")
    offs = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip("xyz", o, strict=True)]) for o in OFFSETS_3D])
    moved = level.withColumn("o", F.explode(offs)).select("ix", "iy", "iz", "f", *[(F.col(f"i{a}") + F.col(f"o.{a}")).alias(f"n{a}") for a in "xyz"])
    near = level.select(*[F.col(f"i{a}").alias(f"n{a}") for a in "xyz"], F.col("f").alias("g"))
    met = moved.join(near, ["nx", "ny", "nz"])
    return met.groupBy("ix", "iy", "iz").agg(F.count("*").alias("present"), F.count_if((F.col("g") < 0) != (F.col("f") < 0)).alias("differing"))


@job(f"{_LEVELS}\n---\nSELECT ix, iy, iz, f, unknown FROM pyr WHERE level = 2 AND ix BETWEEN 1 AND 2 AND iy BETWEEN 0 AND 1 AND iz BETWEEN 3 AND 9", "li", "ix iy iz f", "unknown")
def octree_range(spark, sf_dir):
    """The cells of a box at one level."""
    inside = F.col("ix").between(1, 2) & F.col("iy").between(0, 1) & F.col("iz").between(3, 9)
    return _pyramid(spark, sf_dir).where((F.col("level") == 2) & inside).select("ix", "iy", "iz", "f", "unknown")


@job(f"{_LEVELS}\n---\nSELECT level, ix, iy, iz, -f AS f, unknown OR (level = 1 AND f <> 0) AS unknown, NOT (level <= 2 AND ix >> (2 - level) = 1) AS kept FROM pyr WHERE level <= 2", "li", "level ix iy iz f", "unknown kept")
def octree_updates(spark, sf_dir):
    """Updates of sub-trees: every sign changed, the unmixed cells of level 1 made unknown, a flag set below one cell of level 2."""
    tree = _pyramid(spark, sf_dir).where("level <= 2")
    below = F.expr("shiftright(ix, 2 - level)") == 1
    return tree.select("level", "ix", "iy", "iz", (-F.col("f")).alias("f"), (F.col("unknown") | ((F.col("level") == 1) & (F.col("f") != 0))).alias("unknown"), (~below).alias("kept"))


@job(f"{_LEVELS}, n AS (SELECT a.ix, a.iy, a.iz, bool_or((b.f < 0) <> (a.f < 0)) OR (a.f < 0 AND (a.ix IN (0, 15) OR a.iy IN (0, 15) OR a.iz IN (0, 83))) AS on_surface FROM pyr a JOIN pyr b ON b.level = 0 AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 WHERE a.level = 0 GROUP BY a.ix, a.iy, a.iz, a.f)\n---\nSELECT ix, iy, iz, on_surface, NOT on_surface AS unknown FROM n", "li", "ix iy iz", "on_surface unknown")
def reset_unknowns(spark, sf_dir):
    """Finest cells on the isosurface stay known, all others become unknown."""
    cells = grids.shipped(spark, sf_dir).withColumn("f", F.col("val") - ISO)
    around = stencil.block(cells, "f")
    differs = F.greatest(*[F.coalesce((stencil.at(o) < 0) != (F.col("f") < 0), F.col("f") < 0).cast("int") for o in OFFSETS_26]) == 1
    return around.select(*[F.col(a).alias(f"i{a}") for a in "xyz"], differs.alias("on_surface"), (~differs).alias("unknown"))


@job(f"{_LEVELS}, whole AS (SELECT level, ix, iy, iz, f FROM pyr WHERE f <> 0), c AS (SELECT g.x, g.y, w.level, w.f FROM g LEFT JOIN whole w ON w.ix = g.x >> w.level AND w.iy = g.y >> w.level AND w.iz = g.z >> w.level WHERE g.z = 40)\n---\nSELECT x, y, coalesce(max(level), 0) AS level, coalesce(arg_max(f, level), 0) AS value FROM c GROUP BY x, y", "li", "x y level value")
def octree_slice(spark, sf_dir):
    """One slice through the octree: the coarsest unmixed cell at each pixel and its level."""
    keys = grids.shipped(spark, sf_dir).where("z = 40").select("x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("level"))
    keys = keys.select("x", "y", "level", *[F.expr(f"CAST(shiftright({a}, level) AS BIGINT)").alias(f"i{a}") for a in "xyz"])
    found = keys.join(_pyramid(spark, sf_dir).where("f <> 0").select("level", "ix", "iy", "iz", "f"), ["level", "ix", "iy", "iz"], "left")
    level = F.max(F.when(F.col("f").isNotNull(), F.col("level")))
    return found.groupBy("x", "y").agg(F.coalesce(level, F.lit(0)).alias("level"), F.coalesce(F.max_by("f", F.when(F.col("f").isNotNull(), F.col("level"))), F.lit(0)).alias("value"))


# --- run lengths, slices, copies ---


@job(f"{_RUNS}\n---\nSELECT z, y, start, len, inside FROM runs WHERE y = 5", "li", "z y start len", "inside")
def run_slice(spark, sf_dir):
    """One y slice of the run-length grid."""
    return _runs(spark, sf_dir).where("y = 5").select("z", "y", "start", "len", "inside")


@job(f"m AS (SELECT *, val < {ISO} AS inside FROM g), c AS (SELECT *, coalesce(inside <> lag(inside) OVER w, true) AS starts FROM m WINDOW w AS (PARTITION BY x, y ORDER BY z)), k AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY x, y ORDER BY z) AS run FROM c)\n---\nSELECT x, y, min(z) AS start, count(*) AS len, bool_or(inside) AS inside FROM k GROUP BY x, y, run", "li", "x y start len", "inside")
def transposed_runs(spark, sf_dir):
    """The runs along z instead of x: expanded, turned and compressed again."""
    cells = _runs(spark, sf_dir).select("z", "y", "inside", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("x"))
    w = Window.partitionBy("x", "y").orderBy("z")
    starts = F.coalesce(F.col("inside") != F.lag("inside").over(w), F.lit(True)).cast("int")
    runs = cells.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w))
    return runs.groupBy("x", "y", "run").agg(F.min("z").alias("start"), F.count("*").alias("len"), F.bool_or("inside").alias("inside")).drop("run")


@job("\n---\nSELECT b.i AS level, count(g.id) AS n FROM range(65536) b(i) LEFT JOIN g ON g.val = b.i GROUP BY b.i", "li", "level n")
def full_histogram(spark, sf_dir):
    """Cells of each of the 65536 levels, empty ones too."""
    counts = grids.shipped(spark, sf_dir).groupBy(F.col("val").alias("level")).agg(F.count("*").alias("n"))
    return spark.range(65536).withColumnRenamed("id", "level").join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


@job(f"\n---\nSELECT z, y, string_agg(CAST(val AS VARCHAR), chr(9) ORDER BY x) AS line FROM g WHERE x BETWEEN 2 AND 9 AND y BETWEEN 1 AND 6 AND z BETWEEN 10 AND 20 GROUP BY z, y", "li", "z y", "line")
def region_dump(spark, sf_dir):
    """A box's values as text, a line for each row."""
    box = grids.shipped(spark, sf_dir).where("x BETWEEN 2 AND 9 AND y BETWEEN 1 AND 6 AND z BETWEEN 10 AND 20")
    row = F.array_sort(F.collect_list(F.struct("x", "val")))
    return box.groupBy("z", "y").agg(F.array_join(F.transform(row, lambda e: e["val"].cast("string")), "\t").alias("line"))


@job(f"\n---\nSELECT t, y, string_agg(CASE WHEN val < {ISO} THEN 'x' ELSE '.' END, '' ORDER BY z, x) AS line FROM g GROUP BY t, y", "li_4d", "t y", "line")
def series_images(spark, sf_dir):
    """Each step's inside mask as one image, its slices side by side."""
    mark = F.struct("z", "x", F.when(F.col("val") < ISO, "x").otherwise(".").alias("c"))
    return grids.shipped_4d(spark, sf_dir).groupBy("t", "y").agg(F.array_sort(F.collect_list(mark)).alias("r")).select("t", "y", F.array_join(F.transform("r", lambda e: e["c"]), "").alias("line"))


@job(f"{ORDERED}, k AS (SELECT max(ord) AS cut FROM o WHERE val <= {ISO})\n---\nSELECT id, val <= {ISO} AS by_value, ord <= cut AS by_rank FROM o, k", "li", "id", "by_value by_rank")
def inside_by_order(spark, sf_dir):
    """Inside by value and by rank up to the last cell at the level: the same cells."""
    cells = order.ranked(grids.shipped(spark, sf_dir))
    cut = cells.where(F.col("val") <= ISO).agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("cut"))
    return cells.crossJoin(F.broadcast(cut)).select("id", (F.col("val") <= ISO).alias("by_value"), (F.col("ord") <= F.col("cut")).alias("by_rank"))  # one row


@job(f"\n---\nSELECT a.t, count(*) FILTER ((a.val < {ISO}) <> (bx.val < {ISO})) AS across_x, count(*) FILTER ((a.val < {ISO}) <> (bz.val < {ISO})) AS across_z FROM g a LEFT JOIN g bx ON bx.t = a.t AND bx.z = a.z AND bx.y = a.y AND bx.x = a.x + 1 LEFT JOIN g bz ON bz.t = a.t AND bz.x = a.x AND bz.y = a.y AND bz.z = a.z + 1 GROUP BY a.t", "li_4d", "t across_x across_z")
def series_faces(spark, sf_dir):
    """Faces between inside and outside in every step, along x and z."""
    inside = F.col("val") < ISO
    after = lambda a: F.lead(inside).over(Window.partitionBy(*[c for c in "xyzt" if c != a]).orderBy(a))
    marked = grids.shipped_4d(spark, sf_dir).select("t", (after("x") != inside).alias("fx"), (after("z") != inside).alias("fz"))
    return marked.groupBy("t").agg(F.count_if("fx").alias("across_x"), F.count_if("fz").alias("across_z"))


# --- floods and seeds ---

_SEED = f"""{ORDERED}, seed AS (SELECT z, arg_min(id, ord) AS seed, min(val) AS low FROM o WHERE z % 4 = 0 GROUP BY z),
n AS (SELECT a.id AS a, b.id AS b, b.z AS z, b.val AS val FROM o a JOIN o b ON {_VERTEX} AND a.id <> b.id),
f(seed, z0, id) AS (SELECT seed, z, seed FROM seed WHERE low <= {ISO_SMALL} UNION SELECT f.seed, f.z0, n.b FROM f JOIN n ON n.a = f.id WHERE n.val <= {ISO_SMALL} AND n.z BETWEEN f.z0 - 1 AND f.z0 + 2)"""


@job(f"{_SEED}\n---\nSELECT id, count(*) AS seeds, min(seed) AS first FROM f GROUP BY id", "li_small", "id seeds first", recursive=True)
def seed_tracing(spark, sf_dir):
    """Seeds (the least cell of every fourth slice) each flooded within their window of four slices; the union with how many reach a cell."""
    cells = order.ranked(grids.shipped_small(spark, sf_dir))
    seeds = cells.where("z % 4 = 0").groupBy("z").agg(F.min_by("id", "ord").alias("seed"), F.min("val").alias("low")).where(F.col("low") <= ISO_SMALL).select(F.col("z").alias("z0"), "seed")
    inside = cells.where(F.col("val") <= ISO_SMALL).withColumn("z0", F.explode(F.sequence(F.col("z") - 2, F.col("z") + 1))).join(F.broadcast(seeds), "z0")  # a seed for every fourth slice
    parts = flood.labelled(inside.select("seed", "id", "x", "y", "z"), ["seed"])
    own = parts.where("id = seed").select("seed", "label")
    return parts.join(own, ["seed", "label"]).groupBy("id").agg(F.count("*").alias("seeds"), F.min("seed").alias("first"))


@job(f"""{ORDERED}, n AS (SELECT a.id AS a, b.id AS b FROM o a JOIN o b ON a.z = b.z AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id WHERE a.val <= {ISO_SMALL} AND b.val <= {ISO_SMALL}),
f(z, id) AS (SELECT z, arg_min(id, ord) FROM o WHERE val <= {ISO_SMALL} GROUP BY z UNION SELECT f.z, n.b FROM f JOIN n ON n.a = f.id)
---
SELECT z, id FROM f""", "li_small", "z id", recursive=True)
def slice_masks(spark, sf_dir):
    """The contour of every slice that its least cell lies in."""
    cells = order.ranked(grids.shipped_small(spark, sf_dir)).where(F.col("val") <= ISO_SMALL)
    parts = flood.labelled(cells, ["z"], [o for o in OFFSETS_26 if o[2] == 0])
    least = cells.groupBy("z").agg(F.min_by("id", "ord").alias("id"))
    return parts.join(parts.join(least, ["z", "id"]).select("z", "label"), ["z", "label"]).select("z", "id")


@job(f"""s AS (SELECT *, val - {ISO_SMALL} AS f FROM g), n AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON {_VERTEX} AND a.id <> b.id),
d(id, dist) AS (SELECT id, 0 FROM s WHERE abs(f) <= 100 UNION SELECT n.b, d.dist + 1 FROM d JOIN n ON n.a = d.id WHERE d.dist < 20)
---
SELECT s.id, min(dist) * CASE WHEN any_value(s.f) < 0 THEN -1 ELSE 1 END AS ramp FROM s JOIN d USING (id) GROUP BY s.id""", "li_small", "id ramp", recursive=True)
def outward_ramp(spark, sf_dir):
    """Layers over vertex neighbours from the cells near the level, signed by the side."""
    cells = grids.shipped_small(spark, sf_dir).withColumn("f", F.col("val") - ISO_SMALL)
    found = flood.distances(cells.withColumn("seed", F.abs("f") <= 100).select("id", "x", "y", "z", "seed"), OFFSETS_26)
    return found.join(cells.select("id", "f"), "id").select("id", F.when(F.col("f") < 0, -F.col("dist")).otherwise(F.col("dist")).alias("ramp"))


# --- vectors ---

_NAMES = [f"{p}_{k}" for p in "abcp" for k in "xyz"]
_V3 = "v AS (SELECT vec_id, " + ", ".join(f"CAST(floor(1000 * CAST(embedding[{i + 1}] AS DOUBLE)) AS BIGINT) AS {c}" for i, c in enumerate(_NAMES)) + " FROM embeddings)"


def _cross_sql(u, v):
    return [f"(({u[(i + 1) % 3]}) * ({v[(i + 2) % 3]}) - ({u[(i + 2) % 3]}) * ({v[(i + 1) % 3]}))" for i in range(3)]


def _minus_sql(p, q):
    return [f"{p}_{k} - {q}_{k}" for k in "xyz"]


def _dot_sql(u, v):
    return "(" + " + ".join(f"({a}) * ({b})" for a, b in zip(u, v, strict=True)) + ")"


_NORMAL = _cross_sql(_minus_sql("b", "a"), _minus_sql("c", "a"))
_PRISM = [_dot_sql(_NORMAL, _cross_sql(_minus_sql(q, r), _minus_sql("p", r))) for q, r in (("c", "b"), ("a", "c"), ("b", "a"))]


@job(f"{_V3}, d AS (SELECT *, {_PRISM[0]} AS da, {_PRISM[1]} AS db, {_PRISM[2]} AS dc, {_dot_sql(_NORMAL, _minus_sql('p', 'a'))} AS side FROM v)\n---\nSELECT vec_id, a_x + b_x AS plus_x, a_y - b_y AS minus_y, 3 * a_z AS scaled_z, CAST(floor(sqrt(CAST(a_x * a_x + a_y * a_y + a_z * a_z AS DOUBLE))) AS BIGINT) AS length, (da < 0 AND db < 0 AND dc < 0) OR (da > 0 AND db > 0 AND dc > 0) AS in_prism, sign(side) AS side FROM d", None, "vec_id plus_x minus_y scaled_z length side", "in_prism")
def vector_algebra(spark, sf_dir):
    """Sums, differences, multiples and lengths of 3-vectors; whether a point lies over a triangle, and on which side of its plane."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *[F.floor(1000 * F.col("embedding")[i].cast("double")).cast("long").alias(n) for i, n in enumerate(_NAMES)])
    at = {k: [F.col(f"{k}_{a}") for a in "xyz"] for k in "abcp"}
    minus = lambda p, q: [x - y for x, y in zip(p, q, strict=True)]
    cross = lambda p, q: [p[(i + 1) % 3] * q[(i + 2) % 3] - p[(i + 2) % 3] * q[(i + 1) % 3] for i in range(3)]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    normal = cross(minus(at["b"], at["a"]), minus(at["c"], at["a"]))
    da, db, dc = (dot(normal, cross(minus(at[q], at[r]), minus(at["p"], at[r]))) for q, r in (("c", "b"), ("a", "c"), ("b", "a")))
    inside = ((da < 0) & (db < 0) & (dc < 0)) | ((da > 0) & (db > 0) & (dc > 0))
    length = F.floor(F.sqrt(dot(at["a"], at["a"]).cast("double")))
    side = F.signum(dot(normal, minus(at["p"], at["a"]))).cast("long")
    return v.select("vec_id", (at["a"][0] + at["b"][0]).alias("plus_x"), (at["a"][1] - at["b"][1]).alias("minus_y"), (3 * at["a"][2]).alias("scaled_z"), length.alias("length"), inside.alias("in_prism"), side.alias("side"))


@job("v AS (SELECT vec_id, [CAST(floor(100 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding[1:16]] AS a, [CAST(floor(100 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding[17:32]] AS b FROM embeddings)\n---\nSELECT vec_id, c AS col, r AS row, " + " + ".join(f"a[{k} * 4 + r + 1] * b[c * 4 + {k} + 1]" for k in range(4)) + " AS value FROM v, (SELECT unnest([0,1,2,3]) AS r), (SELECT unnest([0,1,2,3]) AS c)", None, "vec_id col row value")
def matrix_products(spark, sf_dir):
    """Products of 4x4 matrices kept by columns, from each vector's first and second sixteen components."""
    sixteen = lambda lo: F.transform(F.slice("embedding", lo, 16), lambda x: F.floor(100 * x.cast("double")).cast("long"))
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", sixteen(1).alias("a"), sixteen(17).alias("b"))
    cells = [F.struct(F.lit(c).alias("col"), F.lit(r).alias("row"), sum((F.get("a", F.lit(4 * k + r)) * F.get("b", F.lit(4 * c + k)) for k in range(4)), F.lit(0)).alias("value")) for r in range(4) for c in range(4)]
    return v.select("vec_id", F.explode(F.array(*cells)).alias("m")).select("vec_id", "m.*")
