"""Jobs over the filtration's topology: links, critical cells, trees and contour queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.masks import OFFSETS_6, OFFSETS_26, changes_topology, changes_topology_2d, closed, euler, wide
from ..operators import order, query, stencil, trees, window_tree
from ..sources import grids
from ..sources.grids import EVENTS, LI_SMALL
from .common import NEIGHBOURS_26, ORDERED, RING_TEST, SLICE_MASK, STRICT_TEST, VOLUME_MASK, job


def _ordered(spark, sf_dir):
    return order.ranked(grids.shipped(spark, sf_dir))


def _slice_masks(spark, sf_dir):
    cells = stencil.block(_ordered(spark, sf_dir), "ord", axes="xy")
    return cells.withColumn("mask", stencil.slice_mask("ord"))


def _volume_masks(spark, sf_dir, grid=None):
    cells = grid(spark, sf_dir) if grid else grids.shipped(spark, sf_dir)
    return query.link_terms(order.ranked(cells))


@job(f"{SLICE_MASK},\n{RING_TEST}\n---\nSELECT id, m2.mask, transitions <> 2 AS critical FROM m2 JOIN test2 USING (mask)", "li", "id mask", "critical")
def slice_critical(spark, sf_dir):
    """Lower link of each cell within its slice, and whether adding the cell changes the slice's topology."""
    return _slice_masks(spark, sf_dir).select("id", "mask", changes_topology_2d(F.col("mask")).alias("critical"))


@job(f"{SLICE_MASK},\n{RING_TEST}\n---\nSELECT z, count(*) FILTER (transitions <> 2) AS n_critical, count(*) FILTER (m2.mask = 0) AS n_minima, count(*) FILTER (m2.mask = 255) AS n_full FROM m2 JOIN test2 USING (mask) GROUP BY z", "li", "z n_critical n_minima n_full")
def criticals_in_slices(spark, sf_dir):
    """Critical cells per slice."""
    cells = _slice_masks(spark, sf_dir)
    return cells.groupBy("z").agg(F.count_if(changes_topology_2d(F.col("mask"))).alias("n_critical"), F.count_if(F.col("mask") == 0).alias("n_minima"), F.count_if(F.col("mask") == 255).alias("n_full"))


@job(f"{SLICE_MASK},\n{RING_TEST}\n---\nSELECT m2.mask, any_value(transitions) AS transitions, count(*) AS n FROM m2 JOIN test2 USING (mask) GROUP BY m2.mask", "li", "mask transitions n")
def slice_cases(spark, sf_dir):
    """How often each of the 256 slice cases occurs, with its transitions around the ring."""
    cells = _slice_masks(spark, sf_dir).groupBy("mask").agg(F.count("*").alias("n"))
    from ..functions.masks import ring_transitions

    return cells.select("mask", ring_transitions(F.col("mask")).alias("transitions"), "n")


@job(f"{VOLUME_MASK}\n---\nSELECT id, ord, mask FROM m3", "li", "id ord mask")
def lower_links(spark, sf_dir):
    """The 26-bit lower link of every cell."""
    return _volume_masks(spark, sf_dir).select("id", "ord", "mask")


@job(f"{VOLUME_MASK},\n{STRICT_TEST.format(source='m3')}\n---\nSELECT id, critical FROM m3 JOIN test3 USING (mask)", "li_small", "id", "critical", recursive=True)
def volume_critical(spark, sf_dir):
    """Cells whose adding changes the topology of the volume (strict test)."""
    cells = _volume_masks(spark, sf_dir, grids.shipped_small)
    return cells.select("id", changes_topology(F.col("mask")).alias("critical"))


@job(f"{VOLUME_MASK},\n{STRICT_TEST.format(source='m3')}\n---\nSELECT z, count(*) FILTER (critical) AS n_critical, count(*) AS n FROM m3 JOIN test3 USING (mask) GROUP BY z", "events", "z n_critical n", recursive=True)
def criticals_in_volume(spark, sf_dir):
    cells = _volume_masks(spark, sf_dir, grids.activity)
    return cells.groupBy("z").agg(F.count_if(changes_topology(F.col("mask"))).alias("n_critical"), F.count("*").alias("n"))


_THICK = "thick AS (SELECT id, z, mask & ~511 AS mask, 'left' AS side FROM m3 WHERE z < 11 UNION ALL SELECT id, z, mask | 511, 'left' FROM m3 WHERE z < 11 UNION ALL SELECT id, z, mask & ~66977792, 'right' FROM m3 WHERE z > 0 UNION ALL SELECT id, z, mask | 66977792, 'right' FROM m3 WHERE z > 0)"


@job(f"{VOLUME_MASK}, {_THICK},\n{STRICT_TEST.format(source='thick')}\n---\nSELECT pair, count(*) FILTER (c) AS n_critical FROM (SELECT id, side, CASE WHEN side = 'left' THEN z ELSE z - 1 END AS pair, bool_or(critical) AS c FROM thick JOIN test3 USING (mask) GROUP BY ALL) GROUP BY pair", "li_small", "pair n_critical", recursive=True)
def criticals_in_thick_slices(spark, sf_dir):
    """Critical cells of each pair of consecutive slices: critical with the far slice all out or all in."""
    cells, far = _volume_masks(spark, sf_dir, grids.shipped_small), {"left": query.FIRST_SLICE, "right": query.LAST_SLICE}
    test = {k: changes_topology(F.col("mask").bitwiseAND(F.lit(~v))) | changes_topology(F.col("mask").bitwiseOR(F.lit(v))) for k, v in far.items()}
    sides = F.array(F.struct(F.col("z").alias("pair"), test["left"].alias("c")), F.struct((F.col("z") - 1).alias("pair"), test["right"].alias("c")))
    return cells.select(F.explode(sides).alias("s")).where(F.col("s.pair").between(0, LI_SMALL.nz - 2)).groupBy("s.pair").agg(F.count_if("s.c").alias("n_critical"))


_CLOSURE_SQL = """masks AS (SELECT DISTINCT mask FROM m3),
marked AS (SELECT mask, dx, dy, dz FROM masks, off WHERE (mask >> CAST(bit AS INT)) & 1 = 1),
closure AS (SELECT DISTINCT m.mask, o2.dx, o2.dy, o2.dz FROM marked m JOIN off o2 ON (m.dx = 0 OR m.dx = o2.dx) AND (m.dy = 0 OR m.dy = o2.dy) AND (m.dz = 0 OR m.dz = o2.dz)),
e AS (SELECT mask, sum(CASE WHEN abs(dx) + abs(dy) + abs(dz) = 2 THEN -1 ELSE 1 END) AS chi, count(*) AS n FROM closure GROUP BY mask)"""


@job(f"{VOLUME_MASK},\n{_CLOSURE_SQL}\n---\nSELECT id, coalesce(chi, 0) AS chi_below, coalesce(n, 0) AS n_below FROM m3 LEFT JOIN e USING (mask)", "li", "id chi_below n_below")
def link_euler(spark, sf_dir):
    """Euler characteristic and cell count of the closed lower link."""
    m = closed(wide(F.col("mask")))
    return _volume_masks(spark, sf_dir).select("id", euler(m).alias("chi_below"), F.bit_count(m).alias("n_below"))


@job(f"""{ORDERED}, {NEIGHBOURS_26},
m3 AS (SELECT a.id, a.z, coalesce(bit_or(CASE WHEN b.ord > a.ord THEN CAST(1 AS BIGINT) << CAST(off.bit AS INT) ELSE 0 END), 0) AS mask
  FROM o a CROSS JOIN off LEFT JOIN o b ON b.x = a.x + off.dx AND b.y = a.y + off.dy AND b.z = a.z + off.dz GROUP BY ALL),
{_CLOSURE_SQL}
---
SELECT z, sum(coalesce(chi, 0)) AS chi_above, sum(coalesce(n, 0)) AS n_above, count(*) FILTER (mask = 0) AS n_maxima FROM m3 LEFT JOIN e USING (mask) GROUP BY z""", "li", "z chi_above n_above n_maxima")
def upper_link_euler(spark, sf_dir):
    """The same over upper links, summed by slice; cells without any are maxima."""
    falling = order.ranked(grids.shipped(spark, sf_dir), descending=True)
    cells, m = query.link_terms(falling), closed(wide(F.col("mask")))
    return cells.groupBy("z").agg(F.sum(euler(m)).alias("chi_above"), F.sum(F.bit_count(m)).alias("n_above"), F.count_if(F.col("mask") == 0).alias("n_maxima"))


@job(f"""{ORDERED}
---
SELECT a.id, arg_min(b.id, b.ord) AS least_id, min(b.ord) AS least_ord FROM o a JOIN o b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 GROUP BY a.id""", "events", "id least_id least_ord")
def steepest_neighbour(spark, sf_dir):
    """The lowest-ranked of each cell and its neighbours."""
    return _steepest(order.ranked(grids.activity(spark, sf_dir))).select("id", "least_id", "least_ord")


def _steepest(cells):
    packed = stencil.block(cells.withColumn("p", F.struct("ord", "id")), "p")
    least = F.array_min(F.array_compact("around"))
    return packed.withColumn("m", least).select("id", "ord", F.col("m.id").alias("least_id"), F.col("m.ord").alias("least_ord"))


@job(f"""{ORDERED},
d AS (SELECT a.id, arg_min(b.id, b.ord) AS nxt FROM o a JOIN o b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 GROUP BY a.id),
t(id, here) AS (SELECT id, nxt FROM d UNION SELECT t.id, d.nxt FROM t JOIN d ON d.id = t.here)
---
SELECT t.id, t.here AS minimum FROM t JOIN d ON d.id = t.here WHERE d.nxt = d.id""", "events", "id minimum", recursive=True)
def trace_to_minimum(spark, sf_dir):
    """The local minimum that steepest descent from each cell ends in, by doubling the steps each round."""
    from ..operators.flood import follow

    return follow(_steepest(order.ranked(grids.activity(spark, sf_dir))).select("id", F.col("least_id").alias("at"))).select("id", F.col("at").alias("minimum"))


def _slice_tree(spark, sf_dir):
    cells = order.ranked_within(grids.activity(spark, sf_dir), ["z"])
    return trees.sweep_tree(cells, ["z"], [o for o in OFFSETS_26 if o[2] == 0])


_SLICE_REACH = """o AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY val, id) - 1 AS ord FROM g),
n AS (SELECT a.id AS a, b.id AS b, b.ord AS bord FROM o a JOIN o b ON a.z = b.z AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id),
reach(p, pord, c) AS (SELECT id, ord, id FROM o UNION SELECT r.p, r.pord, n.b FROM reach r JOIN n ON n.a = r.c AND n.bord <= r.pord),
tree AS (SELECT o.z, o.id AS node, (SELECT arg_min(r.p, r.pord) FROM reach r WHERE r.c = o.id AND r.pord > o.ord) AS upper FROM o)"""


@job(f"{_SLICE_REACH}\n---\nSELECT z, node, coalesce(upper, -1) AS upper FROM tree", "events", "z node upper", recursive=True)
def slice_join_trees(spark, sf_dir):
    """The augmented join tree of each slice (-1: no upper node)."""
    return _slice_tree(spark, sf_dir).fillna(-1, ["upper"])


@job(f"{_SLICE_REACH.replace('ORDER BY val, id', 'ORDER BY val DESC, id DESC').replace('abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id', 'abs(a.x - b.x) + abs(a.y - b.y) = 1')}\n---\nSELECT z, node, coalesce(upper, -1) AS upper FROM tree", "events", "z node upper", recursive=True)
def slice_split_trees(spark, sf_dir):
    """The augmented split tree: the same sweep downwards over face neighbours."""
    cells = order.reversed_order(order.ranked_within(grids.activity(spark, sf_dir), ["z"]), EVENTS.slice)
    return trees.sweep_tree(cells, ["z"], [o for o in OFFSETS_6 if o[2] == 0]).fillna(-1, ["upper"])


_DEGREES = "deg AS (SELECT t.z, t.node, t.upper, (SELECT count(*) FROM tree u WHERE u.upper = t.node) AS down FROM tree t)"


@job(f"{_SLICE_REACH}, {_DEGREES}\n---\nSELECT z, count(*) FILTER (down = 0) AS leaves, count(*) FILTER (down = 1 AND upper IS NOT NULL) AS regular, count(*) FILTER (down > 1) AS merges, count(*) FILTER (upper IS NULL) AS roots FROM deg GROUP BY z", "events", "z leaves regular merges roots", recursive=True)
def tree_node_classes(spark, sf_dir):
    """Nodes of the join trees by degree: minima, regular, merging, root."""
    d, down, up = trees.degrees(_slice_tree(spark, sf_dir), ["z"]), F.col("down"), F.col("up")
    return d.groupBy("z").agg(F.count_if(down == 0).alias("leaves"), F.count_if((down == 1) & (up == 1)).alias("regular"), F.count_if(down > 1).alias("merges"), F.count_if(up == 0).alias("roots"))


@job(f"{_SLICE_REACH}, anc(z, node, ancestor) AS (SELECT z, node, node FROM tree UNION SELECT a.z, a.node, t.upper FROM anc a JOIN tree t ON t.node = a.ancestor WHERE t.upper IS NOT NULL), {_DEGREES}\n---\nSELECT a.z, a.ancestor AS node, count(*) AS n_cells, count(*) FILTER (d.down = 0) AS n_minima FROM anc a JOIN deg d ON d.node = a.node GROUP BY ALL", "events", "z node n_cells n_minima", recursive=True)
def subtree_sizes(spark, sf_dir):
    """Cells and minima below each node."""
    edges = _slice_tree(spark, sf_dir)
    leaves = trees.degrees(edges, ["z"]).select("z", "node", (F.col("down") == 0).cast("long").alias("n_minima"))
    return trees.subtree_sums(edges.join(leaves, ["z", "node"]).withColumn("n_cells", F.lit(1)), ["z"], ["n_cells", "n_minima"])


@job(f"""{_SLICE_REACH}, {_DEGREES}, kept AS (SELECT * FROM deg WHERE down <> 1 OR upper IS NULL),
up(z, node, here) AS (SELECT z, node, upper FROM kept UNION SELECT u.z, u.node, d.upper FROM up u JOIN deg d ON d.node = u.here WHERE d.down = 1 AND d.upper IS NOT NULL)
---
SELECT z, node, coalesce(found, -1) AS upper FROM (SELECT k.z, k.node, (SELECT u.here FROM up u JOIN kept k2 ON k2.node = u.here WHERE u.node = k.node) AS found FROM kept k)""", "events", "z node upper", recursive=True)
def contracted_trees(spark, sf_dir):
    """Join trees without their regular nodes."""
    return trees.contracted(_slice_tree(spark, sf_dir), ["z"]).fillna(-1, ["upper"])


LENGTH, STEP, CUT = 4, 2, 1500
_WINDOW_SQL = f"""{ORDERED}, {NEIGHBOURS_26}, win AS (SELECT i AS window_id, i * {STEP} AS first, i * {STEP} + {LENGTH - 1} AS last FROM range({(12 - LENGTH) // STEP + 1}) r(i)),
wc AS (SELECT w.window_id, w.first, w.last, o.* FROM win w JOIN o ON o.z BETWEEN w.first AND w.last WHERE o.val <= {CUT}),
m3 AS (SELECT a.window_id, a.id, coalesce(bit_or(CASE WHEN b.ord < a.ord THEN CAST(1 AS BIGINT) << CAST(off.bit AS INT) ELSE 0 END), 0) AS mask
  FROM wc a CROSS JOIN off LEFT JOIN wc b ON b.window_id = a.window_id AND b.x = a.x + off.dx AND b.y = a.y + off.dy AND b.z = a.z + off.dz GROUP BY ALL),
{_CLOSURE_SQL},
near AS (SELECT a.window_id, a.id AS a, b.id AS b, a.z = b.z AS flat FROM wc a JOIN wc b ON a.window_id = b.window_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.id <> b.id),
whole(window_id, c, r) AS (SELECT window_id, id, id FROM wc UNION SELECT w.window_id, w.c, n.b FROM whole w JOIN near n ON n.window_id = w.window_id AND n.a = w.r),
flat(window_id, c, r) AS (SELECT window_id, id, id FROM wc UNION SELECT w.window_id, w.c, n.b FROM flat w JOIN near n ON n.window_id = w.window_id AND n.a = w.r AND n.flat),
name AS (SELECT w.window_id, w.c, arg_max(o.id, o.ord) AS node FROM whole w JOIN o ON o.id = w.r GROUP BY ALL),
fname AS (SELECT w.window_id, w.c, max(w.r) AS f FROM flat w GROUP BY ALL),
comp AS (SELECT n.window_id, n.node, count(*) AS n_cells, count(*) FILTER (m3.mask = 0) AS n_minima, count(DISTINCT f.f) FILTER (wc.z = wc.first) AS left_overlap, count(DISTINCT f.f) FILTER (wc.z = wc.last) AS right_overlap, sum(1 - coalesce(e.chi, 0)) AS chi
  FROM name n JOIN fname f ON f.window_id = n.window_id AND f.c = n.c JOIN wc ON wc.window_id = n.window_id AND wc.id = n.c JOIN m3 ON m3.window_id = n.window_id AND m3.id = n.c LEFT JOIN e ON e.mask = m3.mask GROUP BY ALL)"""
_COMPONENT = "window_id node n_cells n_minima left_overlap right_overlap chi"


def _components(spark, sf_dir):
    cells = order.ranked(grids.shipped_small(spark, sf_dir))
    return query.window_components(cells, CUT, LENGTH, STEP, LI_SMALL.nz)


@job(f"{_WINDOW_SQL}\n---\nSELECT * FROM comp", "li_small", _COMPONENT, recursive=True)
def window_components(spark, sf_dir):
    """Every component at the cut in every window, with what the selections ask for."""
    return _components(spark, sf_dir)


# Window trees by their definition: the component of every cell v, its slices' components, and the components above that it touches.
_NODE_SQL = f"""{ORDERED}, {NEIGHBOURS_26}, win AS (SELECT i AS window_id, i * {STEP} AS first, i * {STEP} + {LENGTH - 1} AS last FROM range({(12 - LENGTH) // STEP + 1}) r(i)),
wo AS (SELECT w.window_id, w.first, w.last, o.* FROM win w JOIN o ON o.z BETWEEN w.first AND w.last),
m3 AS (SELECT a.window_id, a.id, coalesce(bit_or(CASE WHEN b.ord < a.ord THEN CAST(1 AS BIGINT) << CAST(off.bit AS INT) ELSE 0 END), 0) AS mask
  FROM wo a CROSS JOIN off LEFT JOIN wo b ON b.window_id = a.window_id AND b.x = a.x + off.dx AND b.y = a.y + off.dy AND b.z = a.z + off.dz GROUP BY ALL),
{_CLOSURE_SQL},
near AS (SELECT a.window_id, a.id AS a, b.id AS b, b.ord AS bord, a.z = b.z AS flat, abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AS face FROM wo a JOIN wo b ON a.window_id = b.window_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.id <> b.id),
v AS (SELECT window_id, id AS v, ord AS vord FROM wo WHERE val <= {CUT}),
sub(window_id, v, vord, c) AS (SELECT window_id, v, vord, v FROM v UNION SELECT s.window_id, s.v, s.vord, n.b FROM sub s JOIN near n ON n.window_id = s.window_id AND n.a = s.c AND n.bord <= s.vord),
flat(window_id, v, vord, c, r) AS (SELECT window_id, v, vord, c, c FROM sub UNION SELECT f.window_id, f.v, f.vord, f.c, n.b FROM flat f JOIN near n ON n.window_id = f.window_id AND n.a = f.r AND n.flat AND n.bord <= f.vord),
slices AS (SELECT window_id, v, z, count(DISTINCT r) AS n FROM (SELECT f.window_id, f.v, o.z, f.c, max(f.r) AS r FROM flat f JOIN o ON o.id = f.c GROUP BY ALL) GROUP BY ALL),
outside(window_id, v, vord, c) AS (SELECT v.window_id, v.v, v.vord, w.id FROM v JOIN wo w ON w.window_id = v.window_id AND w.ord > v.vord AND (w.x IN (0, 7) OR w.y IN (0, 7))
  UNION SELECT s.window_id, s.v, s.vord, n.b FROM outside s JOIN near n ON n.window_id = s.window_id AND n.a = s.c AND n.face AND n.bord > s.vord),
rest AS (SELECT v.window_id, v.v, v.vord, w.id AS c FROM v JOIN wo w ON w.window_id = v.window_id AND w.ord > v.vord WHERE NOT EXISTS (SELECT 1 FROM outside s WHERE s.window_id = v.window_id AND s.v = v.v AND s.c = w.id)),
hole(window_id, v, vord, c, r) AS (SELECT window_id, v, vord, c, c FROM rest UNION SELECT h.window_id, h.v, h.vord, h.c, n.b FROM hole h JOIN near n ON n.window_id = h.window_id AND n.a = h.r AND n.face AND n.bord > h.vord),
upper AS (SELECT window_id, v, c, -1 AS comp FROM outside UNION ALL SELECT window_id, v, c, max(r) FROM hole GROUP BY ALL),
touch AS (SELECT s.window_id, s.v, u.comp FROM sub s JOIN near n ON n.window_id = s.window_id AND n.a = s.c AND n.face JOIN upper u ON u.window_id = s.window_id AND u.v = s.v AND u.c = n.b
  UNION SELECT s.window_id, s.v, -1 FROM sub s JOIN o ON o.id = s.c WHERE o.x IN (0, 7) OR o.y IN (0, 7)),
sums AS (SELECT s.window_id, s.v AS node, count(*) AS n_cells, count(*) FILTER (m3.mask = 0) AS n_minima, sum(1 - coalesce(e.chi, 0)) AS chi FROM sub s JOIN m3 ON m3.window_id = s.window_id AND m3.id = s.c LEFT JOIN e ON e.mask = m3.mask GROUP BY ALL),
nodes AS (SELECT n.*, coalesce(l.n, 0) AS left_overlap, coalesce(k.n, 0) AS next_overlap, coalesce(q.n, 0) AS right_overlap, t.contours - 1 AS cavities FROM sums n JOIN win w ON w.window_id = n.window_id
  LEFT JOIN slices l ON l.window_id = n.window_id AND l.v = n.node AND l.z = w.first LEFT JOIN slices k ON k.window_id = n.window_id AND k.v = n.node AND k.z = w.first + 1 LEFT JOIN slices q ON q.window_id = n.window_id AND q.v = n.node AND q.z = w.last
  JOIN (SELECT window_id, v, count(*) AS contours FROM touch GROUP BY ALL) t ON t.window_id = n.window_id AND t.v = n.node)"""
# Cells that are critical in their slice or in a pair of slices, by the tests above.
_FLAG_SQL = f"""w3 AS (SELECT a.id, a.z, coalesce(bit_or(CASE WHEN b.ord < a.ord THEN CAST(1 AS BIGINT) << CAST(off.bit AS INT) ELSE 0 END), 0) AS mask
  FROM o a CROSS JOIN off LEFT JOIN o b ON b.x = a.x + off.dx AND b.y = a.y + off.dy AND b.z = a.z + off.dz GROUP BY ALL),
m2 AS (SELECT id, (mask >> 9) & 255 AS mask FROM w3), {RING_TEST},
thick AS (SELECT id, mask & ~511 AS mask FROM w3 UNION ALL SELECT id, mask | 511 FROM w3 UNION ALL SELECT id, mask & ~66977792 FROM w3 UNION ALL SELECT id, mask | 66977792 FROM w3),
{STRICT_TEST.format(source="thick").replace("masks", "masks3").replace("closure", "closure3").replace("marked", "marked3")},
flagged AS (SELECT id FROM m2 JOIN test2 USING (mask) WHERE transitions <> 2 UNION SELECT id FROM thick JOIN test3 USING (mask) WHERE critical)"""
_NODE = "window_id node n_cells n_minima left_overlap next_overlap right_overlap chi cavities"


def _nodes(spark, sf_dir):
    """Nodes at or below the cut of the small grid's windows."""
    cells = order.ranked(grids.shipped_small(spark, sf_dir))
    nodes = window_tree.window_nodes(cells, LENGTH, STEP, LI_SMALL.nz).where(F.col("val") <= CUT)
    named = {"left_overlap": 0, "next_overlap": 1, "right_overlap": -1}
    return nodes.withColumns({k: window_tree.overlap(i) for k, i in named.items()})


@job(f"{_NODE_SQL}\n---\nSELECT * FROM nodes", "li_small", _NODE, recursive=True)
def window_trees(spark, sf_dir):
    """Every cell below the cut in every window, as a node of the window's trees: sizes, slice overlaps, Euler characteristic, cavities."""
    return _nodes(spark, sf_dir).select(*_NODE.split())


_CHOSEN = f"chosen AS (SELECT n.* FROM nodes n JOIN flagged f ON f.id = n.node WHERE left_overlap BETWEEN 1 AND 3 AND right_overlap BETWEEN 1 AND 3), outer_ AS (SELECT c.* FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM chosen d JOIN sub s ON s.window_id = d.window_id AND s.v = d.node WHERE d.window_id = c.window_id AND d.node <> c.node AND s.c = c.node))"


@job(f"{_NODE_SQL},\n{_FLAG_SQL},\n{_CHOSEN}\n---\nSELECT *, 1 + cavities - chi AS handles FROM outer_ WHERE cavities BETWEEN 0 AND 1 AND 1 + cavities - chi = 0", "li_small", _NODE + " handles", recursive=True)
def contour_search(spark, sf_dir):
    """Flagship: critical nodes below the cut whose components have one to three contours at either end of their window; of these the
    outermost; of these those with at most one cavity and no handle."""
    found = window_tree.outermost(_nodes(spark, sf_dir).where("critical").where(window_tree.ends_between(1, 3)))
    found = found.where(window_tree.few_cavities(1)).withColumn("handles", window_tree.handles()).where("handles = 0")
    return found.select(*_NODE.split(), "handles")


@job(f"{_NODE_SQL},\n{_FLAG_SQL},\n{_CHOSEN}\n---\nSELECT c.window_id, c.node FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM chosen d JOIN sub s ON s.window_id = c.window_id AND s.v = c.node WHERE d.window_id = c.window_id AND d.node <> c.node AND s.c = d.node)", "li_small", "window_id node", recursive=True)
def innermost_contours(spark, sf_dir):
    """The same selection, keeping the components that hold no other selected one."""
    return window_tree.innermost(_nodes(spark, sf_dir).where("critical").where(window_tree.ends_between(1, 3))).select("window_id", "node")


@job(f"{_NODE_SQL}, top AS (SELECT s.window_id, s.c AS node, arg_max(s.v, s.vord) AS ancestor FROM sub s GROUP BY ALL)\n---\nSELECT window_id, node, ancestor FROM top", "li_small", "window_id node ancestor", recursive=True)
def isovalue_ancestors(spark, sf_dir):
    """The highest node below the cut over each node: the pre-order range of the top that holds it."""
    nodes = _nodes(spark, sf_dir)
    tops = window_tree.outermost(nodes).select("window_id", F.col("enter").alias("at"), F.col("node").alias("ancestor"))
    starts = nodes.select("window_id", "node", "enter").join(tops.withColumnRenamed("at", "enter"), ["window_id", "enter"], "left")
    before = Window.partitionBy("window_id").orderBy("enter")
    return starts.select("window_id", "node", F.last("ancestor", ignorenulls=True).over(before).alias("ancestor"))


@job(f"{_NODE_SQL}\n---\nSELECT window_id, node, next_overlap, next_overlap BETWEEN 1 AND 2 AS few, next_overlap BETWEEN least(left_overlap, right_overlap) AND greatest(left_overlap, right_overlap) AS between_ends, chi BETWEEN 0 AND 2 AS round, n_minima <= 3 AS small FROM nodes", "li_small", "window_id node next_overlap", "few between_ends round small", recursive=True)
def node_filters(spark, sf_dir):
    """The filters by one slice's overlap, by the ends, by Euler characteristic and by minima, as marks on every node."""
    marks = {"few": F.col("next_overlap").between(1, 2), "between_ends": window_tree.within_ends(1), "round": query.chi_between(0, 2), "small": query.at_most_minima(3)}
    return _nodes(spark, sf_dir).withColumns(marks).select("window_id", "node", "next_overlap", *marks)


@job(f"{_NODE_SQL}\n---\nSELECT window_id, sum(abs(1 - left_overlap)) AS left_violations, sum(abs(1 - right_overlap)) AS right_violations, count(*) AS n FROM nodes GROUP BY window_id", "li_small", "window_id left_violations right_violations n", recursive=True)
def induced_map_report(spark, sf_dir):
    """How far the maps from the end slices' trees into the window's tree are from one to one, over the edges below the cut."""
    off = lambda c: F.sum(F.abs(1 - F.col(c)))
    return _nodes(spark, sf_dir).groupBy("window_id").agg(off("left_overlap").alias("left_violations"), off("right_overlap").alias("right_violations"), F.count("*").alias("n"))


@job(f"{_WINDOW_SQL}\n---\nSELECT window_id, node, n_minima FROM comp WHERE n_minima <= 2 AND node // 64 > window_id * {STEP} AND node // 64 < window_id * {STEP} + {LENGTH - 1}", "li_small", "window_id node n_minima", recursive=True)
def small_interior_contours(spark, sf_dir):
    """Components of few minima whose last cell lies strictly inside their window."""
    return _components(spark, sf_dir).where(query.at_most_minima(2)).where(query.in_interior(LENGTH, STEP, LI_SMALL.slice)).select("window_id", "node", "n_minima")


@job(f"{_WINDOW_SQL}\n---\nSELECT a.window_id, a.node AS node, b.node AS next_node, count(*) AS shared FROM name a JOIN name b ON b.window_id = a.window_id + 1 AND b.c = a.c GROUP BY ALL", "li_small", "window_id node next_node shared", recursive=True)
def chained_windows(spark, sf_dir):
    """Components of consecutive windows that share cells."""
    from ..operators.flood import labelled_windows

    cells = labelled_windows(order.ranked(grids.shipped_small(spark, sf_dir)), CUT, LENGTH, STEP, LI_SMALL.nz)
    after = cells.select((F.col("window_id") - 1).alias("window_id"), "id", F.col("node").alias("next_node"))
    return cells.join(after, ["window_id", "id"]).groupBy("window_id", "node", "next_node").agg(F.count("*").alias("shared"))
