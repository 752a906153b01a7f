"""Jobs over trees of bricks: contour trees of volumes, slices and pairs, induced-map labels, and trees of the grids that grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.masks import OFFSETS_6, OFFSETS_26
from ..operators import bricks, contour_tree, order, query, trees, whole_grids
from ..sources import grids
from ..sources.grids import BLOCK, EVENTS, LI, LI_SMALL
from .common import STRICT_TEST, VOLUME_MASK, job
from .relations import _BOTH, _PAIRS, _SPLIT, _VERTEX, _tree_sql

SIDE = 4  # of the bricks of small grids; volumes take bricks.SIDE


def volume_trees(cells, dims, keys=(), side=bricks.SIDE):
    """(keys, node, join_up, split_down) of volumes whose cells have `ord` (rising) and `rev` (falling)."""
    up = bricks.tree(cells, dims, OFFSETS_26, keys, side).withColumnRenamed("upper", "join_up")
    falling = cells.drop("ord").withColumnRenamed("rev", "ord")
    down = bricks.tree(falling, dims, OFFSETS_6, keys, side).withColumnRenamed("upper", "split_down")
    return up.join(down, [*keys, "node"])


def _small(spark, sf_dir):
    return order.ranked(grids.shipped_small(spark, sf_dir)).withColumn("rev", F.lit(LI_SMALL.n - 1) - F.col("ord"))


@job()
def contour_tree_edges(spark, sf_dir):
    """Edges of the augmented contour tree of a volume, from the join and split trees of its bricks."""
    return contour_tree.contour_edges(volume_trees(_small(spark, sf_dir), LI_SMALL, side=SIDE), [])


@job()
def large_contour_tree(spark, sf_dir):
    """The same for the large grid, without its regular nodes: cells with other than one edge up and one down."""
    cells = order.ranked(grids.shipped(spark, sf_dir)).withColumn("rev", F.lit(LI.n - 1) - F.col("ord"))
    edges = contour_tree.contour_edges(volume_trees(cells, LI, side=16), [])
    ups = edges.groupBy(F.col("lower").alias("node")).agg(F.count("*").alias("up"))
    downs = edges.groupBy(F.col("upper").alias("node")).agg(F.count("*").alias("down"))
    return ups.join(downs, "node", "full").fillna(0).where("up <> 1 OR down <> 1").select("node", "up", "down")


@job(f"{_BOTH},\n{_SPLIT},\nj AS (SELECT upper AS node, count(*) AS down FROM jtree WHERE upper IS NOT NULL GROUP BY upper), s AS (SELECT upper AS node, count(*) AS up FROM tree WHERE upper IS NOT NULL GROUP BY upper)\n---\nSELECT g.id AS node, coalesce(s.up, 0) AS up, coalesce(j.down, 0) AS down FROM g LEFT JOIN j ON j.node = g.id LEFT JOIN s ON s.node = g.id", "li_small", "node up down", recursive=True)
def contour_edge_degrees(spark, sf_dir):
    """Degrees of the contour tree's nodes, counted from its edges: they are those of the join tree below and of the split tree above."""
    edges = contour_tree_edges(spark, sf_dir)
    count = lambda end, name: edges.groupBy(F.col(end).alias("node")).agg(F.count("*").alias(name))
    return count("lower", "up").join(count("upper", "down"), "node", "full").select("node", F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("down", F.lit(0)).alias("down"))


def _slices(spark, sf_dir):
    return order.ranked_within(grids.activity(spark, sf_dir), ["z"])


def _pairs(spark, sf_dir):
    cells = grids.activity(spark, sf_dir).withColumn("pair", F.explode(F.array(F.col("z") - 1, F.col("z")))).where(F.col("pair").between(0, EVENTS.nz - 2))
    return order.ranked_within(cells, ["pair"])


@job()
def slice_contour_trees(spark, sf_dir):
    """Edges of every slice's contour tree."""
    flat = lambda offsets: [o for o in offsets if o[2] == 0]
    return contour_tree.group_edges(_slices(spark, sf_dir), ["z"], flat(OFFSETS_26), flat(OFFSETS_6))


@job()
def pair_contour_trees(spark, sf_dir):
    """Edges of the contour tree of every pair of slices, labelled with the induced maps of the left and the right slice's contour trees."""
    edges, flat = contour_tree.group_edges(_pairs(spark, sf_dir), ["pair"]), slice_contour_trees(spark, sf_dir)
    left = contour_tree.induced_labels(edges, flat.select(F.col("z").alias("pair"), "lower", "upper"), ["pair"]).withColumnRenamed("label", "left_label")
    right = contour_tree.induced_labels(edges, flat.select((F.col("z") - 1).alias("pair"), "lower", "upper"), ["pair"]).withColumnRenamed("label", "right_label")
    return left.join(right, ["pair", "lower", "upper"])


_FLAT = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.z = b.z"
_LABELS = f"""{_tree_sql("pair", _PAIRS, "val, node", _VERTEX)},
{_tree_sql("z", "(SELECT *, id AS node FROM g)", "val, id", _FLAT, "f")},
part AS (SELECT 'left' AS side, z AS pair, node, upper FROM ftree WHERE z < 29 UNION ALL SELECT 'right', z - 1, node, upper FROM ftree WHERE z > 0),
delta AS (SELECT side, pair, node, sum(d) AS d FROM (SELECT side, pair, node, 1 AS d FROM part WHERE upper IS NOT NULL UNION ALL SELECT side, pair, upper, -1 FROM part WHERE upper IS NOT NULL) GROUP BY ALL),
anc(pair, node, a) AS (SELECT pair, node, node FROM tree UNION SELECT n.pair, n.node, t.upper FROM anc n JOIN tree t ON t.pair = n.pair AND t.node = n.a WHERE t.upper IS NOT NULL),
lab AS (SELECT n.pair, n.a AS node, sum(d.d) FILTER (d.side = 'left') AS l, sum(d.d) FILTER (d.side = 'right') AS r FROM anc n LEFT JOIN delta d ON d.pair = n.pair AND d.node + n.pair * 10000 = n.node GROUP BY ALL),
edges AS (SELECT t.pair, t.node - t.pair * 10000 AS node, t.upper - t.pair * 10000 AS upper, u.val - t.val AS weight, coalesce(l, 0) AS left_label, coalesce(r, 0) AS right_label, t.val
  FROM tree t JOIN lab ON lab.pair = t.pair AND lab.node = t.node JOIN tree u ON u.pair = t.pair AND u.node = t.upper)"""


def _pair_labels(spark, sf_dir):
    """(pair, node, upper, weight, left_label, right_label) of the pairs' join trees: sums over subtrees of the slices' degrees."""
    cells, flat = _pairs(spark, sf_dir), trees.sweep_tree(_slices(spark, sf_dir), ["z"], [o for o in OFFSETS_26 if o[2] == 0])
    tree, steps = trees.sweep_tree(cells, ["pair"]), flat.where("upper IS NOT NULL")

    def delta(pair, name):
        ends = steps.select(pair.alias("pair"), F.explode(F.array(F.struct(F.col("node").alias("node"), F.lit(1).alias("d")), F.struct(F.col("upper").alias("node"), F.lit(-1).alias("d")))).alias("e"))
        return ends.groupBy("pair", "e.node").agg(F.sum("e.d").alias(name))

    terms = tree.join(delta(F.col("z"), "left_label"), ["pair", "node"], "left").join(delta(F.col("z") - 1, "right_label"), ["pair", "node"], "left").fillna(0, ["left_label", "right_label"])
    sums = trees.subtree_sums(terms, ["pair"], ["left_label", "right_label"])
    val = cells.select("pair", F.col("id").alias("node"), "val")
    edges = tree.where("upper IS NOT NULL").join(sums, ["pair", "node"]).join(val, ["pair", "node"])
    return edges.join(val.withColumnsRenamed({"node": "upper", "val": "top"}), ["pair", "upper"]).select("pair", "node", "upper", (F.col("top") - F.col("val")).alias("weight"), "left_label", "right_label")


@job(f"{_LABELS}\n---\nSELECT pair, node, upper, left_label, right_label FROM edges", "events", "pair node upper left_label right_label", recursive=True)
def induced_labels(spark, sf_dir):
    """Edges of every pair's join tree with the labels that the maps of its slices' join trees induce: how many of a slice's components
    the component below the edge takes in."""
    return _pair_labels(spark, sf_dir).drop("weight")


@job(f"{_LABELS}\n---\nSELECT pair, count(*) AS n, sum(abs(1 - left_label)) AS left_off, sum(weight * abs(1 - left_label)) AS left_weighted, sum(abs(1 - right_label)) AS right_off, sum(weight * abs(1 - right_label)) AS right_weighted FROM edges GROUP BY pair", "events", "pair n left_off left_weighted right_off right_weighted", recursive=True)
def weighted_map_report(spark, sf_dir):
    """How far each pair's induced maps are from one to one: |1 - label| over the edges, plain and weighted by the step in value."""
    off = lambda c: F.abs(1 - F.col(c))
    sums = {f"{s}_{k}": F.sum(off(f"{s}_label") * w) for s in ("left", "right") for k, w in (("off", F.lit(1)), ("weighted", F.col("weight")))}
    return _pair_labels(spark, sf_dir).groupBy("pair").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])


@job()
def block_tree_classes(spark, sf_dir):
    """Nodes of the join and split trees of every one of the grids whose number grows with the tables, by degree."""
    return whole_grids.summarised(grids.sparse_blocks(spark, sf_dir), BLOCK, whole_grids.tree_classes)


@job(f"{VOLUME_MASK},\n{STRICT_TEST.format(source='m3')}\n---\nSELECT m3.z, count(*) FILTER (critical) AS n_critical, count(*) AS n FROM m3 JOIN test3 USING (mask) GROUP BY m3.z", "li_small", "z n_critical n", recursive=True)
def criticals_by_table(spark, sf_dir):
    """Critical cells of each slice by one bit of the table of all 2^26 masks."""
    cells = query.link_terms(order.ranked(grids.shipped_small(spark, sf_dir)))
    tested = cells.select("z", arrays.strict_by_table(spark, F.col("mask")).alias("critical"))
    return tested.groupBy("z").agg(F.count_if("critical").alias("n_critical"), F.count("*").alias("n"))


@job(f"{VOLUME_MASK},\n{STRICT_TEST.format(source='m3')}\n---\nSELECT count(DISTINCT mask) AS n_masks, count(DISTINCT mask) FILTER (critical) AS n_critical, bit_xor(mask) FILTER (critical) AS folded FROM (SELECT DISTINCT m3.mask, critical FROM m3 JOIN test3 USING (mask))", "li_small", "n_masks n_critical folded", recursive=True)
def mask_classes(spark, sf_dir):
    """The distinct 26-bit cases of a volume, how many of them change topology, and these cases folded to one number."""
    masks = query.link_terms(order.ranked(grids.shipped_small(spark, sf_dir))).select("mask").distinct()
    tested = masks.withColumn("critical", arrays.strict(F.col("mask")))
    return tested.agg(F.count("*").alias("n_masks"), F.count_if("critical").alias("n_critical"), F.bit_xor(F.when(F.col("critical"), F.col("mask"))).alias("folded"))
