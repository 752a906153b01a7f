"""Jobs over what is written for people and other programs: images of slices, faces of series, stacked steps, indented trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.masks import OFFSETS_6, OFFSETS_26
from ..operators import order, trees
from ..sources import grids, volumes
from ..sources.grids import EVENTS, LI, LI_4D
from .common import job
from .extras import _FLAT_SPLIT, _FLAT_SQL
from .shapes import _at
from .surface import ISO


@job("range_ AS (SELECT min(val) AS lo, greatest(max(val) - min(val), 1) AS span FROM g)\n---\nSELECT z, y, x, (val - lo) * 255 // span AS grey FROM g, range_", "li", "z y x grey")
def image_files(spark, sf_dir):
    """A grey image file of every slice, black at the volume's least value and white at its largest, written and read back: its pixels."""
    cells = grids.shipped(spark, sf_dir)
    span = cells.agg(F.min("val").alias("lo"), F.greatest(F.max("val") - F.min("val"), F.lit(1)).alias("span"))
    grey = F.floor((F.col("val") - F.col("lo")) * 255 / F.col("span"))
    root = _at(spark, "")
    volumes.write_images(cells.crossJoin(F.broadcast(span)).select("z", "y", "x", grey.alias("grey")), LI, root).write.format("noop").mode("overwrite").save()  # one row
    return volumes.read_images(spark, root)


_FACES_SQL = " UNION ALL ".join(f"SELECT a.t, a.id, {k} AS axis, a.val < {ISO} AS inside_first FROM g a JOIN g b ON b.t = a.t AND {' AND '.join(f'b.{o} = a.{o} + {int(o == c)}' for o in 'xyz')} WHERE (a.val < {ISO}) <> (b.val < {ISO})" for k, c in enumerate("xyz"))


@job(f"\n---\n{_FACES_SQL}", "li_4d", "t id axis", "inside_first")
def series_face_list(spark, sf_dir):
    """The faces between inside and outside of every step: the cell before a face, the face's axis, and whether that cell is the inner one."""
    inside = F.col("val") < ISO
    after = lambda a: F.lead(inside).over(Window.partitionBy(*[c for c in "xyzt" if c != a]).orderBy(a))
    sides = F.array(*[F.struct(F.lit(k).alias("axis"), F.col(f"after_{a}").alias("after")) for k, a in enumerate("xyz")])
    cells = grids.shipped_4d(spark, sf_dir).withColumns({f"after_{a}": after(a) for a in "xyz"}).select("t", "id", inside.alias("inside_first"), F.explode(sides).alias("s"))
    return cells.where(F.col("s.after") != F.col("inside_first")).select("t", "id", "s.axis", "inside_first")


@job("\n---\nSELECT t, id, val FROM g", "li_4d", "t id val")
def stacked_steps(spark, sf_dir):
    """Every step of the series written as a volume file of its own, the files stacked to a series again."""
    root = _at(spark, "")
    volumes.write_steps(grids.shipped_4d(spark, sf_dir), LI_4D, root, ".v4d").write.format("noop").mode("overwrite").save()
    return volumes.read_steps(spark, root, ".v4d").withColumn("val", F.col("val").cast("long"))


def _dump_sql(tree: str) -> str:
    return f"""way(z, node, depth, path) AS (SELECT z, node, 0, lpad(CAST(node AS VARCHAR), 6, '0') FROM {tree} WHERE upper IS NULL
  UNION SELECT t.z, t.node, w.depth + 1, w.path || '/' || lpad(CAST(t.node AS VARCHAR), 6, '0') FROM way w JOIN {tree} t ON t.z = w.z AND t.upper = w.node)"""


@job(f"{_FLAT_SQL}, {_dump_sql('jtree')}\n---\nSELECT z, row_number() OVER (PARTITION BY z ORDER BY path) - 1 AS line, depth, node FROM way", "events", "z line depth node", recursive=True)
def indented_join_trees(spark, sf_dir):
    """Every slice's join tree from its root down, a line for each node with its depth."""
    cells = order.ranked_within(grids.activity(spark, sf_dir), ["z"])
    return trees.indented(trees.sweep_tree(cells, ["z"], [o for o in OFFSETS_26 if o[2] == 0]), ["z"])


@job(f"{_FLAT_SPLIT}, {_dump_sql('tree')}\n---\nSELECT z, row_number() OVER (PARTITION BY z ORDER BY path) - 1 AS line, depth, node FROM way", "events", "z line depth node", recursive=True)
def indented_split_trees(spark, sf_dir):
    """Every slice's split tree from its root up, a line for each node with its depth."""
    cells = order.reversed_order(order.ranked_within(grids.activity(spark, sf_dir), ["z"]), EVENTS.slice)
    return trees.indented(trees.sweep_tree(cells, ["z"], [o for o in OFFSETS_6 if o[2] == 0]), ["z"])
