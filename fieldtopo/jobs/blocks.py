"""Jobs over a family of grids whose number grows with the tables: every step runs by grid, so more rows mean more groups, not larger ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import whole_grids
from ..sources import grids
from ..sources.grids import BLOCK
from .common import NEIGHBOURS_26, RING_TEST, job

LEVEL = 20
_ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY val, id) - 1 AS ord FROM g)"
_AROUND = "FROM o a CROSS JOIN {off} off LEFT JOIN o b ON b.grid_id = a.grid_id AND b.x = a.x + off.dx AND b.y = a.y + off.dy AND b.z = a.z + {dz}"


@job(f"{_ORDERED}, {NEIGHBOURS_26}, m2 AS (SELECT a.grid_id, a.id, coalesce(bit_or(CASE WHEN b.ord < a.ord THEN CAST(1 << CAST(off.bit AS INT) AS BIGINT) ELSE 0 END), 0) AS mask "
     + _AROUND.format(off="(SELECT dx, dy, row_number() OVER (ORDER BY dy, dx) - 1 AS bit FROM off WHERE dz = 0)", dz="0") + f" GROUP BY a.grid_id, a.id), {RING_TEST}\n---\nSELECT grid_id, count(*) FILTER (transitions <> 2) AS n_critical, count(*) FILTER (m2.mask = 0) AS n_minima, count(*) AS n FROM m2 JOIN test2 USING (mask) GROUP BY grid_id", "blocks", "grid_id n_critical n_minima n")
def block_criticals(spark, sf_dir):
    """Cells of every grid that are critical in their slice, and slice minima."""
    return whole_grids.summarised(grids.sparse_blocks(spark, sf_dir), BLOCK, whole_grids.slice_criticals)


@job(f"{_ORDERED}, {NEIGHBOURS_26}, m3 AS (SELECT a.grid_id, a.id, coalesce(bit_or(CASE WHEN b.ord < a.ord THEN CAST(1 AS BIGINT) << CAST(off.bit AS INT) ELSE 0 END), 0) AS mask "
     + _AROUND.format(off="", dz="off.dz").replace("CROSS JOIN  off", "CROSS JOIN off") + """ GROUP BY a.grid_id, a.id), masks AS (SELECT DISTINCT mask FROM m3),
marked AS (SELECT mask, dx, dy, dz FROM masks, off WHERE (mask >> CAST(bit AS INT)) & 1 = 1),
closure AS (SELECT DISTINCT m.mask, o2.dx, o2.dy, o2.dz FROM marked m JOIN off o2 ON (m.dx = 0 OR m.dx = o2.dx) AND (m.dy = 0 OR m.dy = o2.dy) AND (m.dz = 0 OR m.dz = o2.dz)),
e AS (SELECT mask, sum(CASE WHEN abs(dx) + abs(dy) + abs(dz) = 2 THEN -1 ELSE 1 END) AS chi FROM closure GROUP BY mask)
---
SELECT grid_id, sum(1 - coalesce(chi, 0)) AS chi, count(*) FILTER (mask = 0) AS n_minima FROM m3 LEFT JOIN e USING (mask) GROUP BY grid_id""", "blocks", "grid_id chi n_minima")
def block_euler(spark, sf_dir):
    """The Euler characteristic of every grid, summed from its cells' lower links, and its minima."""
    return whole_grids.summarised(grids.sparse_blocks(spark, sf_dir), BLOCK, whole_grids.link_euler)


@job("\n---\nSELECT grid_id, x // 4 AS x, y // 4 AS y, z // 4 AS z, min(val) AS lo, max(val) AS hi, sum(val) AS total FROM g GROUP BY ALL", "blocks", "grid_id x y z lo hi total")
def block_pyramid(spark, sf_dir):
    """Extremes and sums of 4 x 4 x 4 blocks of every grid."""
    part = [F.floor(F.col(a) / 4).alias(a) for a in "xyz"]
    return grids.shipped_blocks(spark, sf_dir).groupBy("grid_id", *part).agg(F.min("val").alias("lo"), F.max("val").alias("hi"), F.sum("val").alias("total"))


@job(f"m AS (SELECT *, val < {LEVEL} AS inside FROM g), c AS (SELECT *, coalesce(inside <> lag(inside) OVER (PARTITION BY grid_id, z, y ORDER BY x), true) AS starts FROM m)\n---\nSELECT grid_id, count(*) FILTER (starts) AS runs, count(*) FILTER (inside) AS cells FROM c GROUP BY grid_id", "blocks", "grid_id runs cells")
def block_runs(spark, sf_dir):
    """Runs of equal sign along the scan lines of every grid, and the cells inside."""
    inside = F.col("val") < LEVEL
    before = F.lag(inside).over(Window.partitionBy("grid_id", "z", "y").orderBy("x"))
    cells = grids.shipped_blocks(spark, sf_dir).select("grid_id", inside.alias("inside"), F.coalesce(inside != before, F.lit(True)).alias("starts"))
    return cells.groupBy("grid_id").agg(F.count_if("starts").alias("runs"), F.count_if("inside").alias("cells"))
