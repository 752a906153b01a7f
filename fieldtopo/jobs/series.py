"""Jobs over series of volumes: 80-neighbour links, the 4-D topology tests, and counts by volume, step and pair of steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import order, stencil
from ..sources import grids
from ..sources.grids import LI_4D
from .common import ORDERED, job

# Offsets with time, the lower links as rows of marked places, and the tests by closure and reach over them. Variants of a mask (v):
# 0 as it is; 1, 2 left of a pair (step before out, in); 3, 4 right of a pair; 5, 6 off-plane neighbours out, in.
_AXIS = "(SELECT unnest([-1, 0, 1]) AS d{})"
_LINKS = f"""{ORDERED}, off AS (SELECT dx, dy, dz, dt, row_number() OVER (ORDER BY dt, dz, dy, dx) - 1 AS bit FROM {" CROSS JOIN ".join(_AXIS.format(a) for a in "xyzt")} WHERE dx <> 0 OR dy <> 0 OR dz <> 0 OR dt <> 0),
link AS (SELECT a.id, off.dx, off.dy, off.dz, off.dt, off.bit FROM o a CROSS JOIN off JOIN o b ON b.x = a.x + off.dx AND b.y = a.y + off.dy AND b.z = a.z + off.dz AND b.t = a.t + off.dt WHERE b.ord < a.ord)"""
_D = "dx, dy, dz, dt"
_VARIANTS = {
    0: f"SELECT id, {_D} FROM link",
    1: f"SELECT id, {_D} FROM link WHERE dt >= 0",
    2: f"SELECT id, {_D} FROM link WHERE dt >= 0 UNION ALL SELECT id, {_D} FROM o, off WHERE dt = -1",
    3: f"SELECT id, {_D} FROM link WHERE dt = 0 UNION ALL SELECT id, dx, dy, dz, 1 FROM link WHERE dt = -1",
    4: f"SELECT id, {_D} FROM link WHERE dt = 0 UNION ALL SELECT id, dx, dy, dz, 1 FROM link WHERE dt = -1 UNION ALL SELECT id, {_D} FROM o, off WHERE dt = -1",
    5: f"SELECT id, {_D} FROM link WHERE dz = 0",
    6: f"SELECT id, {_D} FROM link WHERE dz = 0 UNION ALL SELECT id, {_D} FROM o, off WHERE dz <> 0",
}


def _tests(variants: list[int], step: bool = False) -> str:
    """test4(id, v, critical, chi) of the variants; v = 9 is the strict test of the own step, in three dimensions."""
    rows = [f"SELECT {v} AS v, * FROM ({_VARIANTS[v]})" for v in variants]
    if step:
        rows.append(f"SELECT 9, id, {_D} FROM link WHERE dt = 0")
    vs = ", ".join(f"({v})" for v in [*variants, *[9] * step])
    return f"""marked AS ({" UNION ALL ".join(rows)}),
vs AS (SELECT * FROM (VALUES {vs}) t(v)),
closure AS (SELECT DISTINCT m.v, m.id, q.bit FROM marked m JOIN off q ON (m.dx = 0 OR m.dx = q.dx) AND (m.dy = 0 OR m.dy = q.dy) AND (m.dz = 0 OR m.dz = q.dz) AND (m.dt = 0 OR m.dt = q.dt) AND (m.v <> 9 OR q.dt = 0)),
sides AS (SELECT vs.v, o.id, off.bit, c.bit IS NOT NULL AS inside, CASE WHEN ((dx = 0)::INT + (dy = 0)::INT + (dz = 0)::INT + (dt = 0)::INT) % 2 = 0 THEN 1 ELSE -1 END AS sign
  FROM o CROSS JOIN vs JOIN off ON vs.v <> 9 OR off.dt = 0 LEFT JOIN closure c ON c.v = vs.v AND c.id = o.id AND c.bit = off.bit),
steps AS (SELECT a.bit AS a, b.bit AS b FROM off a JOIN off b ON abs(a.dx - b.dx) + abs(a.dy - b.dy) + abs(a.dz - b.dz) + abs(a.dt - b.dt) = 1),
seeds AS (SELECT v, id, inside, min(bit) AS bit, count(*) AS n, sum(sign) AS chi FROM sides GROUP BY ALL),
reach(v, id, inside, bit) AS (SELECT v, id, inside, bit FROM seeds UNION SELECT r.v, r.id, r.inside, s.bit FROM reach r JOIN steps ON steps.a = r.bit JOIN sides s ON s.v = r.v AND s.id = r.id AND s.bit = steps.b AND s.inside = r.inside),
reached AS (SELECT v, id, inside, count(*) AS n FROM reach GROUP BY ALL),
test4 AS (SELECT vs.v, o.id, NOT (coalesce(a.n = ra.n, false) AND coalesce(b.n = rb.n, false) AND (vs.v = 9 OR coalesce(b.chi, 0) = 1)) AS critical, coalesce(a.chi, 0) AS chi FROM o CROSS JOIN vs
  LEFT JOIN seeds a ON a.v = vs.v AND a.id = o.id AND a.inside LEFT JOIN reached ra ON ra.v = vs.v AND ra.id = o.id AND ra.inside
  LEFT JOIN seeds b ON b.v = vs.v AND b.id = o.id AND NOT b.inside LEFT JOIN reached rb ON rb.v = vs.v AND rb.id = o.id AND NOT rb.inside)"""


def _links(spark, sf_dir):
    cells = stencil.block(order.ranked(grids.shipped_4d(spark, sf_dir)), "ord", axes="xyzt")
    lo, hi = stencil.lower_mask_4d("ord")
    return cells.select("id", "t", lo.alias("lo"), hi.alias("hi"))


_MASK = "sum(CASE WHEN bit {} THEN 1::BIGINT << CAST(bit {} AS INT) ELSE 0 END)"


@job(f"{_LINKS}\n---\nSELECT o.id, o.t, coalesce({_MASK.format('< 40', '')}, 0) AS lo, coalesce({_MASK.format('>= 40', '- 40')}, 0) AS hi FROM o LEFT JOIN link USING (id) GROUP BY o.id, o.t", "li_4d", "id t lo hi")
def lower_links_4d(spark, sf_dir):
    """The 80-bit lower link of every cell of a series, in two longs."""
    return _links(spark, sf_dir)


@job(f"{_LINKS}, {_tests([0, 5, 6], True)}\n---\nSELECT a.id, a.chi, a.critical AS whole, s.critical AS step, a.critical OR s.critical AS combo, p.critical OR q.critical AS plane FROM test4 a JOIN test4 s ON s.id = a.id AND s.v = 9 JOIN test4 p ON p.id = a.id AND p.v = 5 JOIN test4 q ON q.id = a.id AND q.v = 6 WHERE a.v = 0", "li_4d", "id chi", "whole step combo plane", recursive=True)
def series_critical(spark, sf_dir):
    """Of every cell of a series: the Euler characteristic of its closed lower link, and whether it is critical in 4-D, in its own
    step, in either, and as a cell of a series of planes."""
    lo, hi = F.col("lo"), F.col("hi")
    tests = {"chi": arrays.euler_4d(lo, hi), "whole": arrays.strict_4d(lo, hi), "step": arrays.strict_in_step(lo, hi), "plane": arrays.flat_in_z(arrays.strict_4d, lo, hi)}
    return _links(spark, sf_dir).withColumns(tests).select("id", "chi", "whole", "step", (F.col("whole") | F.col("step")).alias("combo"), "plane")


@job(f"{_LINKS}, {_tests([0], True)}\n---\nSELECT o.t, count(*) FILTER (a.critical) AS n_whole, count(*) FILTER (s.critical) AS n_step, count(*) AS n FROM o JOIN test4 a ON a.id = o.id AND a.v = 0 JOIN test4 s ON s.id = o.id AND s.v = 9 GROUP BY o.t", "li_4d", "t n_whole n_step n", recursive=True)
def criticals_in_series(spark, sf_dir):
    """Critical cells of a series by step: in 4-D, and in the step alone. Sums over steps are those of the series."""
    lo, hi = F.col("lo"), F.col("hi")
    tested = _links(spark, sf_dir).select("t", arrays.strict_4d(lo, hi).alias("whole"), arrays.strict_in_step(lo, hi).alias("step"))
    return tested.groupBy("t").agg(F.count_if("whole").alias("n_whole"), F.count_if("step").alias("n_step"), F.count("*").alias("n"))


@job(f"""{_LINKS}, {_tests([1, 2, 3, 4], True)}, each AS (SELECT id, bool_or(critical) FILTER (v IN (1, 2)) AS l, bool_or(critical) FILTER (v IN (3, 4)) AS r, bool_or(critical) FILTER (v = 9) AS s FROM test4 GROUP BY id)
---
SELECT p AS pair, count(*) FILTER (CASE WHEN o.t = p THEN l ELSE r END) AS n_critical, count(*) FILTER (l OR r OR s) AS n_augmented FROM each JOIN o USING (id) JOIN range({LI_4D.nt - 1}) q(p) ON o.t BETWEEN p AND p + 1 GROUP BY p""", "li_4d", "pair n_critical n_augmented", recursive=True)
def criticals_in_step_pairs(spark, sf_dir):
    """Critical cells of every pair of consecutive steps; augmented: also those critical in their step or in the pair on their other side."""
    lo, hi = F.col("lo"), F.col("hi")
    tested = _links(spark, sf_dir).select("t", arrays.thick_4d(lo, hi, False).alias("l"), arrays.thick_4d(lo, hi, True).alias("r"), arrays.strict_in_step(lo, hi).alias("s"))
    rows = tested.withColumn("pair", F.explode(F.array(F.col("t") - 1, F.col("t")))).where(F.col("pair").between(0, LI_4D.nt - 2))
    own = F.when(F.col("t") == F.col("pair"), F.col("l")).otherwise(F.col("r"))
    return rows.groupBy("pair").agg(F.count_if(own).alias("n_critical"), F.count_if(F.col("l") | F.col("r") | F.col("s")).alias("n_augmented"))
