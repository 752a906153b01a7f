"""Jobs that resample, reshape and summarise grids: halving, rotations, padding, run lengths and the octree pyramid."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pyramid
from ..sources import grids
from ..sources.grids import LI, LI_4D, address
from .common import job

ISO = 70


def _half(*axes):
    return [F.floor(F.col(a) / 2).cast("long").alias(a) for a in axes]


@job("\n---\nSELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, sum(val) // 8 AS mean, sum(val) AS total FROM g GROUP BY ALL", "li", "x y z mean total")
def half_volume(spark, sf_dir):
    """Blocks of 2x2x2 cells to one."""
    return grids.shipped(spark, sf_dir).groupBy(*_half("x", "y", "z")).agg(F.floor(F.sum("val") / 8).alias("mean"), F.sum("val").alias("total"))


@job("\n---\nSELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, sum(val * CASE WHEN x % 2 = 0 AND y % 2 = 1 AND z % 2 = 0 THEN 2 WHEN x % 2 = 0 AND y % 2 = 0 AND z % 2 = 1 THEN 0 ELSE 1 END) // 8 AS mean FROM g GROUP BY ALL", "li", "x y z mean")
def half_volume_as_written(spark, sf_dir):
    """The same with the weights that the original tool really applies: one corner twice, another never."""
    even = lambda a: F.col(a) % 2 == 0
    weight = F.when(even("x") & ~even("y") & even("z"), 2).when(even("x") & even("y") & ~even("z"), 0).otherwise(1)
    return grids.shipped(spark, sf_dir).groupBy(*_half("x", "y", "z")).agg(F.floor(F.sum(F.col("val") * weight) / 8).alias("mean"))


@job("\n---\nSELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, t // 2 AS t, sum(val) // 16 AS mean FROM g WHERE t < 6 GROUP BY ALL", "li_4d", "x y z t mean")
def half_4d(spark, sf_dir):
    return grids.shipped_4d(spark, sf_dir).where("t < 6").groupBy(*_half("x", "y", "z", "t")).agg(F.floor(F.sum("val") / 16).alias("mean"))


@job("\n---\nSELECT x, y, z, t // 2 AS t, sum(val) // 2 AS mean FROM g WHERE t < 6 GROUP BY x, y, z, t // 2", "li_4d", "x y z t mean")
def half_4d_time(spark, sf_dir):
    """Two steps averaged."""
    return grids.shipped_4d(spark, sf_dir).where("t < 6").groupBy("x", "y", "z", *_half("t")).agg(F.floor(F.sum("val") / 2).alias("mean"))


@job("\n---\nSELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, t - 2 AS t, sum(val) // 8 AS mean FROM g WHERE t BETWEEN 2 AND 4 GROUP BY ALL", "li_4d", "x y z t mean")
def half_4d_middle(spark, sf_dir):
    """The middle steps, halved in space."""
    return grids.shipped_4d(spark, sf_dir).where("t BETWEEN 2 AND 4").groupBy(*_half("x", "y", "z"), (F.col("t") - 2).alias("t")).agg(F.floor(F.sum("val") / 8).alias("mean"))


@job("\n---\nSELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, t // 2 AS t, sum(val) // 8 AS mean FROM g WHERE t % 2 = 0 GROUP BY x // 2, y // 2, z // 2, t // 2", "li_4d", "x y z t mean")
def half_4d_every_other(spark, sf_dir):
    """Every other step, halved in space."""
    return grids.shipped_4d(spark, sf_dir).where("t % 2 = 0").groupBy(*_half("x", "y", "z", "t")).agg(F.floor(F.sum("val") / 8).alias("mean"))


@job(f"\n---\nSELECT (x - 1) // 2 AS x, (y - 1) // 2 AS y, (z - 1) // 2 AS z, sum(CASE WHEN val = {ISO} THEN 1 ELSE 10 END * CASE WHEN val >= {ISO} THEN 1 ELSE -1 END) AS vote, sum(CASE WHEN val = {ISO} THEN 1 ELSE 10 END * CASE WHEN val >= {ISO} THEN 1 ELSE -1 END) >= 0 AS positive, bool_or(val <> {ISO}) AS known FROM g WHERE x >= 1 AND y >= 1 AND z >= 1 GROUP BY (x - 1) // 2, (y - 1) // 2, (z - 1) // 2", "li", "x y z vote", "positive known")
def half_two_bit(spark, sf_dir):
    """Signs halved by vote: a known sign (a value off the isovalue) counts ten, an unknown one one; windows start at cell 1. Windows
    that end beyond the grid count the cells they have."""
    sign, known = F.when(F.col("val") >= ISO, 1).otherwise(-1), F.col("val") != ISO
    windows = [F.floor((F.col(a) - 1) / 2).alias(a) for a in "xyz"]
    votes = grids.shipped(spark, sf_dir).where("x >= 1 AND y >= 1 AND z >= 1").groupBy(*windows).agg(F.sum(F.when(known, 10).otherwise(1) * sign).alias("vote"), F.bool_or(known).alias("known"))
    return votes.select("x", "y", "z", "vote", (F.col("vote") >= 0).alias("positive"), "known")


@job("\n---\nSELECT x * 2 + dx AS x, y * 2 + dy AS y, z * 2 + dz AS z, val FROM g, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dz)", "li_4d", "x y z val")
def double_4d_slices(spark, sf_dir):
    """Each cell as 2x2x2 (nearest), all steps."""
    two = lambda a: F.explode(F.array((F.col(a) * 2).cast("long"), (F.col(a) * 2 + 1).cast("long"))).alias(a)
    out = grids.shipped_4d(spark, sf_dir)
    for a in "xyz":
        out = out.select(*[c for c in ("x", "y", "z", "val") if c != a], two(a))
    return out.select("x", "y", "z", "val")


@job("\n---\nSELECT (o.z * 84 + o.y) * 16 + o.x AS turned, o.x, o.y, o.z, g.val FROM (SELECT unnest(range(16)) AS x) ox CROSS JOIN (SELECT unnest(range(84)) AS y) oy CROSS JOIN (SELECT unnest(range(16)) AS z) oz CROSS JOIN LATERAL (SELECT ox.x AS x, oy.y AS y, oz.z AS z) o JOIN g ON g.x = o.z AND g.y = o.x AND g.z = o.y", "li", "turned x y z val")
def rotate_axes(spark, sf_dir):
    """The cyclic turn out(x, y, z) = in(z, x, y): new x is old y, new y old z, new z old x; addressed by the turned sizes."""
    turned = grids.Dims(LI.ny, LI.nz, LI.nx)
    moved = grids.shipped(spark, sf_dir).select(F.col("y").alias("x"), F.col("z").alias("y"), F.col("x").alias("z"), "val")
    return moved.select(address(turned).alias("turned"), "x", "y", "z", "val")


@job("\n---\nSELECT i AS id, coalesce(g.val, 1000000000) AS val FROM range(20 * 20 * 88) r(i) LEFT JOIN g ON g.x = i % 20 - 2 AND g.y = (i // 20) % 20 - 2 AND g.z = i // 400 - 2", "li", "id val")
def pad_volume(spark, sf_dir):
    """Two cells of wall all around."""
    wide = grids.Dims(LI.nx + 4, LI.ny + 4, LI.nz + 4)
    inner = grids.shipped(spark, sf_dir).select(address(wide, F.col("x") + 2, F.col("y") + 2, F.col("z") + 2).alias("id"), "val")
    return spark.range(wide.n).join(inner, "id", "left").select("id", F.coalesce("val", F.lit(1_000_000_000)).alias("val"))


@job("\n---\nSELECT x, y, t AS z, val FROM g WHERE z = 0", "li_4d", "x y z val")
def project_4d(spark, sf_dir):
    """Time becomes depth."""
    return grids.shipped_4d(spark, sf_dir).where("z = 0").select("x", "y", F.col("t").alias("z"), "val")


@job("\n---\nSELECT t * 216 + z * 36 + y * 6 + x AS id, t, val FROM g", "li_4d", "id t val")
def stack_4d(spark, sf_dir):
    """Volumes of single steps stacked to a series."""
    series = grids.shipped_4d(spark, sf_dir)
    return series.select(address(LI_4D, t="t").alias("id"), "t", "val")


_RUNS = f"""m AS (SELECT *, val < {ISO} AS inside FROM g), c AS (SELECT *, coalesce(inside <> lag(inside) OVER w, true) AS starts FROM m WINDOW w AS (PARTITION BY z, y ORDER BY x)),
k AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY z, y ORDER BY x) AS run FROM c), runs AS (SELECT z, y, run, min(x) AS start, count(*) AS len, bool_or(inside) AS inside FROM k GROUP BY z, y, run)"""


def _runs(spark, sf_dir):
    w = Window.partitionBy("z", "y").orderBy("x")
    m = grids.shipped(spark, sf_dir).withColumn("inside", F.col("val") < ISO)
    starts = F.coalesce(F.col("inside") != F.lag("inside").over(w), F.lit(True)).cast("int")
    numbered = m.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w))
    return numbered.groupBy("z", "y", "run").agg(F.min("x").alias("start"), F.count("*").alias("len"), F.bool_or("inside").alias("inside"))


@job(f"{_RUNS}\n---\nSELECT z, y, start, len, inside FROM runs", "li", "z y start len", "inside")
def compress_runs(spark, sf_dir):
    """Scan lines as runs of equal sign."""
    return _runs(spark, sf_dir).select("z", "y", "start", "len", "inside")


@job(f"{_RUNS}\n---\nSELECT z, sum(n) AS runs, max(n) AS most, max(longest) AS longest FROM (SELECT z, y, count(*) AS n, max(len) AS longest FROM runs GROUP BY z, y) GROUP BY z", "li", "z runs most longest")
def run_statistics(spark, sf_dir):
    lines = _runs(spark, sf_dir).groupBy("z", "y").agg(F.count("*").alias("n"), F.max("len").alias("longest"))
    return lines.groupBy("z").agg(F.sum("n").alias("runs"), F.max("n").alias("most"), F.max("longest").alias("longest"))


@job(f"\n---\nSELECT id, val < {ISO} AS inside FROM g", "li", "id", "inside")
def expand_runs(spark, sf_dir):
    """The dense grid again from its runs."""
    xs = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("x")
    return _runs(spark, sf_dir).select("z", "y", "inside", xs).select(address(LI).alias("id"), "inside")


_LEVELS = f"""l0 AS (SELECT 0 AS level, x AS ix, y AS iy, z AS iz, val - {ISO} AS lo, val - {ISO} AS hi, (x + y + z) % 5 = 0 AS unknown FROM g),
""" + ",\n".join(f"l{k} AS (SELECT {k} AS level, ix // 2 AS ix, iy // 2 AS iy, iz // 2 AS iz, min(lo) AS lo, max(hi) AS hi, bool_and(unknown) AS unknown FROM l{k - 1} GROUP BY ix // 2, iy // 2, iz // 2)" for k in range(1, 8)) + """,
pyr AS (""" + " UNION ALL ".join(f"SELECT *, CASE WHEN hi < 0 THEN hi WHEN lo > 0 THEN lo ELSE 0 END AS f FROM l{k}" for k in range(8)) + ")"


def _pyramid(spark, sf_dir):
    cells = grids.shipped(spark, sf_dir)
    finest = cells.select(F.col("x").alias("ix"), F.col("y").alias("iy"), F.col("z").alias("iz"), (F.col("val") - ISO).alias("f"), ((F.col("x") + F.col("y") + F.col("z")) % 5 == 0).alias("unknown"))
    return pyramid.build(finest, 7)


@job(f"{_LEVELS}\n---\nSELECT level, ix, iy, iz, f, unknown FROM pyr", "li", "level ix iy iz f", "unknown")
def octree_pyramid(spark, sf_dir):
    """All levels of the octree: negative children give the largest, positive ones the least value, mixed ones 0."""
    return _pyramid(spark, sf_dir).select("level", "ix", "iy", "iz", "f", "unknown")


@job(f"{_LEVELS}\n---\nSELECT level, count(*) AS n, count(*) FILTER (f = 0) AS mixed, count(*) FILTER (unknown) AS unknowns FROM pyr GROUP BY level", "li", "level n mixed unknowns")
def octree_levels(spark, sf_dir):
    """Nodes, mixed and unknown nodes of each level."""
    return _pyramid(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("f") == 0).alias("mixed"), F.count_if("unknown").alias("unknowns"))


@job(f"""{_LEVELS}, whole AS (SELECT level, ix, iy, iz FROM pyr WHERE f <> 0)
---
SELECT g.id, coalesce(max(w.level), 0) AS level FROM g LEFT JOIN whole w ON w.ix = g.x >> w.level AND w.iy = g.y >> w.level AND w.iz = g.z >> w.level GROUP BY g.id""", "li", "id level")
def merged_leaf_level(spark, sf_dir):
    """The coarsest unmixed octree cell that covers each grid cell."""
    cells, tree = grids.shipped(spark, sf_dir), _pyramid(spark, sf_dir)
    return pyramid.coarsest_cover(cells, tree.where("f <> 0"), 7).select("id", "level")


@job(f"""{_LEVELS}, d AS (SELECT level, ix, iy, iz, unnest([0,1,2,3,4,5,6,7]) AS child FROM pyr WHERE level = 3 AND f = 0)
---
SELECT ix * 2 + child % 2 AS ix, iy * 2 + (child // 2) % 2 AS iy, iz * 2 + child // 4 AS iz, child FROM d""", "li", "ix iy iz child")
def refine_level(spark, sf_dir):
    """The mixed cells of a level split into their eight children."""
    mixed = _pyramid(spark, sf_dir).where("level = 3 AND f = 0")
    return pyramid.children(mixed).select("ix", "iy", "iz", "child")
