"""Jobs over scalar fields: addressing, values, neighbourhoods, orders and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.masks import OFFSETS_6, OFFSETS_26
from ..operators import order, stencil
from ..sources import grids
from ..sources.grids import EVENTS, LI, address
from .common import NEIGHBOURS_26, ORDERED, job

ISO = 70


@job("\n---\nSELECT id, x, y, z, val FROM g", "li", "id x y z val")
def grid_cells(spark, sf_dir):
    """The dense grid with its addresses."""
    return grids.shipped(spark, sf_dir).select("id", "x", "y", "z", "val")


@job("\n---\nSELECT id, x, y, z, t, val FROM g", "li_4d", "id x y z t val")
def grid_cells_4d(spark, sf_dir):
    return grids.shipped_4d(spark, sf_dir).select("id", "x", "y", "z", "t", "val")


@job("\n---\nSELECT id, x, y, z, val, ((z * 5 + y) * 12 + x) AS again FROM g", "events", "id x y z val again")
def address_round_trip(spark, sf_dir):
    """Coordinates of an id and the id of the coordinates."""
    return grids.activity(spark, sf_dir).withColumn("again", address(EVENTS))


@job("\n---\nSELECT t, sum(val) AS total, max(val) AS most, min(val) AS least FROM g GROUP BY t", "li_4d", "t total most least")
def time_slices(spark, sf_dir):
    """A 4-D grid seen step by step."""
    return grids.shipped_4d(spark, sf_dir).groupBy("t").agg(F.sum("val").alias("total"), F.max("val").alias("most"), F.min("val").alias("least"))


def _with_range(df):
    """df with the grid's least and largest value: one row of statistics, joined to all."""
    return df.crossJoin(F.broadcast(df.agg(F.min("val").alias("lo"), F.max("val").alias("hi"))))  # one row


@job("r AS (SELECT min(val) AS lo, max(val) AS hi FROM g)\n---\nSELECT id, CASE WHEN hi - lo >= 128 AND hi - lo < 65535 THEN floor(val - lo + 0.5) WHEN hi = lo THEN 0 ELSE floor(65535.0::DOUBLE * (val - lo) / (hi - lo) + 0.5) END AS level FROM g, r", "li", "id level")
def quantise_16(spark, sf_dir):
    """Values as 16-bit levels: shifted where the range fits, stretched otherwise."""
    span = F.col("hi") - F.col("lo")
    level = F.when((span >= 128) & (span < 65535), F.col("val") - F.col("lo")).when(span == 0, 0).otherwise(F.floor(65535.0 * (F.col("val") - F.col("lo")) / span + 0.5))
    return _with_range(grids.shipped(spark, sf_dir)).select("id", level.cast("long").alias("level"))


@job("r AS (SELECT min(val) AS lo, max(val) AS hi FROM g)\n---\nSELECT id, hi - lo AS span, floor((val - lo) * CASE WHEN hi - lo >= 128 AND hi - lo < 32767 THEN 1.0::DOUBLE ELSE 32767.0::DOUBLE / (hi - lo) END + 0.5) AS level FROM g, r", "li_4d", "id span level")
def quantise_15_4d(spark, sf_dir):
    """The scale of the 4-D engine: 1 where the range lies in [128, 32767), else 32767 / range."""
    span = F.col("hi") - F.col("lo")
    scale = F.when((span >= 128) & (span < 32767), F.lit(1.0)).otherwise(32767.0 / span)
    return _with_range(grids.shipped_4d(spark, sf_dir)).select("id", span.alias("span"), F.floor((F.col("val") - F.col("lo")) * scale + 0.5).alias("level"))


_FACES = "(CASE WHEN x = 0 THEN 1 ELSE 0 END + CASE WHEN x = 15 THEN 1 ELSE 0 END + CASE WHEN y = 0 THEN 1 ELSE 0 END + CASE WHEN y = 15 THEN 1 ELSE 0 END + CASE WHEN z = 0 THEN 1 ELSE 0 END + CASE WHEN z = 83 THEN 1 ELSE 0 END)"


@job(f"f AS (SELECT sum(val * {_FACES}) AS face_sum, sum({_FACES}) AS face_n, min(val) AS lo, max(val) AS hi FROM g)\n---\nSELECT face_sum, face_n, lo, hi, 2 * face_sum < face_n * (lo + hi) AS negate FROM f", "li", "face_sum face_n lo hi", "negate")
def should_negate(spark, sf_dir):
    """Whether the mean over the six border faces lies nearer to the least than to the largest value."""
    on = [F.col(a) == v for a, top in (("x", LI.nx), ("y", LI.ny), ("z", LI.nz)) for v in (0, top - 1)]
    faces = sum((c.cast("long") for c in on), F.lit(0).cast("long"))
    got = grids.shipped(spark, sf_dir).agg(F.sum(F.col("val") * faces).alias("face_sum"), F.sum(faces).alias("face_n"), F.min("val").alias("lo"), F.max("val").alias("hi"))
    return got.withColumn("negate", 2 * F.col("face_sum") < F.col("face_n") * (F.col("lo") + F.col("hi")))


@job("r AS (SELECT min(val) AS lo, max(val) AS hi FROM g)\n---\nSELECT id, hi + lo - val AS val FROM g, r", "li", "id val")
def negate_volume(spark, sf_dir):
    return _with_range(grids.shipped(spark, sf_dir)).select("id", (F.col("hi") + F.col("lo") - F.col("val")).alias("val"))


@job("r AS (SELECT min(val) AS lo, max(val) AS hi FROM g)\n---\nSELECT id, t, hi + lo - val AS val FROM g, r", "li_4d", "id t val")
def negate_volume_4d(spark, sf_dir):
    return _with_range(grids.shipped_4d(spark, sf_dir)).select("id", "t", (F.col("hi") + F.col("lo") - F.col("val")).alias("val"))


_SIGN = f"{NEIGHBOURS_26}, s AS (SELECT *, val - {ISO} AS f FROM g)"


@job(f"""{_SIGN}
---
SELECT a.id, max(CASE WHEN b.id IS NULL THEN CAST(a.f < 0 AS INT) ELSE CAST((b.f < 0) <> (a.f < 0) AS INT) END) = 1 AS on_surface
FROM s a CROSS JOIN off LEFT JOIN s b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.id""", "li", "id", "on_surface")
def on_isosurface(spark, sf_dir):
    """Cells with a neighbour of the other sign, or negative ones on the border."""
    cells = stencil.block(grids.shipped(spark, sf_dir).withColumn("f", F.col("val") - ISO), "f")
    differs = [F.coalesce((stencil.at(o) < 0) != (F.col("f") < 0), F.col("f") < 0) for o in OFFSETS_26]
    return cells.select("id", F.greatest(*[d.cast("int") for d in differs]).cast("boolean").alias("on_surface"))


@job("\n---\nSELECT id, CASE WHEN y + z < 20 THEN 0 ELSE val END AS val FROM g", "li", "id val")
def trim_half_space(spark, sf_dir):
    return grids.shipped(spark, sf_dir).select("id", F.when(F.col("y") + F.col("z") < 20, 0).otherwise(F.col("val")).alias("val"))


@job("\n---\nSELECT x, y, z - 10 AS z, CASE WHEN z IN (10, 37) THEN 1000000000 ELSE val END AS val FROM g WHERE z BETWEEN 10 AND 37", "li", "x y z val")
def crop_slices(spark, sf_dir):
    """28 slices cut out, the outer two forced to a wall."""
    cut = grids.shipped(spark, sf_dir).where(F.col("z").between(10, 37))
    return cut.select("x", "y", (F.col("z") - 10).alias("z"), F.when(F.col("z").isin(10, 37), 1_000_000_000).otherwise(F.col("val")).alias("val"))


@job("""p AS (SELECT a.x, a.y, a.z, a.val AS left_val, b.val AS right_val FROM g a JOIN g b ON b.x = a.x AND b.y = a.y AND b.z = (a.z + 12) % 84 WHERE a.val <> b.val),
n AS (SELECT count(*) AS differing FROM p)
---
SELECT x, y, z, left_val, right_val, differing FROM (SELECT *, row_number() OVER (ORDER BY z, y, x) AS r FROM p) , n WHERE r <= 100""", "li", "x y z left_val right_val differing")
def compare_volumes(spark, sf_dir):
    """The first 100 cells that differ between the grid and itself a year on, with the number of all (top-k report)."""
    a = grids.shipped(spark, sf_dir).select("x", "y", "z", F.col("val").alias("left_val"))
    b = grids.shipped(spark, sf_dir).select("x", "y", ((F.col("z") + LI.nz - 12) % LI.nz).cast("int").alias("z"), F.col("val").alias("right_val"))
    differ = a.join(b, ["x", "y", "z"], "full_outer").where(~F.col("left_val").eqNullSafe(F.col("right_val")))
    return differ.orderBy("z", "y", "x").limit(100).crossJoin(F.broadcast(differ.agg(F.count("*").alias("differing"))))  # one row


# Signed distances, doubled to stay whole; known where off the isovalue; carved where a face neighbour has the same sign.
_FLAGS = f"""s AS (SELECT *, 2 * (val - {ISO}) AS f, val <> {ISO} AS known FROM g),
c AS (SELECT a.id, a.x, a.y, a.z, a.f, a.known, coalesce(bool_or(b.val >= {ISO}) FILTER (a.f >= 0), false) OR coalesce(bool_or(b.val < {ISO}) FILTER (a.f < 0), false) AS carved FROM s a LEFT JOIN g b ON b.id IN (a.id - 1, a.id + 1, a.id - 16, a.id + 16, a.id - 256, a.id + 256) AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 GROUP BY a.id, a.x, a.y, a.z, a.f, a.known)"""


def _flags(spark, sf_dir):
    """id, x, y, z, f, known, carved."""
    cells = stencil.block(grids.shipped(spark, sf_dir).withColumn("f", 2 * (F.col("val") - ISO)), "f")
    same = [F.coalesce((stencil.at(o) < 0) == (F.col("f") < 0), F.lit(False)) for o in OFFSETS_6]
    return cells.select("id", "x", "y", "z", "f", (F.col("f") != 0).alias("known"), F.greatest(*[c.cast("int") for c in same]).cast("boolean").alias("carved"))


@job(f"""{_FLAGS}, v AS (SELECT CASE WHEN count(*) FILTER (f >= 0) > count(*) FILTER (f < 0) THEN -1 ELSE 1 END AS side FROM c WHERE NOT carved)
---
SELECT id, CASE WHEN NOT carved AND (CASE WHEN f >= 0 THEN 1 ELSE -1 END = side OR NOT known) THEN -side ELSE f END AS f FROM c, v""", "li", "id f")
def repair_by_vote(spark, sf_dir):
    """Cells that no carving reached: of those, the ones on the side that fewer are on, or unknown, go just to the other side (0.5, doubled 1)."""
    cells = _flags(spark, sf_dir)
    votes = cells.where("not carved").agg(F.count_if(F.col("f") >= 0).alias("positive"), F.count_if(F.col("f") < 0).alias("negative"))
    side = F.when(F.col("positive") > F.col("negative"), -1).otherwise(1)
    own = F.when(F.col("f") >= 0, 1).otherwise(-1)
    changed = ~F.col("carved") & ((own == side) | ~F.col("known"))
    return cells.crossJoin(F.broadcast(votes)).select("id", F.when(changed, -side).otherwise(F.col("f")).alias("f"))  # one row


@job(f"""{_FLAGS}, v AS (SELECT CASE WHEN count(*) FILTER (f > 0) > count(*) FILTER (f < 0) THEN -1 ELSE 1 END AS side FROM c WHERE NOT carved AND known)
---
SELECT id, CASE WHEN carved THEN sign(f) ELSE -side END AS f, NOT carved AND sign(f) = side AS changed FROM c, v""", "li", "id f", "changed")
def fix_uncarved(spark, sf_dir):
    """Signs with every uncarved cell set against the side that the fewer known ones of them are on, and which cells that changed."""
    cells = _flags(spark, sf_dir)
    votes = cells.where("not carved and known").agg(F.count_if(F.col("f") > 0).alias("positive"), F.count_if(F.col("f") < 0).alias("negative"))
    side = F.when(F.col("positive") > F.col("negative"), -1).otherwise(1)
    sign, open_ = F.signum("f").cast("int"), ~F.col("carved")
    return cells.crossJoin(F.broadcast(votes)).select("id", F.when(open_, -side).otherwise(sign).alias("f"), (open_ & (sign == side)).alias("changed"))  # one row


@job(f"""{_FLAGS}
---
SELECT id, CASE WHEN NOT carved AND f > 0 THEN -1 ELSE f END AS outside, CASE WHEN NOT carved AND f < 0 THEN 1 ELSE f END AS inside, CASE WHEN NOT carved AND f < 0 THEN 1 WHEN NOT carved AND f > 0 THEN -1 ELSE f END AS both_sides, CASE WHEN carved AND f < 0 THEN 1 ELSE f END AS carved_inside FROM c""", "li", "id outside inside both_sides carved_inside")
def fix_sides(spark, sf_dir):
    """The four repairs of octree volumes (0.5, doubled 1): uncarved positives, uncarved negatives, both, and carved negatives turned over."""
    f, open_ = F.col("f"), ~F.col("carved")
    turned = {"outside": F.when(open_ & (f > 0), -1), "inside": F.when(open_ & (f < 0), 1), "both_sides": F.when(open_ & (f < 0), 1).when(open_ & (f > 0), -1), "carved_inside": F.when(F.col("carved") & (f < 0), 1)}
    return _flags(spark, sf_dir).select("id", *[c.otherwise(f).alias(k) for k, c in turned.items()])


@job(f"""falls AS (SELECT id, val < {ISO} AND val < lag(val) OVER (PARTITION BY x, y ORDER BY z) AS a, val < {ISO} AND val < lag(val) OVER (PARTITION BY y, z ORDER BY x) AS b, val < {ISO} AND val < lag(val) OVER (PARTITION BY z, x ORDER BY y) AS c FROM g)
---
SELECT id, coalesce(a, false) OR coalesce(b, false) OR coalesce(c, false) AS inside FROM falls""", "li", "id", "inside")
def combine_masks(spark, sf_dir):
    """Union of three masks, each made on slices along another axis and kept by the addresses of its own cyclically turned grid:
    id, (x nz + z) ny + y and (y nx + x) nz + z. A mask holds cells below the level and below the slice before."""
    cells, d = grids.shipped(spark, sf_dir), LI

    def fall(axis, others):
        before = F.lag("val").over(Window.partitionBy(*others).orderBy(axis))
        return F.coalesce((F.col("val") < ISO) & (F.col("val") < before), F.lit(False))

    first = (F.col("x") * d.nz + F.col("z")) * d.ny + F.col("y")
    second = (F.col("y") * d.nx + F.col("x")) * d.nz + F.col("z")
    m0 = cells.select("id", first.alias("id1"), second.alias("id2"), fall("z", ["x", "y"]).alias("a"))
    m1 = cells.select(first.alias("id1"), fall("x", ["y", "z"]).alias("b"))
    m2 = cells.select(second.alias("id2"), fall("y", ["z", "x"]).alias("c"))
    return m0.join(m1, "id1").join(m2, "id2").select("id", (F.col("a") | F.col("b") | F.col("c")).alias("inside"))


@job(f"""{NEIGHBOURS_26}
---
SELECT a.id, count(b.id) AS n26, sum(coalesce(b.val, 0)) AS sum26, count(b.id) FILTER (abs(dx) + abs(dy) + abs(dz) = 1) AS n6, sum(CASE WHEN abs(dx) + abs(dy) + abs(dz) = 1 THEN coalesce(b.val, 0) ELSE 0 END) AS sum6
FROM g a CROSS JOIN off LEFT JOIN g b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.id""", "li", "id n26 sum26 n6 sum6")
def neighbours(spark, sf_dir):
    """How many vertex and face neighbours lie in the grid, and their sums."""
    cells = stencil.block(grids.shipped(spark, sf_dir), "val")
    count = lambda offs: sum((stencil.at(o).isNotNull().cast("long") for o in offs), F.lit(0).cast("long"))
    return cells.select("id", count(OFFSETS_26).alias("n26"), stencil.total(OFFSETS_26).alias("sum26"), count(OFFSETS_6).alias("n6"), stencil.total(OFFSETS_6).alias("sum6"))


@job("""\n---\nSELECT a.id, count(b.id) - 1 AS n124, sum(b.val) - a.val AS sum124 FROM g a JOIN g b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.z BETWEEN a.z - 2 AND a.z + 2 GROUP BY a.id, a.val""", "events", "id n124 sum124")
def neighbours_124(spark, sf_dir):
    """The 5x5x5 surroundings by three running sums."""
    out = grids.activity(spark, sf_dir).withColumn("s", F.col("val")).withColumn("n", F.lit(1))
    for axis in "xyz":
        w = Window.partitionBy(*[a for a in "xyz" if a != axis]).orderBy(axis).rangeBetween(-2, 2)
        out = out.withColumn("s", F.sum("s").over(w)).withColumn("n", F.sum("n").over(w))
    return out.select("id", (F.col("n") - 1).alias("n124"), (F.col("s") - F.col("val")).alias("sum124"))


def _clamped(o):
    return F.coalesce(stencil.at(o), F.col("val"))


@job("\n---\nSELECT a.id, l.val AS left_val, r.val AS right_val, u.val AS up_val FROM g a JOIN g l ON l.y = a.y AND l.z = a.z AND l.x = greatest(a.x - 1, 0) JOIN g r ON r.y = a.y AND r.z = a.z AND r.x = least(a.x + 1, 11) JOIN g u ON u.x = a.x AND u.y = a.y AND u.z = least(a.z + 1, 29)", "events", "id left_val right_val up_val")
def clamped_reads(spark, sf_dir):
    """Reads beside the grid see its border."""
    cells = stencil.block(grids.activity(spark, sf_dir), "val")
    return cells.select("id", _clamped((-1, 0, 0)).alias("left_val"), _clamped((1, 0, 0)).alias("right_val"), _clamped((0, 0, 1)).alias("up_val"))


@job("\n---\nSELECT a.id, coalesce(l.val, 1000000000) AS left_val, coalesce(u.val, 1000000000) AS up_val FROM g a LEFT JOIN g l ON l.y = a.y AND l.z = a.z AND l.x = a.x - 1 LEFT JOIN g u ON u.x = a.x AND u.y = a.y AND u.z = a.z + 1", "events", "id left_val up_val")
def sentinel_reads(spark, sf_dir):
    """Reads beside the grid see a wall."""
    cells = stencil.block(grids.activity(spark, sf_dir), "val")
    wall = lambda o: F.coalesce(stencil.at(o), F.lit(1_000_000_000))
    return cells.select("id", wall((-1, 0, 0)).alias("left_val"), wall((0, 0, 1)).alias("up_val"))


@job(f"{ORDERED}\n---\nSELECT id, ord, 21503 - ord AS reverse_ord, row_number() OVER (ORDER BY val DESC, id DESC) - 1 AS falling, row_number() OVER (PARTITION BY z ORDER BY ord) - 1 AS slice_ord FROM o", "li", "id ord reverse_ord falling slice_ord")
def cell_orders(spark, sf_dir):
    """The filtration, reversed, falling, and within each slice."""
    cells = order.ranked(grids.shipped(spark, sf_dir))
    cells = order.ranked(cells, name="falling", descending=True)
    cells = order.ranked_within(cells, ["z"], value="ord", name="slice_ord")
    return cells.select("id", "ord", (F.lit(LI.n - 1) - F.col("ord")).alias("reverse_ord"), "falling", "slice_ord")


@job(f"{ORDERED}\n---\nSELECT count(*) AS n_below, max(ord) AS last_ord, max_by(id, ord) AS last_id FROM o WHERE val <= {ISO}", "li", "n_below last_ord last_id")
def last_below_isovalue(spark, sf_dir):
    below = order.ranked(grids.shipped(spark, sf_dir)).where(F.col("val") <= ISO)
    return below.agg(F.count("*").alias("n_below"), F.max("ord").alias("last_ord"), F.max_by("id", "ord").alias("last_id"))


@job("""s AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY val, id) - 1 AS slice_ord FROM g)
---
SELECT id, row_number() OVER (ORDER BY val, z, slice_ord) - 1 AS ord FROM s""", "events", "id ord")
def merge_slice_orders(spark, sf_dir):
    """Slice orders merged to one: by value, then slice, then place in the slice."""
    cells = order.ranked_within(grids.activity(spark, sf_dir), ["z"], name="slice_ord")
    keyed = cells.withColumn("place", F.col("z").cast("long") * EVENTS.slice + F.col("slice_ord"))
    return order.ranked(keyed, "val", "place").select("id", "ord")


_CARVED = "c AS (SELECT id, val, ((id * 7919) % 21504) AS carve FROM g)"


@job(f"{_CARVED}\n---\nSELECT id, max(val) OVER (ORDER BY carve) AS up_val, min(val) OVER (ORDER BY carve DESC) AS down_val FROM c", "li", "id up_val down_val")
def monotone_clamp(spark, sf_dir):
    """Values made monotone along a carving order (here a fixed permutation): running maximum, and running minimum from the end."""
    carve = (F.col("id") * 7919) % LI.n
    cells = grids.shipped(spark, sf_dir).select("id", "val", carve.alias("carve"))
    up = order.running_extreme(cells, "val", "carve", "up_val")
    return order.running_extreme(up, "val", "carve", "down_val", largest=False).select("id", "up_val", "down_val")


@job(f"{_CARVED}\n---\nSELECT id, val * 43008 + carve AS scaled FROM c", "li", "id scaled")
def strict_values(spark, sf_dir):
    """Values that no two cells share: value + rank / 2n, here times 2n to stay whole."""
    return grids.shipped(spark, sf_dir).select("id", (F.col("val") * (2 * LI.n) + (F.col("id") * 7919) % LI.n).alias("scaled"))


_SMOOTH = """w AS (SELECT a.id, a.z, 2 * a.val + coalesce(sum(b.val), 0) + a.val * (6 - count(b.id)) AS total FROM g a LEFT JOIN g b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1
  AND b.id IN (a.id - 1, a.id + 1, a.id - 16, a.id + 16, a.id - 256, a.id + 256) GROUP BY a.id, a.z, a.val)"""


def _smoothed(spark, sf_dir):
    cells = stencil.block(grids.shipped(spark, sf_dir), "val")
    return cells.withColumn("smooth", F.floor((2 * F.col("val") + stencil.total(OFFSETS_6, default=F.col("val"))) / 8)).drop("around")


@job(f"{_SMOOTH}\n---\nSELECT id, greatest(0, least(65535, total // 8)) AS smooth FROM w", "li", "id smooth")
def smooth_and_clamp(spark, sf_dir):
    """Twice the centre and the six face neighbours (border: itself), an eighth, as 16-bit levels."""
    return _smoothed(spark, sf_dir).select("id", F.least(F.greatest("smooth", F.lit(0)), F.lit(65535)).alias("smooth"))


@job(f"{_SMOOTH}\n---\nSELECT w.z, sum(abs(total // 8 - val)) AS change, max(abs(total // 8 - val)) AS most, count(*) FILTER (total // 8 <> val) AS changed FROM w JOIN g USING (id) GROUP BY w.z", "li", "z change most changed")
def filter_statistics(spark, sf_dir):
    d = F.abs(F.col("smooth") - F.col("val"))
    return _smoothed(spark, sf_dir).groupBy("z").agg(F.sum(d).alias("change"), F.max(d).alias("most"), F.count_if(d > 0).alias("changed"))


@job(f"\n---\nSELECT id, CASE WHEN val < {ISO} THEN least(val - {ISO}, -3) ELSE greatest(val - {ISO}, 3) END AS f FROM g", "li", "id f")
def sign_clamp(spark, sf_dir):
    """Signed distance to the isovalue, kept away from zero."""
    f = F.col("val") - ISO
    return grids.shipped(spark, sf_dir).select("id", F.when(f < 0, F.least(f, F.lit(-3))).otherwise(F.greatest(f, F.lit(3))).alias("f"))


@job("\n---\nSELECT val AS level, count(*) AS n FROM g GROUP BY 1", "li", "level n")
def histogram(spark, sf_dir):
    return grids.shipped(spark, sf_dir).groupBy(F.col("val").alias("level")).agg(F.count("*").alias("n"))


@job(f"\n---\nSELECT z, y, string_agg(CASE WHEN val < {ISO} THEN 'x' ELSE '.' END, '' ORDER BY x) AS line FROM g GROUP BY z, y", "li", "z y", "line")
def text_dump(spark, sf_dir):
    """Each row of a slice as text."""
    mark = F.struct("x", F.when(F.col("val") < ISO, "x").otherwise(".").alias("c"))
    return grids.shipped(spark, sf_dir).groupBy("z", "y").agg(F.array_sort(F.collect_list(mark)).alias("r")).select("z", "y", F.array_join(F.transform("r", lambda e: e["c"]), "").alias("line"))


@job(f"\n---\nSELECT z, CASE WHEN val < {ISO} THEN 255 ELSE least(val, 255) END AS red, CASE WHEN val < {ISO} THEN 0 ELSE least(val, 255) END AS gray, count(*) AS n FROM g GROUP BY ALL", "li", "z red gray n")
def slice_images(spark, sf_dir):
    """Colours of slice images: red inside, gray outside; pixels per colour."""
    inside, level = F.col("val") < ISO, F.least("val", F.lit(255))
    return grids.shipped(spark, sf_dir).groupBy("z", F.when(inside, 255).otherwise(level).alias("red"), F.when(inside, 0).otherwise(level).alias("gray")).agg(F.count("*").alias("n"))


