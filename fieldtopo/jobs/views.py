"""Jobs behind interactive views, files and streams; carving; vector arithmetic on embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.masks import changes_topology, changes_topology_2d
from ..operators import carve, order, stencil
from ..sources import grids, volumes
from ..sources.grids import LI
from ..sources.shared import written
from ..streaming import slices
from .common import ORDERED, job

ISO = 70


@job(f"{ORDERED}\n---\nSELECT id, ord <= (SELECT ord FROM o WHERE x = 7 AND y = 7 AND z = 40) AS below_picked, val < {ISO} OR (val = {ISO} AND id <= 10000) AS below_tie, ord <= (SELECT max(ord) FROM (SELECT ord FROM o WHERE z = 40 ORDER BY ord LIMIT 100)) AS below_step FROM o", "li", "id", "below_picked below_tie below_step")
def below_selection(spark, sf_dir):
    """Cells below a picked cell, below a value with a tie-break, and below the hundredth cell of a slice."""
    cells = order.ranked(grids.shipped(spark, sf_dir))
    picked = cells.where("x = 7 AND y = 7 AND z = 40").agg(F.max("ord").alias("picked"))
    step = order.ranked_within(cells.where("z = 40"), ["z"], "ord", name="k").where("k < 100").agg(F.max("ord").alias("step"))
    joined = cells.crossJoin(F.broadcast(picked)).crossJoin(F.broadcast(step))  # single rows
    tie = (F.col("val") < ISO) | ((F.col("val") == ISO) & (F.col("id") <= 10000))
    return joined.select("id", (F.col("ord") <= F.col("picked")).alias("below_picked"), tie.alias("below_tie"), (F.col("ord") <= F.col("step")).alias("below_step"))


@job("\n---\nSELECT a.id, (a.val + b.val + c.val + d.val) // 4 AS mean FROM g a JOIN g b ON b.z = a.z AND b.x = a.x + 1 AND b.y = a.y JOIN g c ON c.z = a.z AND c.x = a.x AND c.y = a.y + 1 JOIN g d ON d.z = a.z AND d.x = a.x + 1 AND d.y = a.y + 1", "li", "id mean")
def corner_averages(spark, sf_dir):
    """Means of four pixels around each inner corner."""
    cells = stencil.block(grids.shipped(spark, sf_dir), "val", axes="xy")
    four = F.col("val") + stencil.at((1, 0)) + stencil.at((0, 1)) + stencil.at((1, 1))
    return cells.select("id", F.floor(four / 4).alias("mean")).where("mean IS NOT NULL")


@job(f"\n---\nSELECT a.z, 0 AS axis, count(*) AS segments FROM g a JOIN g b ON b.z = a.z AND b.y = a.y AND b.x = a.x + 1 WHERE (a.val < {ISO}) <> (b.val < {ISO}) GROUP BY a.z UNION ALL SELECT a.z, 1, count(*) FROM g a JOIN g b ON b.z = a.z AND b.x = a.x AND b.y = a.y + 1 WHERE (a.val < {ISO}) <> (b.val < {ISO}) GROUP BY a.z", "li", "z axis segments")
def isolines(spark, sf_dir):
    """Pixel-edge segments of each slice's contour, by direction."""
    cells = stencil.block(grids.shipped(spark, sf_dir).withColumn("below", F.col("val") < ISO), "below", axes="xy")
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), (stencil.at(d) != F.col("below")).alias("flip")) for i, d in enumerate([(1, 0), (0, 1)])]))
    return cells.select("z", sides.alias("s")).where("s.flip").groupBy("z", "s.axis").agg(F.count("*").alias("segments"))


_V = "v AS (SELECT vec_id, CAST(floor(1000 * CAST(embedding[1] AS DOUBLE)) AS BIGINT) AS x, CAST(floor(1000 * CAST(embedding[2] AS DOUBLE)) AS BIGINT) AS y, CAST(floor(1000 * CAST(embedding[3] AS DOUBLE)) AS BIGINT) AS z FROM embeddings)"


@job(f"{_V}\n---\nSELECT a.vec_id, a.x * b.x + a.y * b.y + a.z * b.z AS dot, a.y * b.z - a.z * b.y AS cx, a.z * b.x - a.x * b.z AS cy, a.x * b.y - a.y * b.x AS cz, a.x * a.x + a.y * a.y + a.z * a.z AS squared, greatest(a.x, b.x) AS max_x, least(a.z, b.z) AS min_z FROM v a JOIN v b ON b.vec_id = a.vec_id + 1", None, "vec_id dot cx cy cz squared max_x min_z")
def vector_products(spark, sf_dir):
    """Dot and cross products of each vector's first three components with the next one's."""
    three = [F.floor(1000 * F.col("embedding")[i].cast("double")).cast("long").alias(c) for i, c in enumerate("xyz")]
    a = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *three)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    x, y, z, bx, by, bz = (F.col(c) for c in ("x", "y", "z", "bx", "by", "bz"))
    dot, squared = x * bx + y * by + z * bz, x * x + y * y + z * z
    return a.join(b, "vec_id").select("vec_id", dot.alias("dot"), (y * bz - z * by).alias("cx"), (z * bx - x * bz).alias("cy"), (x * by - y * bx).alias("cz"), squared.alias("squared"), F.greatest(x, bx).alias("max_x"), F.least(z, bz).alias("min_z"))


def _files(spark):
    _, root = written(spark.range(1), "volume")
    return f"{root}-{uuid.uuid4().hex}"


@job("\n---\nSELECT id, val FROM g", "li", "id val")
def volume_files(spark, sf_dir):
    """The grid written as float volume files, slab by slab, and read back."""
    root = _files(spark)
    volumes.write_slabs(grids.shipped(spark, sf_dir), LI, root, ".v").write.format("noop").mode("overwrite").save()
    return volumes.read_slabs(spark, root, ".v").select("id", F.col("val").cast("long").alias("val"))


@job(f"\n---\nSELECT id, CASE WHEN val >= {ISO} THEN 1 ELSE -1 END AS side FROM g", "li", "id side")
def sign_files(spark, sf_dir):
    """The grid's signs written as two-bit volume files and read back."""
    root = _files(spark)
    cells = grids.shipped(spark, sf_dir).withColumn("val", F.col("val") - ISO)
    volumes.write_slabs(cells, LI, root, ".v2").write.format("noop").mode("overwrite").save()
    return volumes.read_slabs(spark, root, ".v2").select("id", F.col("val").cast("long").alias("side"))


@job(f"{ORDERED}\n---\nSELECT id, ord FROM o", "li", "id ord")
def order_files(spark, sf_dir):
    """The filtration written as rank files and read back."""
    root = _files(spark)
    cells = order.ranked(grids.shipped(spark, sf_dir)).select("id", "z", F.col("ord").alias("val"))
    volumes.write_slabs(cells, LI, root, ".vo").write.format("noop").mode("overwrite").save()
    return volumes.read_slabs(spark, root, ".vo").select("id", F.col("val").cast("long").alias("ord"))


@job("\n---\nSELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, sum(CAST(floor(value) AS BIGINT)) AS total FROM events GROUP BY 1, 2", None, "start n total", "event_type")
def streamed_slices(spark, sf_dir):
    """Events by day and type, counted by a stream that runs over the files that are there."""
    out = slices.run_slice_counts(spark, f"{sf_dir}/events.parquet", _files(spark))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


@job()
def carve_slices(spark, sf_dir):
    """New order and values of every slice after topology-controlled carving (features of ten units stay), and the order of all slices together."""
    return carve.merged(carve.carve(grids.shipped(spark, sf_dir), ["z"], 10), "z")


@job()
def carving_report(spark, sf_dir):
    """Critical cells of each slice before and after carving."""
    cells = order.ranked_within(grids.shipped(spark, sf_dir), ["z"])
    carved = carve.carve(cells, ["z"], 10).select("id", F.col("ord").alias("carve"))
    both = stencil.block(stencil.block(cells.join(carved, "id"), "ord", axes="xy"), "carve", axes="xy", name="around2")
    count = lambda o, a: F.count_if(changes_topology_2d(stencil.slice_mask(o, a)))
    return both.groupBy("z").agg(count("ord", "around").alias("before"), count("carve", "around2").alias("after"))


def _carved_volume(spark, sf_dir, test):
    """The small grid with its ranks before and after carving in blocks of four slices."""
    cells = order.ranked(grids.shipped_small(spark, sf_dir)).withColumn("block", F.floor(F.col("z") / 4).cast("int"))
    return cells.join(carve.carve(cells, ["block"], 40, test).select("id", F.col("ord").alias("carve"), "new_val"), "id")


@job()
def carve_volume(spark, sf_dir):
    """Carving by the strict three-dimensional test, in blocks of four slices: every cell's place in its block and its new value."""
    return _carved_volume(spark, sf_dir, carve.strict_test).select("block", "id", "val", "carve", "new_val")


@job()
def carve_volume_and_slices(spark, sf_dir):
    """The same with the test that a slice's topology must stay as well; critical cells of each block before and after."""
    both = _carved_volume(spark, sf_dir, carve.combo_test).withColumn("zz", F.col("z") % 4)
    within = order.ranked_within(both, ["block"], name="own")
    around = stencil.block(stencil.block(within, "own", extra=("block",)), "carve", extra=("block",), name="around2")
    masks = around.select("block", stencil.lower_mask("own").alias("m1"), stencil.lower_mask("carve", name="around2").alias("m2"))  # columns of their own: the test looks at them often
    return masks.groupBy("block").agg(F.count_if(changes_topology(F.col("m1"))).alias("before"), F.count_if(changes_topology(F.col("m2"))).alias("after"))


@job()
def uncarved_report(spark, sf_dir):
    """Cells whose carving moved them or changed their value, by slice: nothing is left uncarved."""
    carved = carve.carve(order.ranked_within(grids.shipped(spark, sf_dir), ["z"]), ["z"], 10)
    both = carved.join(grids.shipped(spark, sf_dir).select("id", "val"), "id")
    return both.groupBy("z").agg(F.count_if(F.col("ord") < 0).alias("uncarved"), F.count_if(F.col("new_val") != F.col("val")).alias("changed"), F.max(F.col("new_val") - F.col("val")).alias("largest_delay"))
