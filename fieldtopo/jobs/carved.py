"""Jobs that stand on a carving: clamps and orders along it, files of the simplified volume, series carved by step and whole, volumes fixed
by their fronts. Carving has no SQL; what is made of it is compared with plain versions in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import carve, order, stencil, whole_fronts
from ..sources import grids, volumes
from ..sources.grids import BLOCK, LI
from .common import job
from .fronts import FEATURES, by_grid
from .shapes import _at

FEATURE = 10


def _carved(spark, sf_dir):
    """(z, id, val, ord, new_val, order): the large grid carved by slices, with the one order of all slices."""
    cells = grids.shipped(spark, sf_dir)
    return carve.merged(carve.carve(cells, ["z"], FEATURE), "z").join(cells.select("id", "val"), "id")


@job()
def clamp_along_carving(spark, sf_dir):
    """Values made monotone along the order of a carving: the running maximum, and the running minimum from the end."""
    up = order.running_extreme(_carved(spark, sf_dir).select("id", "val", "order"), "val", "order", "up_val")
    return order.running_extreme(up, "val", "order", "down_val", largest=False).select("id", "val", "order", "up_val", "down_val")


@job()
def strict_carved_values(spark, sf_dir):
    """Simplified values that no two cells share: the carving's value, and its order as 2n-ths, here times 2n to stay whole."""
    return _carved(spark, sf_dir).select("id", (F.col("new_val") * (2 * LI.n) + F.col("order")).alias("scaled"))


@job()
def simplified_files(spark, sf_dir):
    """The simplified volume and its order written as files, slab by slab, and read back: the stored order is the one in use."""
    made = _carved(spark, sf_dir).select("id", "z", "new_val", "order")
    values, ranks = _at(spark, ""), _at(spark, "")
    volumes.write_slabs(made.withColumnRenamed("new_val", "val"), LI, values, ".v").write.format("noop").mode("overwrite").save()
    volumes.write_slabs(made.withColumnRenamed("order", "val"), LI, ranks, ".vo").write.format("noop").mode("overwrite").save()
    read = lambda root, suffix, name: volumes.read_slabs(spark, root, suffix).select("id", F.col("val").cast("long").alias(name))
    return read(values, ".v", "new_val").join(read(ranks, ".vo", "ord"), "id")


def _series_counts(cells, carved, name):
    """Critical cells in 4-D of each step, in the order of the values and in that of a carving."""
    both = order.ranked(cells).join(carved, "id")
    masks = stencil.block(both, "ord", axes="xyzt").select("id", "t", *[m.alias(n) for m, n in zip(stencil.lower_mask_4d("ord"), ("a", "b"), strict=True)])
    after = stencil.block(both, "carve", axes="xyzt").select("id", *[m.alias(n) for m, n in zip(stencil.lower_mask_4d("carve"), ("c", "d"), strict=True)])
    tested = masks.join(after, "id").select("t", arrays.strict_4d(F.col("a"), F.col("b")).alias("before"), arrays.strict_4d(F.col("c"), F.col("d")).alias(name))
    return tested.groupBy("t").agg(F.count_if("before").alias("before"), F.count_if(name).alias(name))


@job()
def carve_series_by_step(spark, sf_dir):
    """A series carved step by step with the strict test of three dimensions; critical cells before and after, by step."""
    cells = grids.shipped_4d(spark, sf_dir)
    carved = carve.merged(carve.carve(cells, ["t"], FEATURE, carve.strict_test), "t").select("id", F.col("order").alias("carve"))
    return _series_counts(cells, carved, "after")


@job()
def carve_series(spark, sf_dir):
    """A series carved as one with the test of the step and of 4-D; critical cells before and after, by step. The series is one group: its
    order is sequential."""
    cells = grids.shipped_4d(spark, sf_dir)
    carved = carve.carve(cells.withColumn("series", F.lit(0)), ["series"], FEATURE, carve.combo_4d_test).select("id", F.col("ord").alias("carve"))
    return _series_counts(cells, carved, "after")


@job()
def fixed_by_fronts(spark, sf_dir):
    """Every grid carved from both sides, the cells left turned to the other side: how many changed sign, and the cells inside before and after."""

    def work(val, known, table):
        fixed = whole_fronts.fixed(whole_fronts.two_sides(val, known, BLOCK, table, "io", FEATURES))
        counts = {"turned": np.sign(val) != np.sign(fixed), "inside_before": val < 0, "inside_after": fixed < 0}
        return np.arange(len(val)), {k: v.sum(axis=1) for k, v in counts.items()}

    return by_grid(spark, sf_dir, work, "turned long, inside_before long, inside_after long")
