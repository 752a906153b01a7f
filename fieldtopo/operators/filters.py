"""Filters in passes over a grid: a masked Gaussian that keeps signs, a relaxation with pinned cells, and distances of straight steps.

A pass reads the values before it and writes its own to the shared folder, so lineage stays one pass long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import OFFSETS_26
from ..sources.grids import Dims
from ..sources.shared import forget, written
from . import stencil
from .flood import pairs

# The weights of a cell, its faces, edges and corners, their norm, and the least magnitude that a value keeps.
W_CELL, W_FACE, W_EDGE, W_CORNER, NORM = 0.39894228, 0.129517596, 0.042048207, 0.0136510542, 1.78983477
LEAST = 0.1
# The twelve terms that the edge weight multiplies; some are faces, and (0, -1) stands for (0, 1) too. They are kept for equal results.
_EDGE_TERMS = [(dx, dy, dz) for dz in (-1, 0, 1) for dx, dy in ((-1, 0), (0, -1), (1, 0), (0, -1))]
_FACE_TERMS = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
_CORNER_TERMS = [o for o in OFFSETS_26 if all(o)]


def _sum(offsets) -> Column:
    return reduce(Column.__add__, [stencil.at(o) for o in offsets])


def keep_sign(old: Column, new: Column, least: float = LEAST) -> Column:
    """new, but on old's side of 0 and at least `least` away from it."""
    return F.when(old < 0, F.least(new, F.lit(-least))).otherwise(F.greatest(new, F.lit(least)))


def interior(dims: Dims) -> Column:
    return reduce(Column.__and__, [F.col(a).between(1, n - 2) for a, n in zip("xyz", dims[:3], strict=True)])


def gaussian(cells: DataFrame, dims: Dims, passes: int = 50) -> DataFrame:
    """(id, x, y, z, val double, known) after so many passes over the unknown cells inside; known ones and the border keep their values."""
    now = cells.select("id", "x", "y", "z", F.col("val").cast("double").alias("val"), "known")
    path = None
    for _ in range(passes):
        mean = (W_CORNER * _sum(_CORNER_TERMS) + W_EDGE * _sum(_EDGE_TERMS) + W_FACE * _sum(_FACE_TERMS) + W_CELL * F.col("val")) / NORM
        moved = F.when(interior(dims) & ~F.col("known"), keep_sign(F.col("val"), mean)).otherwise(F.col("val"))
        new, new_path = written(stencil.block(now, "val").select("id", "x", "y", "z", moved.alias("val"), "known"), "gaussian")
        if path:
            forget(now, path)
        now, path = new, new_path
    return now


def relaxed(cells: DataFrame, dims: Dims, pins: dict[tuple[int, int], float], passes: int = 250, pinned: int = 225) -> DataFrame:
    """(id, x, y, z, val double) of slices after passes of the mean of a cell, weighing as much as its four neighbours, with them; border
    cells have fewer. Pinned places have their value in the first `pinned` passes."""
    now, path = cells.select("id", "x", "y", "z", F.col("val").cast("double").alias("val")), None
    pin = F.lit(None).cast("double")
    for (x, y), v in pins.items():
        pin = F.when((F.col("x") == x) & (F.col("y") == y), F.lit(float(v))).otherwise(pin)
    near = [(-1, 0, 0), (0, -1, 0), (1, 0, 0), (0, 1, 0)]
    for k in range(passes):
        there = [stencil.at(o).isNotNull().cast("int") for o in near]
        n = reduce(Column.__add__, there)
        total = reduce(Column.__add__, [F.coalesce(stencil.at(o), F.lit(0.0)) for o in near])
        mean = (n * F.col("val") + total) / (2 * n)
        new, new_path = written(stencil.block(now, "val").select("id", "x", "y", "z", (F.coalesce(pin, mean) if k < pinned else mean).alias("val")), "relaxed")
        if path:
            forget(now, path)
        now, path = new, new_path
    return now


def straight_distances(cells: DataFrame, offsets=OFFSETS_26, delta: float = 2.0) -> DataFrame:
    """(id, dist double): the shortest way over neighbours from a cell whose `seed` is true, each step as long as it is straight; cells that
    no way reaches are left out.

    Cells are settled by buckets of distances `delta` wide: within a bucket the cells that got nearer go on until none does, then
    the bucket is done. A round sends only what changed."""
    steps = F.sqrt(sum(((F.col(f"n{a}") - F.col(a)) * (F.col(f"n{a}") - F.col(a)) for a in "xyz"), F.lit(0)))
    far = cells.select(F.col("id").alias("near"), *[F.col(a).alias(f"n{a}") for a in "xyz"])
    links, links_at = written(pairs(cells, [], offsets).join(cells.select("id", "x", "y", "z"), "id").join(far, "near").select("id", "near", steps.alias("step")), "straight-links")
    best, path = written(cells.where("seed").select("id", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh")), "straight")
    while True:
        low = best.where("fresh").agg(F.min("dist").alias("m")).first().m
        if low is None:
            forget(cells, links_at)
            return best.select("id", "dist")
        front = best.where(F.col("fresh") & (F.col("dist") < low + delta))
        sent = links.join(front.select("id", "dist"), "id").groupBy(F.col("near").alias("id")).agg(F.min(F.col("dist") + F.col("step")).alias("new"))
        rest = best.withColumn("fresh", F.col("fresh") & (F.col("dist") >= low + delta))
        both = rest.join(sent, "id", "full")
        nearer = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))
        new, new_path = written(both.select("id", F.when(nearer, F.col("new")).otherwise(F.col("dist")).alias("dist"), (nearer | F.coalesce("fresh", F.lit(False))).alias("fresh")), "straight")
        forget(cells, path)
        best, path = new, new_path
