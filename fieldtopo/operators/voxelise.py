"""Volumes out of meshes: triangles expanded to the scan lines that they cross, parity along an axis, a vote of three axes.

A scan line runs through cell centres along one axis. A triangle goes to the lines of its shadow's bounding box and keeps those in the
shadow; a line that meets an edge or a corner is taken to pass it a little to one side (always the same), so closed meshes are
crossed an even number of times. The sorted crossings of a line, two at a time, are the runs of cells inside.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.grids import Dims, address


def to_cell(c: Column, low: Column | float, high: Column | float, n: int) -> Column:
    """A coordinate between low and high in cells of a side with n."""
    return (c - low) / (high - low) * n


def crossing_axis(x: Column, y: Column, z: Column, near: float) -> Column:
    """The axis whose scan line a vertex lies on: the other two coordinates are at cell centres (integers). 'off' lies on no line, 'all' on
    three of them, which tells nothing."""
    at = [F.abs(c - F.round(c)) < near for c in (x, y, z)]
    return F.when(at[0] & at[1] & at[2], "all").when(at[0] & at[1], "z").when(at[1] & at[2], "x").when(at[0] & at[2], "y").otherwise("off")


def placed(tris: DataFrame, verts: DataFrame) -> DataFrame:
    """(t, ax, ay, az, bx, ... cz): the triangles with their corners' places."""
    for k in "abc":
        tris = tris.join(verts.select(F.col("v").alias(k), *[F.col(o).alias(f"{k}{o}") for o in "xyz"]), k)
    return tris.select("t", *[f"{k}{o}" for k in "abc" for o in "xyz"])


def crossings(corners: DataFrame, dims: Dims, axis: str) -> DataFrame:
    """(p, q, at): where the mesh crosses the scan lines along an axis; p and q are the line's place on the other two, in order."""
    p, q = (o for o in "xyz" if o != axis)
    size = dict(zip("xyz", dims[:3], strict=True))

    def span(o: str) -> Column:
        low, high = (f(*[F.col(k + o) for k in "abc"]) for f in (F.least, F.greatest))
        low, high = F.greatest(F.ceil(low), F.lit(0)), F.least(F.floor(high), F.lit(size[o] - 1))
        return F.when(low <= high, F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))).otherwise(F.array().cast("array<int>"))

    lines = corners.withColumn("p", F.explode(span(p))).withColumn("q", F.explode(span(q)))

    def side(a: str, b: str) -> tuple[Column, Column]:
        """Twice the area of an edge and the line, and its sign with the line moved a little along p, and less along q."""
        dp, dq = F.col(b + p) - F.col(a + p), F.col(b + q) - F.col(a + q)
        area = dp * (F.col("q") - F.col(a + q)) - dq * (F.col("p") - F.col(a + p))
        return area, F.when(area != 0, F.signum(area)).when(dq != 0, -F.signum(dq)).otherwise(F.signum(dp))

    (wc, sc), (wa, sa), (wb, sb) = side("a", "b"), side("b", "c"), side("c", "a")
    hit = lines.where((sa == sb) & (sb == sc) & (sa != 0))
    total = wa + wb + wc
    at = F.when(total != 0, (wa * F.col("a" + axis) + wb * F.col("b" + axis) + wc * F.col("c" + axis)) / total).otherwise(F.col("a" + axis))
    # No rounding where the line meets a corner, or an edge or a face that stands square to it: between the corners that count.
    ends = [F.when(w != 0, F.col(k + axis)) for k, w in zip("abc", (wa, wb, wc), strict=True)]
    at = F.when(total != 0, F.greatest(F.least(*ends), F.least(F.greatest(*ends), at))).otherwise(at)
    return hit.select("p", "q", at.alias("at"))


def inside_along(corners: DataFrame, dims: Dims, axis: str) -> DataFrame:
    """(id): cells after an odd number of crossings along an axis."""
    size = dict(zip("xyz", dims[:3], strict=True))[axis]
    line = Window.partitionBy("p", "q").orderBy("at")
    runs = crossings(corners, dims, axis).withColumn("k", F.row_number().over(line)).withColumn("end", F.lead("at").over(line)).where("k % 2 = 1")
    # From the first centre beyond the way in to the last before the way out; a centre on the surface is outside.
    first, last = F.greatest(F.floor("at") + 1, F.lit(0)), F.least(F.ceil(F.coalesce("end", F.lit(float(size)))) - 1, F.lit(size - 1))
    cells = runs.where(first <= last).select("p", "q", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias(axis))
    p, q = (o for o in "xyz" if o != axis)
    return cells.select(address(dims, *[F.col({p: "p", q: "q"}.get(o, axis)) for o in "xyz"]).alias("id"))


def voxelised(tris: DataFrame, verts: DataFrame, dims: Dims, axes: str = "xyz") -> DataFrame:
    """(id): cells that most of the axes find inside."""
    corners = placed(tris, verts)
    votes = inside_along(corners, dims, axes[0])
    for axis in axes[1:]:
        votes = votes.unionByName(inside_along(corners, dims, axis))
    return votes.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") * 2 > len(axes)).select("id")


def without_shafts(cells: DataFrame, dims: Dims) -> DataFrame:
    """(id, x, y, z, inside) with every cell flipped that differs from its four neighbours in the plane of x and z, one after the other along x, then
    z: a cell next to one that was flipped has a neighbour like itself by then. Border cells stay. Only such cells meet, by plane."""
    along = {a: Window.partitionBy(*[o for o in "xyz" if o != a]).orderBy(a) for a in "xz"}
    near = [f("inside").over(w) for w in along.values() for f in (F.lag, F.lead)]
    alone = near[0] != F.col("inside")
    for n in near[1:]:
        alone = alone & (n != F.col("inside"))
    border = (F.col("x") == 0) | (F.col("z") == 0) | (F.col("x") == dims.nx - 1) | (F.col("z") == dims.nz - 1)
    found = cells.withColumn("alone", F.coalesce(alone & ~border, F.lit(False)))

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        done: set[tuple[int, int]] = set()
        ids = []
        for i, x, z in pdf.sort_values(["x", "z"])[["id", "x", "z"]].itertuples(index=False):
            if (x - 1, z) not in done and (x, z - 1) not in done:
                done.add((x, z))
                ids.append(i)
        return pd.DataFrame({"id": ids, "flip": [True] * len(ids)})

    flips = found.where("alone").select("id", "x", "y", "z").groupBy("y").applyInPandas(turn, "id long, flip boolean")
    return cells.join(flips, "id", "left").select("id", "x", "y", "z", (F.col("inside") != F.coalesce("flip", F.lit(False))).alias("inside"))
