"""Surfaces of voxel sets as triangle relations: tris(t, a, b, c) over lattice corners, and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.grids import Dims
from . import stencil
from .flood import components
from .order import numbered

# The four corners of the face towards +x, +y, +z of a cell, seen from outside, counter-clockwise.
FACES = {
    (1, 0, 0): [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)],
    (0, 1, 0): [(0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)],
    (0, 0, 1): [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)],
}


def corner(dims: Dims, d: tuple[int, int, int]) -> Column:
    """Id of a cell's corner on the lattice of (nx+1)(ny+1)(nz+1) points."""
    x, y, z = (F.col(c) + k for c, k in zip("xyz", d, strict=True))
    return ((z * (dims.ny + 1) + y) * (dims.nx + 1) + x).cast("long")


def corner_place(dims: Dims, v: str) -> list[Column]:
    c, nx, ny = F.col(v), dims.nx + 1, dims.ny + 1
    return [(c % nx).alias("vx"), (F.floor(c / nx) % ny).alias("vy"), F.floor(c / (nx * ny)).alias("vz")]


def voxel_faces(cells: DataFrame, dims: Dims, inside: Column) -> DataFrame:
    """(t, a, b, c): two triangles for each pair of face neighbours of which one is inside; normals point out of the set."""
    marked = stencil.block(cells.withColumn("inside", inside), "inside")
    found = []
    for f, (step, corners) in enumerate(FACES.items()):
        p = [corner(dims, d) for d in corners]
        other = stencil.at(step)
        turned = [p[0], p[3], p[2], p[1]]
        for k, (i, j, m) in enumerate(((0, 1, 2), (0, 2, 3))):
            tri = F.struct((F.col("id") * 6 + 2 * f + k).alias("t"), F.when(F.col("inside"), p[i]).otherwise(turned[i]).alias("a"), F.when(F.col("inside"), p[j]).otherwise(turned[j]).alias("b"), F.when(F.col("inside"), p[m]).otherwise(turned[m]).alias("c"))
            found.append(F.when(other != F.col("inside"), tri))
    return marked.select(F.explode(F.array_compact(F.array(*found))).alias("s")).select("s.t", "s.a", "s.b", "s.c")


def edges(tris: DataFrame) -> DataFrame:
    """(u, v, n): undirected edges and how many triangles hold them."""
    sides = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    return tris.select(F.explode(sides).alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("n"))


def vertices(tris: DataFrame) -> DataFrame:
    return tris.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct()


def labelled(tris: DataFrame) -> DataFrame:
    """tris with the label of their component: components share vertices; labels count from 1 in order of their first triangle."""
    both = edges(tris).select("u", "v")
    links = both.select(F.col("u").alias("id"), F.col("v").alias("near")).unionByName(both.select(F.col("v").alias("id"), F.col("u").alias("near")))
    roots = components(vertices(tris).withColumnRenamed("v", "id"), links, []).select(F.col("id").alias("a"), F.col("label").alias("root"))
    rooted = tris.join(roots, "a")
    first = rooted.groupBy("root").agg(F.min("t").alias("t0"))
    names = numbered(first, [F.col("t0")], "label").select("root", (F.col("label") + 1).cast("int").alias("label"))
    return rooted.join(names, "root").select("t", "a", "b", "c", "label")


def vertex_normals(tris: DataFrame, dims: Dims, per: str = "v") -> DataFrame:
    """(v, px, py, pz): sums of the cross products of each vertex's triangles (twice the area-weighted normal); per "t", each triangle's own."""
    at = {k: corner_place(dims, k) for k in "abc"}
    placed = tris.select("t", "a", "b", "c", *[c.alias(f"{k}{i}") for k, cols in at.items() for i, c in enumerate(cols)])
    p, q = [[F.col(f"{k}{i}") - F.col(f"a{i}") for i in range(3)] for k in "bc"]
    cross = [(p[(i + 1) % 3] * q[(i + 2) % 3] - p[(i + 2) % 3] * q[(i + 1) % 3]).alias(f"n{i}") for i in range(3)]
    if per == "t":
        return placed.select("t", *[c.alias(n) for c, n in zip(cross, ("px", "py", "pz"), strict=True)])
    each = placed.select(F.explode(F.array("a", "b", "c")).alias("v"), *cross)
    return each.groupBy("v").agg(*[F.sum(f"n{i}").alias(n) for i, n in enumerate(("px", "py", "pz"))])
