"""Test fields and what their surfaces are known to have: components, Euler characteristics, first Betti numbers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldtopo.operators import flood, mesh
from fieldtopo.sources import synthetic
from fieldtopo.sources.grids import Dims


def betti(cells, dims):
    tris, _ = mesh.voxel_faces(cells, dims, F.col("val") < 0), None
    tris = tris.cache()
    edges = mesh.edges(tris)
    chi = mesh.vertices(tris).count() - edges.count() + tris.count()
    n = mesh.labelled(tris).agg(F.max("label")).first()[0] or 0
    return n, chi, edges.where("n <> 2").count()


@pytest.mark.parametrize("name,want", [("sphere", (1, 2)), ("torus", (1, 0)), ("spheres", (1, None))])
def test_surfaces_have_their_betti_numbers(spark, name, want):
    dims = Dims(20, 20, 12)
    if name == "sphere":
        cells = synthetic.field(spark, dims, synthetic.sphere(4.3, 9.1, 9.2, 5.4))
    elif name == "torus":
        cells = synthetic.field(spark, dims, synthetic.torus(6.1, 2.3, 9.1, 9.2, 5.4))
    else:
        dims = Dims(32, 32, 32)
        cells = synthetic.eight_spheres(spark, 32)
    n, chi, odd = betti(cells, dims)
    if name == "spheres":  # neighbours touch where their radii add up to more than the distance
        assert n >= 1 and chi % 2 == 0
        return
    assert odd == 0 and (n, chi) == want
    assert 2 * n - chi == {"sphere": 0, "torus": 2}[name]


def test_boxes_letters_and_rings(spark):
    boxes = synthetic.boxes(spark)
    inside = {(x + i, y + j, z + k) for x, y, z, a, b, c in synthetic.BOXES for i in range(a) for j in range(b) for k in range(c)}
    assert boxes.count() == 31 * 31 * 7 and boxes.where("val < 0").count() == len(inside)
    assert synthetic.letters(spark).where("val < 0").groupBy("z").count().orderBy("z").toPandas()["count"].tolist() == [11, 12, 11]
    ring = synthetic.square_ring(spark)
    found = flood.distances(ring.withColumn("seed", F.col("val") == 1).select("id", "x", "y", "z", "seed"))
    assert found.count() == ring.count() and found.where("dist = 0").count() == 32
    assert synthetic.disc(spark).agg(F.min("val")).first()[0] == 0
    moving = synthetic.spheres_4d(spark, 8).where("val < 200").groupBy("t").count()
    assert moving.count() == 8
