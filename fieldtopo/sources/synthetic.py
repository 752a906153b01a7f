"""Test fields in closed form: boxes, spheres, tori, letters and a square ring, as (id, x, y, z[, t], val). Values of distances are in thousandths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grids import Dims, coordinates

# The twelve boxes of the 31 x 31 x 7 test volume, as start x, y, z and length x, y, z.
BOXES = [
    (0, 0, 0, 30, 6, 6), (0, 24, 0, 30, 6, 6), (0, 0, 0, 6, 30, 6), (24, 0, 0, 6, 30, 6),
    (9, 15, 3, 1, 1, 1), (10, 8, 3, 1, 1, 1), (20, 19, 3, 1, 1, 1), (14, 14, 3, 3, 1, 1),
    (14, 16, 3, 3, 1, 1), (14, 14, 3, 1, 3, 1), (16, 14, 3, 1, 3, 1), (4, 4, 3, 22, 22, 1),
]
# Radii of the eight spheres at +-8 along each axis, in the order of the signs +++, ++-, +-+, +--, -++, -+-, --+, ---.
RADII = [8.4, 7.2, 6.8, 7.4, 5.4, 6.0, 5.8, 7.8]
# 4 x 4 slices in the shape of letters, in tenths.
LETTERS = {
    "C": [-8, -8, -8, -8, -8, 6, 6, -8, -8, 6, 6, 2, -8, -8, -8, -8],
    "O": [-8, -8, -8, -8, -8, 6, 6, -8, -8, 6, 6, -8, -8, -8, -8, -8],
    "G": [-8, -8, -8, 6, -8, 6, -5, 4, -8, 6, 4, -5, -8, -8, -8, -8],
}


def _cells(spark: SparkSession, dims: Dims) -> DataFrame:
    return spark.range(dims.n).select("id", *coordinates(dims))


def _distance(*centre: tuple[str, Column | float]) -> Column:
    return F.sqrt(sum(((F.col(a) - c) * (F.col(a) - c) for a, c in centre), F.lit(0.0)))


def box(start: tuple[int, ...], length: tuple[int, ...]) -> Column:
    """Whether a cell lies in a box."""
    x, y, z = (F.col(a).between(s, s + n - 1) for a, s, n in zip("xyz", start, length, strict=True))
    return x & y & z


def boxes(spark: SparkSession, dims: Dims = Dims(31, 31, 7), parts=BOXES) -> DataFrame:
    """1 everywhere, -1 in the boxes."""
    inside = F.lit(False)
    for b in parts:
        inside = inside | box(b[:3], b[3:])
    return _cells(spark, dims).withColumn("val", F.when(inside, -1).otherwise(1).cast("long"))


def sphere(radius: float, x: float, y: float, z: float) -> Column:
    """Signed distance to a sphere: negative inside."""
    return _distance(("x", x), ("y", y), ("z", z)) - radius


def torus(ring: float, tube: float, x: float, y: float, z: float) -> Column:
    """Signed distance to a torus around an axis along z."""
    flat = _distance(("x", x), ("y", y)) - ring
    return F.sqrt(flat * flat + (F.col("z") - z) * (F.col("z") - z)) - tube


def field(spark: SparkSession, dims: Dims, distance: Column) -> DataFrame:
    return _cells(spark, dims).withColumn("val", F.floor(1000 * distance).cast("long"))


def spheres_4d(spark: SparkSession, n: int = 16) -> DataFrame:
    """n^4 cells of the unit cube and time: the distance to the nearest of three points, of which one moves along x with t."""
    u = {a: F.col(a) / (n - 1) for a in "xyzt"}

    def to(x, y, z):
        return F.sqrt((u["x"] - x) * (u["x"] - x) + (u["y"] - y) * (u["y"] - y) + (u["z"] - z) * (u["z"] - z))

    return field(spark, Dims(n, n, n, n), F.least(to(0.25, 0.75, 0.25), to(0.75, 0.75, 0.25), to(0.25 + u["t"] * 0.5, 0.25, 0.25)))


def eight_spheres(spark: SparkSession, n: int = 32) -> DataFrame:
    """The least signed distance to eight spheres of different sizes, one in each octant."""
    m, step = n / 2, n / 4
    centres = [(m + sx * step, m + sy * step, m + sz * step) for sx in (1, -1) for sy in (1, -1) for sz in (1, -1)]
    return field(spark, Dims(n, n, n), F.least(*[sphere(r * n / 32, *c) for r, c in zip(RADII, centres, strict=True)]))


def disc(spark: SparkSession, n: int = 64) -> DataFrame:
    """Distance to (28, 37) over the side, on one slice."""
    return field(spark, Dims(n, n, 1), _distance(("x", 28.0), ("y", 37.0)) / (n - 1))


def letters(spark: SparkSession, word: str = "COG") -> DataFrame:
    """A letter a slice."""
    rows = [(16 * z + i, i % 4, i // 4, z, v) for z, k in enumerate(word) for i, v in enumerate(LETTERS[k])]
    return spark.createDataFrame(rows, "id long, x int, y int, z int, val long")


def square_ring(spark: SparkSession, dims: Dims = Dims(20, 10, 20)) -> DataFrame:
    """1 on a square ring that stands on its corner at y = 5, else 0: seeds for a distance."""
    on = (F.col("y") == 5) & (F.abs(F.col("x") - 10) + F.abs(F.col("z") - 10) == 8)
    return _cells(spark, dims).withColumn("val", on.cast("long"))
