"""Isosurfaces by marching cubes: case rows joined to cubes, vertices keyed by grid edge.

The case table is made by rule. On a cube's face the surface cuts off every run of corners above; so corners below stay joined across
diagonals, on both sides of a face alike. The cuts on the six faces follow each other in loops. A loop becomes triangles without a
diagonal on a face (the neighbouring cube might use it too). Two loops around opposite corners below are one tube: corners below
that share the cube's middle are joined as well, as vertex neighbours are everywhere else. Normals point from below to above.

The grid gets a margin of one cell, which is above, so surfaces are closed. Bit x + 2y + 4z of a case stands for a cube's corner.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.grids import Dims

CORNERS = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
EDGES = [(a, a | 1 << axis, axis) for axis in range(3) for a in range(8) if not a >> axis & 1]  # lower corner, upper corner, axis
_EDGE_OF = {frozenset(e[:2]): k for k, e in enumerate(EDGES)}
# A face's corners in turn, seen from outside: for the side 0 of an axis the other way round than for the side 1.
_FACES = [[c | side << axis for c in (ring if side else ring[::-1])] for axis in range(3) for side in (0, 1) for ring in [[0, 1 << (axis + 1) % 3, 1 << (axis + 1) % 3 | 1 << (axis + 2) % 3, 1 << (axis + 2) % 3]]]
_FACES_OF = [frozenset(f for f, ring in enumerate(_FACES) if a in ring and b in ring) for a, b, _ in EDGES]


def _loops(case: int) -> list[list[int]]:
    """Directed loops of cut edges."""
    below = [bool(case >> c & 1) for c in range(8)]
    after = {}
    for ring in _FACES:
        for k in range(4):
            if below[ring[k]] and not below[ring[(k + 1) % 4]]:
                j = k + 1
                while not below[ring[(j + 1) % 4]]:
                    j += 1
                after[_EDGE_OF[frozenset((ring[j % 4], ring[(j + 1) % 4]))]] = _EDGE_OF[frozenset((ring[k], ring[(k + 1) % 4]))]
    out = []
    while after:
        loop = [min(after)]
        while (n := after.pop(loop[-1])) != loop[0]:
            loop.append(n)
        out.append(loop)
    return out


def _fans(loop: list[int]) -> list[tuple[int, int, int]] | None:
    """Triangles of a loop whose inner edges lie on no face of the cube; None where there are none."""
    if len(loop) < 3:
        return []
    first, last = loop[0], loop[-1]
    for k in range(1, len(loop) - 1):
        sides = [(first, loop[k])] * (k > 1) + [(loop[k], last)] * (k < len(loop) - 2)
        if any(_FACES_OF[a] & _FACES_OF[b] for a, b in sides):
            continue
        left, right = _fans(loop[: k + 1]), _fans(loop[k:])
        if left is not None and right is not None:
            return [(first, loop[k], last), *left, *right]
    return None


def _tube(case: int, loops: list[list[int]]) -> list[tuple[int, int, int]]:
    """Between two loops around opposite corners: each step of a loop goes with the cut that lies between its ends on the ring of corners above."""
    above = lambda e: next(c for c in EDGES[e][:2] if not case >> c & 1)
    out = []
    for mine, theirs in (loops, loops[::-1]):
        for p, q in zip(mine, [*mine[1:], mine[0]], strict=True):
            (b,) = [e for e in theirs if all((above(e) ^ above(o)).bit_count() == 1 for o in (p, q))]
            out.append((p, q, b))
    return out


@cache
def triangles_of(case: int) -> list[tuple[int, int, int]]:
    """Triangles of cut edges (indices of EDGES) of a case."""
    loops = _loops(case)
    if len(loops) == 2 and bin(case).count("1") == 2:
        low = [c for c in range(8) if case >> c & 1]
        if low[0] ^ low[1] == 7:
            return _tube(case, loops)
    out = []
    for loop in loops:
        found = next((f for f in (_fans(loop[k:] + loop[:k]) for k in range(len(loop))) if f is not None), None)
        if found is None:
            raise AssertionError(f"case {case}: no triangles inside the cube")
        out += found
    return out


def padded(dims: Dims) -> Dims:
    return Dims(dims.nx + 2, dims.ny + 2, dims.nz + 2)


def corner_offset(dims: Dims, corner: int) -> int:
    """From the lattice id of a cube to that of its corner, on the grid with its margin."""
    x, y, z = CORNERS[corner]
    return (z * (dims.ny + 2) + y) * (dims.nx + 2) + x


def case_rows(dims: Dims) -> list[tuple[int, int, int, int, int]]:
    """(cfg, k, da, db, dc): vertex ids less three times the cube's id. A vertex is an edge of the grid: 3 * (its lower corner) + axis."""
    key = [3 * corner_offset(dims, a) + axis for a, _, axis in EDGES]
    return [(case, k, *(key[e] for e in tri)) for case in range(256) for k, tri in enumerate(triangles_of(case))]


def with_margin(cells: DataFrame, dims: Dims, outside: int, columns: tuple[str, ...] = ("val",)) -> DataFrame:
    """(id, x, y, z, columns) on the lattice with its margin, which is filled with `outside` (further columns: null)."""
    big = padded(dims)
    at = ((F.col("z") + 1) * big.ny + F.col("y") + 1) * big.nx + F.col("x") + 1
    inner = cells.select(at.cast("long").alias("id"), *columns)
    c = F.col("id")
    place = [(c % big.nx).cast("int").alias("x"), (F.floor(c / big.nx) % big.ny).cast("int").alias("y"), F.floor(c / big.slice).cast("int").alias("z")]
    every = cells.sparkSession.range(big.n).select("id", *place)
    return every.join(inner, "id", "left").withColumn("val", F.coalesce("val", F.lit(outside)))


def _corners(lattice: DataFrame, value: str) -> DataFrame:
    """lattice with `near`: the values at a cube's eight corners, by three passes that look ahead along an axis."""
    from pyspark.sql import Window

    out = lattice.withColumn("near", F.array(value))
    for axis in "xyz":
        w = Window.partitionBy(*[a for a in "xyz" if a != axis]).orderBy(axis)
        out = out.withColumn("near", F.concat("near", F.lead("near").over(w)))  # null at the far margin: no cube there
    return out.where("near IS NOT NULL")


def surface(lattice: DataFrame, dims: Dims, iso: int) -> DataFrame:
    """(t, a, b, c): triangles of the isosurface over lattice (id, x, y, z, val) with its margin."""
    cubes = _corners(lattice.withColumn("below", (F.col("val") < iso).cast("int")), "below")
    cfg = sum((F.element_at("near", i + 1) * (1 << i) for i in range(8)), F.lit(0))
    table = lattice.sparkSession.createDataFrame(case_rows(dims), "cfg int, k int, da long, db long, dc long")  # at most 256 x 6 rows
    rows = cubes.select("id", cfg.alias("cfg")).where(~F.col("cfg").isin(0, 255)).join(F.broadcast(table), "cfg")
    return rows.select((F.col("id") * 8 + F.col("k")).alias("t"), *[(3 * F.col("id") + F.col(f"d{v}")).alias(v) for v in "abc"])


def vertices(lattice: DataFrame, iso: int, label: str | None = None) -> DataFrame:
    """(v, x, y, z[, label]): where the surface cuts grid edges, in cells of the grid without its margin; label: the union of both ends'."""
    from pyspark.sql import Window

    parts = []
    for axis, name in enumerate("xyz"):
        w = Window.partitionBy(*[a for a in "xyz" if a != name]).orderBy(name)
        far = F.lead("val").over(w)
        both = lattice.withColumn("far", far)
        if label:
            both = both.withColumn("label", F.col(label).bitwiseOR(F.lead(label).over(w)))
        cut = both.where((F.col("val") < iso) != (F.col("far") < iso))
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (iso - F.col("val")) / (F.col("far") - F.col("val"))))
        place = [(F.col(a) - 1 + (along if a == name else F.lit(0.0))).alias(a) for a in "xyz"]
        parts.append(cut.select((3 * F.col("id") + axis).alias("v"), *place, *(["label"] if label else [])))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def masked(val: Column, outside: Column, known: Column, carved: Column | None = None, side: int = 1) -> tuple[Column, Column]:
    """A value whose sign follows masks, and its suspect label. Without a carving: a known cell takes the sign of `outside`, an unknown
    one stays and is suspect. With one: a carved cell takes it, suspect where unknown; an uncarved one on `side`, or unknown, is put
    slightly to the other side and is suspect; others stay as they are, not suspect."""
    signed = F.abs(val) * F.when(outside, 1).otherwise(-1)
    if carved is None:
        return F.when(known, signed).otherwise(val), F.when(known, 0).otherwise(1)
    on_side = F.signum(val) == side
    value = F.when(carved, signed).when(on_side | ~known, F.lit(-0.5 * side)).otherwise(val)
    return value, F.when(carved, F.when(known, 0).otherwise(1)).when(on_side | ~known, 1).otherwise(0)


def without_holes(tris: DataFrame, labels: DataFrame) -> DataFrame:
    """Triangles of which no vertex is labelled; labels: (v, label)."""
    marked = labels.where("label > 0").select("v")
    for corner in "abc":
        tris = tris.join(marked.withColumnRenamed("v", corner), corner, "left_anti")
    return tris
