"""Window trees: for every cell of a window of slices, what the component that ends in it is like.

The component of a cell v holds the cells of the window that rank at most as v and are joined with it by vertex neighbours. Along
the window's join tree (each cell's parent is the cell that next touches its component) these are subtree sums of terms that each
cell contributes once:
* cells and minima;
* overlaps: components of every slice (8 neighbours) that lie in it, a minimum of the slice's own join tree adding one and a merge
  taking away what it joins;
* the Euler characteristic: 1 less that of the lower link within the window;
* boundary contours: components above that a cell meets (face neighbours; the outside beyond the x and y borders is one), less
  the components below that it joins. One contour is the outer boundary, others are cavities.
Sweeps are sequential within a window, so a window is one group; everything that is asked of the sums is relational.
`enter` and `exit` number the tree in pre-order: u lies in the component of v where enter(v) <= enter(u) <= exit(v).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import any_strict
from ..functions.masks import OFFSETS_6, OFFSETS_8, OFFSETS_26, changes_topology_2d, closed, euler, wide
from .query import FIRST_SLICE, LAST_SLICE, link_terms, windows, within_window

NODES = "window_id int, node long, ord long, val long, critical boolean, parent long, n_cells long, n_minima long, overlaps array<long>, chi long, cavities long, enter long, exit long"


def critical_in_slices(mask: Column) -> Column:
    """Whether a cell is critical in its own slice or in the pair with the slice before or after (26-bit lower link)."""
    flat = F.shiftright(mask, 9).bitwiseAND(F.lit(255))
    pairs = F.array(*[m for far in (FIRST_SLICE, LAST_SLICE) for m in (mask.bitwiseAND(F.lit(~far)), mask.bitwiseOR(F.lit(far)))])
    return changes_topology_2d(flat) | any_strict(pairs)


class _Sweep:
    """Union-find in the order of a sweep: how many components each cell joins, and the last cell of each component."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, near: list[int]) -> set[int]:
        met = {self.find(j) for j in near}
        for r in met:
            self.root[r] = i
        return met


def _kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ord").reset_index(drop=True)
    n, places = len(pdf), list(zip(pdf["x"], pdf["y"], pdf["z"], strict=True))
    place = {c: i for i, c in enumerate(places)}
    near = lambda i, offsets: [place.get(tuple(a + d for a, d in zip(places[i], o, strict=True)), -1) for o in offsets]
    depth = int(pdf["last"].iloc[0] - pdf["first"].iloc[0]) + 1
    level = (pdf["z"] - pdf["first"]).to_numpy()

    join, flat = _Sweep(n), _Sweep(n)
    down, parent, in_slice = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros((n, depth), np.int64)
    for i in range(n):
        met = join.join(i, [j for j in near(i, OFFSETS_26) if 0 <= j < i])
        parent[list(met)] = i
        down[i] = len(met)
        in_slice[i, level[i]] = 1 - len(flat.join(i, [j for j in near(i, [(*o, 0) for o in OFFSETS_8]) if 0 <= j < i]))
    split, above = _Sweep(n + 1), np.zeros(n, np.int64)  # n: the outside
    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    border = (x == x.min()) | (x == x.max()) | (y == y.min()) | (y == y.max())
    for i in range(n - 1, -1, -1):
        above[i] = len(split.join(i, [j for j in near(i, OFFSETS_6) if j > i] + [n] * bool(border[i])))

    # Parents come after their children, so one pass up adds the sums and one pass down numbers the tree.
    sums = np.column_stack([np.ones(n, np.int64), pdf["minimum"].to_numpy().astype(np.int64), pdf["term"].to_numpy(), above - down, in_slice])
    size = sums[:, 0]
    for i in range(n):
        if parent[i] >= 0:
            sums[parent[i]] += sums[i]
    enter, free = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        enter[i] = free[parent[i]]
        free[parent[i]] += size[i]
        free[i] = enter[i] + 1
    ids = pdf["id"].to_numpy()
    out = pd.DataFrame({"window_id": pdf["window_id"], "node": ids, "ord": pdf["ord"], "val": pdf["val"], "critical": pdf["critical"], "parent": np.where(parent < 0, -1, ids[parent])})
    out = out.assign(n_cells=size, n_minima=sums[:, 1], overlaps=list(sums[:, 4:]), chi=sums[:, 2], cavities=sums[:, 3] - 1, enter=enter, exit=enter + size - 1)
    return out[[f.split()[0] for f in NODES.split(", ")]]


def window_nodes(cells: DataFrame, length: int, step: int, n_slices: int) -> DataFrame:
    """NODES of every window over (id, x, y, z, val, ord); `critical` marks the nodes of the reduced trees, parent is -1 at the top."""
    linked = link_terms(cells).withColumn("critical", critical_in_slices(F.col("mask")))
    inside, own = windows(linked, length, step, n_slices), within_window(F.col("mask"))
    rows = inside.select("window_id", "first", "last", "id", "x", "y", "z", "val", "ord", "critical", (1 - euler(closed(wide(own)))).alias("term"), (own == 0).alias("minimum"))
    return rows.groupBy("window_id").applyInPandas(_kernel, NODES)


def overlap(k: int) -> Column:
    """Components in the window's k-th slice (from the end, where negative)."""
    return F.element_at("overlaps", F.lit(k + 1 if k >= 0 else k))


def ends_between(low: int, high: int) -> Column:
    return overlap(0).between(low, high) & overlap(-1).between(low, high)


def within_ends(k: int) -> Column:
    """The k-th slice has a number of components between those of the ends."""
    return overlap(k).between(F.least(overlap(0), overlap(-1)), F.greatest(overlap(0), overlap(-1)))


def few_cavities(most: int) -> Column:
    return F.col("cavities").between(0, most)


def handles() -> Column:
    return 1 + F.col("cavities") - F.col("chi")


def outermost(nodes: DataFrame) -> DataFrame:
    """The nodes that no other listed node's component holds: those beyond the ends of all that come before them in pre-order."""
    before = Window.partitionBy("window_id").orderBy("enter").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("__end", F.max("exit").over(before)).where("__end IS NULL OR enter > __end").drop("__end")


def innermost(nodes: DataFrame) -> DataFrame:
    """The nodes whose component holds no other listed node."""
    after = F.lead("enter").over(Window.partitionBy("window_id").orderBy("enter"))
    return nodes.withColumn("__next", after).where("__next IS NULL OR __next > exit").drop("__next")
