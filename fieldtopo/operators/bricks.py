"""Join and split trees of volumes of any size, from bricks that are swept on their own and merged by levels.

A brick's sweep gives its augmented tree: each cell's next cell. What a larger region needs of it are the cells on faces that
other bricks touch, and the nodes where branches with such cells meet: `kept`, a number that grows with the surface. Eight regions
meet in one group, which sweeps their kept nodes over the reduced edges and the links across the faces; so levels go up to the whole.

Every other cell gets its place in one of two ways.
* Its component at its own rank has no face cell: nothing outside can come before its next node, so its branch is final.
* Otherwise it is `pending` between kept nodes: higher levels may put other cells before its next one. Level by level it looks for the
  highest node below its rank over the kept node under it (jumps of powers of two), until that node's branch is final.
Cells of one branch are then put in order of rank; each one's upper is the next, the last one's that of the branch's node.

No group is larger than a brick, eight regions' surfaces, or a bounded share of a region's pending cells with its surface.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import OFFSETS_26
from ..sources.grids import Dims
from ..sources.shared import forget, written

SIDE, SHARE, RANKS = 32, 1 << 18, 1 << 16
_LEVEL = "id long, ord long, x int, y int, z int, upper long, kept boolean, touches boolean, rep long, kept_upper long"
_PENDING = "id long, ord long, rep long, final boolean, branch long, branch_upper long"
_PLACE = ["bx", "by", "bz"]


def _sweep(n: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper node of each of n nodes in order of rank, over links (high, low)."""
    by = np.lexsort((low, high))
    root, up = list(range(n)), [-1] * n
    for i, j in zip(high[by].tolist(), low[by].tolist(), strict=True):
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        if j != i:
            up[j] = root[j] = i
    return np.array(up, np.int64)


def _reduced(up: np.ndarray, face: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kept, touches (the branch below holds a face cell), rep (highest kept node at or below) and kept_upper of a tree in rank order."""
    n, above = len(up), up.tolist()
    touches, arms, rep = face.tolist(), [0] * n, [-1] * n
    for i in range(n):
        if touches[i]:
            if face[i] or arms[i] > 1:
                rep[i] = i
            u = above[i]
            if u >= 0:
                touches[u] = True
                arms[u] += 1
                rep[u] = rep[i]  # of a node with one such arm; others keep themselves
    kept = [bool(f) or a > 1 for f, a in zip(face, arms, strict=True)]
    kept_upper = [-1] * n
    for i in range(n - 1, -1, -1):
        u = above[i]
        if u >= 0:
            kept_upper[i] = u if kept[u] else kept_upper[u]
    return np.array(kept, bool), np.array(touches, bool), np.array(rep, np.int64), np.array(kept_upper, np.int64)


def _on_face(x: np.ndarray, y: np.ndarray, z: np.ndarray, place: tuple[int, int, int], width: int, dims: Dims) -> np.ndarray:
    out = np.zeros(len(x), bool)
    for c, b, n in zip((x, y, z), place, dims[:3], strict=True):
        lo, hi = b * width, (b + 1) * width - 1
        if lo > 0:
            out |= c == lo
        if hi < n - 1:
            out |= c == hi
    return out


def _links(pdf: pd.DataFrame, offsets, dims: Dims, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (high, low) of neighbours among the rows (in rank order); apart: only between different values of it."""
    nx, ny = dims.nx + 2, dims.ny + 2  # a margin, so that no step wraps round
    key = ((pdf["z"].to_numpy(np.int64) + 1) * ny + pdf["y"].to_numpy(np.int64) + 1) * nx + pdf["x"].to_numpy(np.int64) + 1
    by = np.argsort(key)
    ordered = key[by]
    high, low = [], []
    for dx, dy, dz in offsets:
        want = key + (dz * ny + dy) * nx + dx
        at = np.minimum(np.searchsorted(ordered, want), len(key) - 1)
        j = by[at]
        i = np.flatnonzero((ordered[at] == want) & (j < np.arange(len(key))))
        j = j[i]
        if apart is not None:
            other = apart[i] != apart[j]
            i, j = i[other], j[other]
        high.append(i)
        low.append(j)
    return np.concatenate(high), np.concatenate(low)


def _rows(pdf: pd.DataFrame, up: np.ndarray, place, width: int, dims: Dims, keys: list[str]) -> pd.DataFrame:
    face = _on_face(*(pdf[a].to_numpy() for a in "xyz"), place, width, dims)
    kept, touches, rep, kept_upper = _reduced(up, face)
    ids = pdf["id"].to_numpy()
    name = lambda at: np.where(at < 0, -1, ids[at])
    out = {k: pdf[k] for k in [*keys, *_PLACE, "id", "ord", "x", "y", "z"]}
    return pd.DataFrame(out | {"upper": name(up), "kept": kept, "touches": touches, "rep": name(rep), "kept_upper": name(kept_upper)})


def _climb(pend: pd.DataFrame, tree: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """The highest node below each pending cell's rank over its kept node, and whether that node's branch is final."""
    tree = tree.sort_values("ord", kind="stable").reset_index(drop=True)
    ids, ranks = tree["id"].to_numpy(), tree["ord"].to_numpy()
    by = np.argsort(ids)
    place = lambda wanted: by[np.searchsorted(ids[by], wanted)]
    n = len(ids)
    upper = tree["upper"].to_numpy()
    up = np.where(upper < 0, n, place(np.maximum(upper, ids.min())) if n else 0)  # n: above all
    jumps, high = [np.append(up, n)], np.append(ranks, np.iinfo(np.int64).max)
    while (jumps[-1] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    at, rank = place(pend["rep"].to_numpy()), pend["ord"].to_numpy()
    for jump in reversed(jumps):
        to = jump[at]
        at = np.where(high[to] < rank, to, at)
    final = ~tree["touches"].to_numpy()[at]
    out = pend[[c for c in names if c in pend]].reset_index(drop=True)
    return out.assign(rep=np.where(final, -1, tree["rep"].to_numpy()[at]), final=final, branch=ids[at], branch_upper=upper[at])[names]


def tree(cells: DataFrame, dims: Dims, offsets=OFFSETS_26, keys: tuple[str, ...] = (), side: int = SIDE) -> DataFrame:
    """(keys, node, upper) of the augmented tree of every volume: `upper` is the next cell of the sweep that touches the component which
    ends in the node, null at the last. cells: (keys, id, x, y, z, ord), dense, each volume of the extent dims and ordered by ord."""
    keys = list(keys)
    types = dict(cells.dtypes)
    typed = "".join(f"{k} {types[k]}, " for k in keys)
    schema = f"{typed}bx int, by int, bz int, {_LEVEL}"
    at_level = lambda name, by: F.floor(F.col(name) / by).cast("int")

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        up = _sweep(len(pdf), *_links(pdf, offsets, dims))
        return _rows(pdf, up, tuple(int(pdf[b].iloc[0]) for b in _PLACE), side, dims, keys)

    def merge(width: int):
        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ord").reset_index(drop=True)
            place = {c: i for i, c in enumerate(pdf["id"])}
            above = pdf["kept_upper"].to_numpy()
            low = np.flatnonzero(above >= 0)
            high = np.array([place[u] for u in above[low].tolist()], np.int64)
            across = _links(pdf, offsets, dims, pdf["child"].to_numpy())
            up = _sweep(len(pdf), np.concatenate((high, across[0])), np.concatenate((low, across[1])))
            return _rows(pdf, up, tuple(int(pdf[b].iloc[0]) for b in _PLACE), width, dims, keys)

        return kernel

    fields = [f.split()[0] for f in f"{typed}bx int, by int, bz int, {_PENDING}".split(", ")]

    def look_up(pend: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        return _climb(pend, tree, fields) if len(pend) else pd.DataFrame({f: [] for f in fields})

    placed = cells.select(*keys, *[at_level(a, side).alias(f"b{a}") for a in "xyz"], "id", "ord", *[F.col(a).cast("int").alias(a) for a in "xyz"])
    now, path = written(placed.groupBy(*keys, *_PLACE).applyInPandas(leaf, schema), "bricks")
    paths, width = [path], side
    n = [-(-d // side) for d in dims[:3]]
    done, pend = [_final(now, keys)], _pending(now, keys)
    while max(n) > 1:
        n, width = [-(-k // 2) for k in n], width * 2
        child = (F.col("bx") % 2 + F.col("by") % 2 * 2 + F.col("bz") % 2 * 4).cast("int").alias("child")
        nodes = now.where("kept").select(*keys, *[at_level(b, 2).alias(b) for b in _PLACE], child, "id", "ord", "x", "y", "z", "kept_upper")
        now, path = written(nodes.groupBy(*keys, *_PLACE).applyInPandas(merge(width), schema), "bricks")
        # Pending cells meet their region's tree in shares, each several times as large as the tree that it takes along.
        shares = max(1, width**3 // max(SHARE, 24 * width * width))
        place = [*keys, *_PLACE, "share"]
        up = pend.select(*keys, *[at_level(b, 2).alias(b) for b in _PLACE], "id", "ord", "rep").withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int"))
        trees = now.select(*keys, *_PLACE, "id", "ord", "upper", "touches", "rep", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
        looked = up.groupBy(*place).cogroup(trees.groupBy(*place)).applyInPandas(look_up, f"{typed}bx int, by int, bz int, {_PENDING}")
        looked, pend_path = written(looked, "bricks-pending")
        paths += [path, pend_path]
        done += [_final(now, keys), looked.where("final").select(*keys, "id", "ord", "branch", "branch_upper")]
        pend = _pending(now, keys).unionByName(looked.where("not final").select(*keys, *_PLACE, "id", "ord", "rep"))

    # Each branch in order of rank, by blocks of ranks, so that a branch of most cells is no single task.
    rows = reduce(DataFrame.unionByName, done).withColumn("block", F.floor(F.col("ord") / RANKS))
    branch = [*keys, "branch"]
    within = rows.withColumn("next", F.lead("id").over(Window.partitionBy(*branch, "block").orderBy("ord")))
    first = rows.groupBy(*branch, "block").agg(F.min_by("id", "ord").alias("first"))
    after = first.select(*branch, "block", F.lead("first").over(Window.partitionBy(*branch).orderBy("block")).alias("after"))
    upper = F.coalesce("next", "after", F.nullif(F.col("branch_upper"), F.lit(-1)))
    edges, _ = written(within.join(after, [*branch, "block"]).select(*keys, F.col("id").alias("node"), upper.alias("upper")), "bricks-edges")
    forget(cells, *paths)
    return edges


def _final(level: DataFrame, keys: list[str]) -> DataFrame:
    return level.where("not touches").select(*keys, "id", "ord", F.col("id").alias("branch"), F.col("upper").alias("branch_upper"))


def _pending(level: DataFrame, keys: list[str]) -> DataFrame:
    return level.where("touches and not kept").select(*keys, *_PLACE, "id", "ord", "rep")
