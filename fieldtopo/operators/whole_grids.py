"""Many grids of one bounded extent, each whole in one row, a batch of them at a time over arrays.

A grid arrives as the list of its cells that are not 0, so a shuffle moves the table's rows and never the dense grid, its ranks or its
neighbourhoods. Arrays are (grid, z, y, x); cells are ordered by value, then id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import closed_27
from ..functions.masks import EDGES, FACES, OFFSETS_6, OFFSETS_8, OFFSETS_26, VERTICES
from ..sources.grids import Dims
from .carve import flat_test

TOGETHER = 64  # grids in one array


def dense_values(part: pa.RecordBatch, dims: Dims) -> np.ndarray:
    """Values (grid, id) from rows of lists (grid_id, ids, vals)."""
    ids, vals = part.column(1), part.column(2)
    grid = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(ids.offsets)))
    val = np.zeros((part.num_rows, dims.n), np.int64)
    val[grid, np.asarray(ids.flatten())] = np.asarray(vals.flatten())
    return val


def summarised(sparse: DataFrame, dims: Dims, kernel: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """(grid_id, the kernel's longs) from cells (grid_id, id, val) dealt out by grid_id. The kernel gets ranks and gives one number a grid."""
    lists = sparse.groupBy("grid_id").agg(F.collect_list("id").alias("ids"), F.collect_list("val").alias("vals"))
    names = list(kernel(np.zeros((0, dims.nz, dims.ny, dims.nx), np.int32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                val = dense_values(part, dims)
                ranks = np.empty(val.shape, np.int32)
                np.put_along_axis(ranks, np.argsort(val, axis=1, kind="stable"), np.arange(dims.n, dtype=np.int32)[None], 1)
                made = kernel(ranks.reshape(-1, dims.nz, dims.ny, dims.nx))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(made[n], pa.int64()) for n in names]], ["grid_id", *names])

    return lists.mapInArrow(work, ", ".join(["grid_id long", *[f"{n} long" for n in names]]))


def shifted(a: np.ndarray, o: tuple[int, int, int], beyond: int) -> np.ndarray:
    """Each cell's neighbour at an offset (dx, dy, dz)."""
    out = np.full_like(a, beyond)
    cut = lambda d: (slice(max(0, -d), None if d <= 0 else -d), slice(max(0, d), None if d >= 0 else d))
    to, of = zip(*(cut(d) for d in reversed(o)), strict=True)
    out[(slice(None), *to)] = a[(slice(None), *of)]
    return out


def lower_mask(ranks: np.ndarray, offsets=OFFSETS_26) -> np.ndarray:
    """Bit i is set where neighbour i has a lower rank."""
    top, out = np.iinfo(ranks.dtype).max, np.zeros(ranks.shape, np.int32)
    for i, o in enumerate(offsets):
        out |= (shifted(ranks, o, top) < ranks).astype(np.int32) << i
    return out


def _sum(a: np.ndarray) -> np.ndarray:
    return a.sum(axis=(1, 2, 3), dtype=np.int64)


@cache
def _flat() -> np.ndarray:
    return np.array([flat_test(m) for m in range(256)])


def slice_criticals(ranks: np.ndarray) -> dict[str, np.ndarray]:
    mask = lower_mask(ranks, [(dx, dy, 0) for dx, dy in OFFSETS_8])
    return {"n_critical": _sum(_flat()[mask]), "n_minima": _sum(mask == 0), "n": _sum(np.ones_like(mask))}


def link_euler(ranks: np.ndarray) -> dict[str, np.ndarray]:
    mask = lower_mask(ranks)
    m = closed_27((mask & ((1 << 13) - 1)) | ((mask >> 13) << 14))
    count = lambda which: np.bitwise_count(m & which).astype(np.int64)
    return {"chi": _sum(1 - (count(FACES) - count(EDGES) + count(VERTICES))), "n_minima": _sum(mask == 0)}


def arms(ranks: np.ndarray, offsets=OFFSETS_26) -> np.ndarray:
    """How many components of the cells before it each cell touches: its children in the tree of the sweep by rank.

    Every cell descends by its lowest neighbour to a minimum, which its component holds from then on. Only cells beside several
    minima's basins can touch several components, so the sweep goes over those, with the basins as its elements."""
    n = int(np.prod(ranks.shape[1:]))
    beside = np.stack([shifted(ranks, o, n) for o in offsets]).reshape(len(offsets), len(ranks), n)
    flat = ranks.reshape(-1, n)
    down = np.empty((len(flat), n), np.int32)  # by rank
    np.put_along_axis(down, flat, np.minimum(flat, beside.min(axis=0)), 1)
    while True:
        beyond = np.take_along_axis(down, down, 1)
        if (beyond == down).all():
            break
        down = beyond
    down = np.concatenate((down, np.full((len(down), 1), n, np.int32)), axis=1)
    rows = np.arange(len(flat))[:, None]
    lower = beside < flat
    basins = np.where(lower, down[rows, np.where(lower, beside, n)], n)
    least, most = basins.min(axis=0), np.where(lower, basins, -1).max(axis=0)
    out = (least < n).astype(np.int64)
    for g in range(len(flat)):
        several = np.flatnonzero((most[g] > least[g]) & (least[g] < n))
        several = several[np.argsort(flat[g][several])]
        root = list(range(n + 1))
        for i, row in zip(several.tolist(), basins[:, g, several].T.tolist(), strict=True):
            found = set()
            for b in set(row):
                if b < n:
                    while root[b] != b:
                        root[b] = root[root[b]]
                        b = root[b]
                    found.add(b)
            out[g, i] = len(found)
            to = found.pop()
            for b in found:
                root[b] = to
    return out.reshape(ranks.shape)


def tree_classes(ranks: np.ndarray) -> dict[str, np.ndarray]:
    n = int(np.prod(ranks.shape[1:]))
    down, up = arms(ranks, OFFSETS_26), arms((n - 1 - ranks).astype(np.int32), OFFSETS_6)
    return {"minima": _sum(down == 0), "maxima": _sum(up == 0), "merges": _sum(down > 1), "splits": _sum(up > 1), "regular": _sum((up == 1) & (down == 1))}
