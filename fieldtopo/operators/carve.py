"""Topology-controlled re-ordering of bounded groups: cells join in order of value unless that changes the group's topology.

The order of acceptance is sequential within a group (a slice, or a volume block), so it is a grouped kernel; groups are
independent and run in parallel. `merged` puts the orders of slices together to one without a sequential step.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import OFFSETS_80, strict_4d_array
from ..functions.masks import _STEPS, ALL_27, EDGES, FACES, OFFSETS_8, OFFSETS_26, RING, VERTICES
from .order import numbered


@cache
def flat_test(mask: int) -> bool:
    """Whether adding a cell with that slice mask changes topology (ring of marked places, edges marking vertices)."""
    bit = [mask >> p & 1 for p in RING]
    ring = [b if i % 2 else max(b, bit[i - 1], bit[(i + 1) % 8]) for i, b in enumerate(bit)]
    return sum(ring[i] != ring[i - 1] for i in range(8)) != 2


def _spread(m: int) -> int:
    """Bits one face step away from marked ones."""
    out = 0
    for step, may in _STEPS:
        out |= (m & may) << step | m >> step & may
    return out


def _one_part(m: int) -> bool:
    part = m & -m
    while part != m:
        more = (part | _spread(part)) & m
        if more == part:
            return False
        part = more
    return m != 0


@cache
def strict_test(mask: int) -> bool:
    """The same for 26 neighbours: once faces have marked their edges and edges their vertices, either side must be one face-connected part."""
    m = mask & (1 << 13) - 1 | mask >> 13 << 14
    m |= _spread(m & FACES) & EDGES
    m |= _spread(m & EDGES) & VERTICES
    return not (_one_part(m) and _one_part(ALL_27 ^ m))


def combo_test(mask: int) -> bool:
    """Critical in the slice or in the volume."""
    return flat_test(mask >> 9 & 255) or strict_test(mask)


@cache
def strict_4d_test(mask: int) -> bool:
    """The strict test of an 80-bit mask."""
    return bool(strict_4d_array(np.array([mask & (1 << 40) - 1], np.int64), np.array([mask >> 40], np.int64))[0])


def combo_4d_test(mask: int) -> bool:
    """Critical in the cell's own step or in 4-D."""
    return strict_test(mask >> 27 & (1 << 26) - 1) or strict_4d_test(mask)


def carve(cells: DataFrame, keys: list[str], feature: int, test: Callable[[int], bool] = flat_test, top: int = 65535) -> DataFrame:
    """(keys, id, ord, new_val) from cells (keys, id, x, y[, z[, t]], val); the test says in how many dimensions cells are neighbours.

    All cells wait in a queue by (value, stamp, id), with the latest stamp of all. The first is taken. One that would change the
    topology is put back with its value one higher, until it is `feature` above its own value and is taken anyway. When a cell is taken,
    neighbours that wait no more as themselves (they were put back) are queued once more at the current value, stamped with the
    number taken so far; such an entry, when refused, is queued again only if a cell was taken since its stamp. Values are clamped to top.
    """
    axes, offsets = ("xy", OFFSETS_8) if test is flat_test else ("xyzt", OFFSETS_80) if test in (strict_4d_test, combo_4d_test) else ("xyz", OFFSETS_26)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        places = list(zip(*(pdf[a] for a in axes), strict=True))
        place = {p: i for i, p in enumerate(places)}
        near = [[place.get(tuple(a + d for a, d in zip(p, o, strict=True))) for o in offsets] for p in places]
        data, ids, n = pdf["val"].tolist(), pdf["id"].tolist(), len(pdf)
        rank, value, queued, taken = [-1] * n, list(data), [True] * n, 0
        last = n + 1
        heap = [(data[i], last, ids[i], i) for i in range(n)]
        heapq.heapify(heap)
        while heap:
            v, stamp, _, i = heapq.heappop(heap)
            queued[i] = False
            if rank[i] >= 0:
                continue
            mask = sum(1 << b for b, j in enumerate(near[i]) if j is not None and rank[j] >= 0)
            if taken and test(mask) and not (stamp == last and abs(v - data[i]) >= feature):
                if stamp == last:
                    heapq.heappush(heap, (v + 1, last, ids[i], i))
                elif stamp < taken:
                    heapq.heappush(heap, (v, taken, ids[i], i))
                continue
            rank[i], value[i] = taken, v if not taken else max(0, min(v, top))
            taken += 1
            if taken > 1:  # the first cell queues none
                for j in near[i]:
                    if j is not None and rank[j] < 0 and not queued[j]:
                        heapq.heappush(heap, (v, taken, ids[j], j))
                        queued[j] = True
        return pd.DataFrame({k: pdf[k] for k in keys} | {"id": ids, "ord": rank, "new_val": value})

    types = dict(cells.dtypes)
    return cells.select(*dict.fromkeys([*keys, "id", *axes, "val"])).groupBy(*keys).applyInPandas(kernel, ", ".join([*(f"{k} {types[k]}" for k in keys), "id long", "ord long", "new_val long"]))


def merged(carved: DataFrame, slice_key: str) -> DataFrame:
    """carved slices with `order`: one order of all, by new value, then slice, then place in the slice."""
    return numbered(carved, [F.col("new_val"), F.col(slice_key), F.col("ord")], "order")
