"""Carving from the sides of a surface: from inside, from outside, from both at once, and with life spans.

Values are negative inside and positive outside. A front takes the cells next to what it has carved, by falling magnitude (of equal
ones the smaller id), and carves those that leave the topology of its side alone: the strict test over what is not carved or belongs
to the other side; beyond the grid counts as outside. A carved cell gets the front's sign, and so do its neighbours once they wait.
When both fronts rest, up to `features` times a side may open a feature: its largest cell that is not carved is, whatever the topology.

Life spans carve a filtration instead: the front takes cells by value, from the least one inside or from the positive or unknown border cells
outside. A cell that was critical in the filtration to begin with and would change the topology now is put back a step further each
time, and its life span counts the steps; a span that reaches the number of cells has no end.

An order of carving is sequential within a grid, so a grid of bounded size is a group; grids run in parallel.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from ..functions.masks import OFFSETS_26
from .carve import strict_test

ALL, LAST = (1 << 26) - 1, 1 << 25
CARVED = "id long, side int, rank long, opened int, new_val long"
SPANS = "id long, rank long, parent long, life long"


@lru_cache(maxsize=8)
def _neighbours(x: bytes, y: bytes, z: bytes) -> tuple[list, list, list]:
    """Of cells by row number: neighbours as (bit in the cell's mask, row), their rows, and the bits of those beyond the grid. Grids of one
    extent share them."""
    places = list(zip(*(np.frombuffer(a, np.int64).tolist() for a in (x, y, z)), strict=True))
    at = {p: i for i, p in enumerate(places)}
    steps = [(1 << b, o) for b, o in enumerate(OFFSETS_26)]
    near = [[(bit, at.get((x + dx, y + dy, z + dz))) for bit, (dx, dy, dz) in steps] for x, y, z in places]
    inside = [tuple((bit, j) for bit, j in row if j is not None) for row in near]
    return inside, [tuple(j for _, j in row) for row in inside], [sum(bit for bit, j in row if j is None) for row in near]


class _Grid:
    """Cells of a group by row number, in order of id; neighbours with their bits in masks, and the bits of those beyond the grid."""

    def __init__(self, pdf: pd.DataFrame):
        self.ids = pdf["id"].tolist()
        self.bits, self.near, self.beyond = _neighbours(*(pdf[a].to_numpy(np.int64).tobytes() for a in "xyz"))
        self.val = pdf["val"].tolist()
        self.border = [m > 0 for m in self.beyond]
        self.n = len(self.ids)


def _two_sides(pdf: pd.DataFrame, sides: str, features: int) -> pd.DataFrame:
    pdf = pdf.sort_values("id").reset_index(drop=True)
    g = _Grid(pdf)
    val, known = list(g.val), pdf["known"].tolist()
    rank, side, opened, queued, taken = [-1] * g.n, [0] * g.n, [0] * g.n, [False] * g.n, 0
    fronts: dict[int, list[tuple[int, int]]] = {-1: [], 1: []}

    def wait(i: int, s: int) -> None:
        heapq.heappush(fronts[s], (-abs(val[i]), i))
        queued[i] = True

    def carve(i: int, s: int, how: int = 0) -> None:
        nonlocal taken
        rank[i], side[i], opened[i], known[i], val[i] = taken, s, how, True, s * abs(val[i])
        taken += 1
        for j in g.near[i]:
            if rank[j] < 0 and not queued[j] and (val[j] * s > 0 or not known[j]):
                wait(j, s)
                known[j], val[j] = True, s * abs(val[j])

    def changes(i: int, s: int) -> bool:
        whole = g.beyond[i] if s < 0 else 0
        for bit, j in g.bits[i]:
            if rank[j] < 0 or (known[j] and val[j] * s < 0):
                whole |= bit
        return strict_test(ALL ^ whole if s < 0 else whole)

    if "o" in sides:
        for i in range(g.n):
            if g.border[i] and (val[i] > 0 or not known[i]):
                wait(i, 1)
    if "i" in sides and g.n:
        carve(min(range(g.n), key=lambda i: (val[i], i)), -1)
    for opening in range(features + 1):
        while fronts[-1] or fronts[1]:
            # The larger magnitude goes first; of equal ones the outside.
            s = -1 if fronts[-1] and (not fronts[1] or fronts[-1][0][0] < fronts[1][0][0]) else 1
            _, i = heapq.heappop(fronts[s])
            queued[i] = False
            if rank[i] < 0 and not changes(i, s):
                carve(i, s)
        if opening == features:
            break
        more = 0
        for s in [s for s, k in ((-1, "i"), (1, "o")) if k in sides]:
            left = [i for i in range(g.n) if rank[i] < 0 and val[i] * s > 0]
            if left:
                carve(min(left, key=lambda i: (-abs(val[i]), i)), s, opening + 1)
                more += 1
        if not more:
            break
    return pd.DataFrame({"id": g.ids, "side": side, "rank": rank, "opened": opened, "new_val": val})


def _life_spans(pdf: pd.DataFrame, inside: bool, least: int | None) -> pd.DataFrame:
    pdf = pdf.sort_values("id").reset_index(drop=True)
    g = _Grid(pdf)
    n, val, known = g.n, g.val, pdf["known"].tolist()
    way = 1 if inside else -1  # the queue falls in value outside
    first = np.argsort(np.asarray(val), kind="stable")
    order = np.empty(n, int)
    order[first] = np.arange(n)
    place = order.tolist()
    once = [strict_test(sum([bit for bit, j in g.bits[i] if place[j] > place[i]])) for i in range(n)]
    left = [ALL if inside else ALL ^ m for m in g.beyond]  # of every cell: its neighbours that are not carved
    rank, parent, queued, taken, endless = [-1] * n, list(range(n)), [False] * n, 0, False
    life = [0] * n if least is None else pdf["life"].tolist()
    queue: list[tuple[int, int]] = []

    def changes(i: int) -> bool:
        return strict_test(ALL ^ left[i] if inside else left[i])

    def carve(i: int) -> None:
        nonlocal taken
        rank[i] = taken
        taken += 1
        for bit, j in g.bits[i]:
            left[j] ^= LAST // bit  # the cell's bit in the neighbour's mask: bits run the other way
            if rank[j] >= 0:
                continue
            if not queued[j]:
                heapq.heappush(queue, (way * val[j], j))
                queued[j] = True
                if inside:
                    parent[j] = i
            if not inside:
                parent[j] = i

    if inside and n:
        carve(int(first[0]))
    if not inside:
        for i in range(n):
            if g.border[i] and (val[i] > 0 or not known[i]):
                heapq.heappush(queue, (-val[i], i))
                queued[i] = True
    while queue and not endless:
        at, i = heapq.heappop(queue)
        queued[i] = False
        if rank[i] >= 0:
            continue
        forced = least is not None and life[i] >= least
        if forced or not changes(i):
            carve(i)
        elif least is None and once[i] and (life[i] == 0 or at != way * val[i]):
            life[i] += 1
            heapq.heappush(queue, (way * val[i] + life[i], i))
            endless = life[i] >= n
    return pd.DataFrame({"id": g.ids, "rank": [r if r >= 0 else n - 1 for r in rank], "parent": [g.ids[p] for p in parent], "life": life})


def _by_grid(cells: DataFrame, keys: list[str], columns: list[str], kernel, schema: str) -> DataFrame:
    types = dict(cells.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(pdf)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(out) for k in keys} | {c: out[c] for c in out})

    typed = "".join(f"{k} {types[k]}, " for k in keys)
    return cells.select(*keys, "id", "x", "y", "z", "val", "known", *columns).groupBy(*keys).applyInPandas(run, typed + schema)


def carve_sides(cells: DataFrame, keys: list[str], features: int = 0, sides: str = "io") -> DataFrame:
    """(keys, CARVED) of grids (keys, id, x, y, z, val, known): the front that took a cell (-1 inside, 1 outside, 0 none), its rank over both
    fronts (-1: never), in which opening it was carved against the topology (0: it was not), and its value with the sign it got.
    sides: "i", "o" or both. The inner front begins with the least cell."""
    return _by_grid(cells, keys, [], lambda pdf: _two_sides(pdf, sides, features), CARVED)


def extra_features(carved: DataFrame, keys: list[str], features: int) -> DataFrame:
    """(keys, extra): how many features the outside opens beyond `features` that are larger than the inside's first beyond; 0 where a side opens fewer."""
    from pyspark.sql import functions as F

    size = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.when(F.col("opened") > 0, F.struct("opened", F.abs("new_val").alias("m")))))), lambda e: e["m"])
    lists = carved.groupBy(*keys).agg(size(-1).alias("inner"), size(1).alias("outer"))  # at most as many as were opened
    return lists.select(*keys, extra(F.col("inner"), F.col("outer"), features).alias("extra"))


def extra(inner: Column, outer: Column, features: int) -> Column:
    """The same of the magnitudes of the features that each side opened, in their order."""
    from pyspark.sql import functions as F

    bar = F.get(inner, F.lit(features))
    beyond = F.slice(outer, features + 1, F.greatest(F.size(outer) - features, F.lit(0)))
    run = F.aggregate(beyond, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, m: F.struct((a["n"] + F.when(a["on"] & (m > bar), 1).otherwise(0)).alias("n"), (a["on"] & (m > bar)).alias("on")))
    enough = (F.size(inner) > features) & (F.size(outer) >= features)
    return F.when(enough, run["n"]).otherwise(0)


def fixed(carved: DataFrame, keys: list[str], side: int = 0) -> DataFrame:
    """(keys, id, fixed): new values, in which a cell that no front took has the sign opposite to `side`; 0 leaves the side to the cells
    left: the inner one (-1) where more of them are positive, else the outer one."""
    from pyspark.sql import functions as F

    left = F.col("rank") < 0
    more = carved.groupBy(*keys).agg((F.count_if(left & (F.col("new_val") > 0)) > F.count_if(left & (F.col("new_val") < 0))).alias("more"))
    own = F.lit(side) if side else F.when(F.col("more"), -1).otherwise(1)
    return carved.join(more, keys).select(*keys, "id", F.when(left, -own).otherwise(F.col("new_val")).cast("long").alias("fixed"))


def life_spans(cells: DataFrame, keys: list[str], inside: bool = True) -> DataFrame:
    """(keys, SPANS): rank of carving (that of the last cell for those never carved), the cell that a cell was queued by, and its life span."""
    return _by_grid(cells, keys, [], lambda pdf: _life_spans(pdf, inside, None), SPANS)


def carve_by_life(cells: DataFrame, keys: list[str], least: int, inside: bool = True) -> DataFrame:
    """The same for cells with `life`: those that live at least so long are carved whatever the topology."""
    return _by_grid(cells, keys, ["life"], lambda pdf: _life_spans(pdf, inside, least), SPANS)
