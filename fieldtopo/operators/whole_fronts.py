"""Carving from the sides (see `sides`) in many dense grids of one extent at once, each grid whole.

The order of carving is sequential within a grid, so the grids of a batch go in step: every step takes the next cell of each grid's queue,
tests all of these by one bit of the table of masks, and carves those that pass, each an operation over arrays. Cells lie in a frame of one
cell around the grid, so neighbours are at fixed distances. Results are those of the kernels in `sides`, cell by cell.

A queue is an array of keys (level, then cell) with the least of every RUN beside it. In life spans a cell that was refused as critical comes
back a level further each time, while each of its neighbours that is carved queues it again at its own level: that entry is the one that
finds a changed neighbourhood, so the entries put back are refused and only count. They are not queued here: how far they have come
when the cell is carved follows from the largest key taken meanwhile.

Values are never 0 and less than 2^48 in magnitude.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import mask_table
from ..functions.masks import OFFSETS_26
from ..sources.grids import Dims
from .whole_grids import dense_values, shifted

RUN, NONE = 64, np.iinfo(np.int64).max
TOGETHER = 256  # grids in step
ALL = np.int32((1 << 26) - 1)
BITS = np.array([1 << b for b in range(26)], np.int32)
BACK = BITS[::-1].copy()  # a cell's bit in its neighbour's mask


class _Frame:
    """Places of a grid's cells in its frame, in order of id; distances of neighbours, and which of a cell's neighbours are in the grid."""

    def __init__(self, dims: Dims):
        wide, high = dims.nx + 2, dims.ny + 2
        z, y, x = np.meshgrid(*(np.arange(1, n + 1) for n in (dims.nz, dims.ny, dims.nx)), indexing="ij")
        self.at = ((z * high + y) * wide + x).ravel()
        self.size = -(-wide * high * (dims.nz + 2) // RUN) * RUN
        self.steps = np.array([(dz * high + dy) * wide + dx for dx, dy, dz in OFFSETS_26])
        self.bits = self.size.bit_length()
        there = np.zeros(self.size, bool)
        there[self.at] = True
        self.inside = np.zeros(self.size, np.int32)
        self.inside[self.at] = (there[self.at[:, None] + self.steps] * BITS).sum(axis=1)
        self.border = self.inside[self.at] != ALL

    def spread(self, a: np.ndarray, fill, kind) -> np.ndarray:
        """(grids, cells) in frames, flat."""
        out = np.full((len(a), self.size), fill, kind)
        out[:, self.at] = a
        return out.ravel()

    def cells(self, a: np.ndarray) -> np.ndarray:
        return a.reshape(-1, self.size)[:, self.at]


_frame = cache(_Frame)


class _Queues:
    def __init__(self, places: int, size: int):
        self.key, self.least = np.full(places, NONE), np.full(places // RUN, NONE)
        self.by_run, self.by_grid = self.key.reshape(-1, RUN), self.least.reshape(-1, size // RUN)

    def push(self, at: np.ndarray, key: np.ndarray) -> None:
        self.key[at] = key
        np.minimum.at(self.least, at // RUN, key)

    def drop(self, at: np.ndarray) -> None:
        """Of one cell a grid at most."""
        self.key[at] = NONE
        run = at // RUN
        self.least[run] = self.by_run[run].min(axis=1)

    def next(self) -> np.ndarray:
        return self.by_grid.min(axis=1)


def by_table(table: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The strict test of masks."""
    return (table[mask >> 3] >> (mask & 7).astype(np.uint8) & 1).astype(bool)


def two_sides(val: np.ndarray, known: np.ndarray, dims: Dims, table: np.ndarray, sides: str = "io", features: int = 0) -> dict[str, np.ndarray]:
    """side, rank, opened and new_val of cells (grid, id), as `sides.carve_sides` has them."""
    f, grids = _frame(dims), len(val)
    first, cell = np.arange(grids) * f.size, np.arange(f.size)
    size = np.abs(val)
    largest_first = np.unique(-size, return_inverse=True)[1].reshape(val.shape)
    key = f.spread(largest_first << (f.bits + 1), 0, np.int64) | np.tile(cell, grids)  # the inner front's keys have one bit more
    inner = 1 << f.bits
    # which fronts a cell may wait for (1 inner, 2 outer); none while it waits, once it is carved, and in the frame
    may = f.spread(np.where(known, np.where(val < 0, 1, 2), 3), 0, np.int8)
    refused = may.copy()  # what it may wait for once it is refused
    own = f.spread(np.where(val < 0, -1, 1), 0, np.int8)
    rank, side, opened = (np.full(grids * f.size, x, t) for x, t in ((-1, np.int32), (0, np.int8), (0, np.int8)))
    whole = np.concatenate((np.full(grids * f.size, ALL), np.tile(f.inside, grids)))  # by front: neighbours that are not carved, or the other's
    taken, openings = np.zeros(grids, np.int32), np.zeros(grids, np.int32)
    queues = _Queues(grids * f.size, f.size)

    def carve(at: np.ndarray, outer: np.ndarray, how) -> None:
        """Cells of one grid each; outer: 1 for the outer front, else 0."""
        g = at // f.size
        rank[at], side[at], own[at], opened[at], may[at] = taken[g], 2 * outer - 1, 2 * outer - 1, how, 0
        taken[g] += 1
        near = at[:, None] + f.steps
        whole[near + (outer * (grids * f.size))[:, None]] ^= BACK
        row, col = np.nonzero(may[near] >> outer.astype(np.int8)[:, None] & 1)
        to, outer = near[row, col], outer[row]
        may[to], refused[to], own[to] = 0, 1 + outer, 2 * outer - 1
        queues.push(to, key[to] + (1 - outer) * inner)

    if "o" in sides:
        to = (first[:, None] + f.at)[f.border & ((val > 0) | ~known)]
        may[to] = 0
        queues.push(to, key[to])
    if "i" in sides and val.size:
        at = first + f.at[np.argmin(val, axis=1)]
        queues.drop(at)
        carve(at, np.zeros(grids, np.int64), 0)
    done = np.zeros(grids, bool)
    while True:
        top = queues.next()
        some = top != NONE
        rests = np.flatnonzero(~some & ~done)
        if len(rests):  # both fronts rest: each side that can opens a feature
            done[rests[openings[rests] >= features]] = True
            rests = rests[openings[rests] < features]
            openings[rests] += 1
            more = np.zeros(len(rests), bool)
            for outer in (o for o, k in ((0, "i"), (1, "o")) if k in sides):
                left = (own.reshape(grids, -1)[rests] == 2 * outer - 1) & (rank.reshape(grids, -1)[rests] < 0)
                best = np.where(left, key.reshape(grids, -1)[rests], NONE).argmin(axis=1)
                has = left[np.arange(len(rests)), best]
                at = (first[rests] + best)[has]
                if len(at):
                    carve(at, np.full(len(at), outer), openings[rests[has]])
                more |= has
            done[rests[~more]] = True
            top = queues.next()
            some = top != NONE
        if not some.any():
            if done.all():
                break
            continue
        g = np.flatnonzero(some)
        top = top[g]
        at, outer = first[g] + (top & (inner - 1)), 1 - (top >> f.bits & 1)
        queues.drop(at)
        mask = whole[at + outer * (grids * f.size)]
        keeps = ~by_table(table, np.where(outer == 1, mask, ALL ^ mask))
        may[at[~keeps]] = refused[at[~keeps]]
        carve(at[keeps], outer[keeps], 0)
    return {"side": f.cells(side), "rank": f.cells(rank), "opened": f.cells(opened), "new_val": f.cells(own) * size}


def fixed(made: dict[str, np.ndarray]) -> np.ndarray:
    """New values of cells (grid, id), as `sides.fixed` has them: those that no front took go to the side opposite to most of them."""
    new, left = made["new_val"], made["rank"] < 0
    more = (left & (new > 0)).sum(axis=1) > (left & (new < 0)).sum(axis=1)
    return np.where(left, np.where(more, 1, -1)[:, None], new)


def ranked(val: np.ndarray) -> np.ndarray:
    """Places of cells (grid, id) by value, then id."""
    out = np.empty(val.shape, np.int32)
    np.put_along_axis(out, np.argsort(val, axis=1, kind="stable"), np.arange(val.shape[1], dtype=np.int32)[None], 1)
    return out


def later_mask(order: np.ndarray, dims: Dims, least: int) -> np.ndarray:
    """Bit i is set where neighbour i is in the grid and comes at least so many places later."""
    o = order.reshape(-1, dims.nz, dims.ny, dims.nx).astype(np.int32)
    out = np.zeros(o.shape, np.int32)
    for i, step in enumerate(OFFSETS_26):
        out |= (shifted(o, step, -1) >= o + least).astype(np.int32) << i
    return out.reshape(order.shape)


def criticals(order: np.ndarray, dims: Dims, table: np.ndarray) -> np.ndarray:
    """Critical cells of each grid by the outside rule, in an order in which cells may share a place."""
    return by_table(table, later_mask(order, dims, 0)).sum(axis=1)


def _most_between(keys: np.ndarray, grid: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The largest of keys[after + 1 .. upto] of a grid, keys being (step, grid), for spans of a step or more. keys are used up."""
    out, most = np.empty(len(grid), np.int64), keys
    size = np.frexp(upto - after)[1] - 1  # 2^size is the largest power of two in the span
    for k in range(int(size.max(initial=-1)) + 1):
        if k:
            half = 1 << k - 1
            np.maximum(most[:-half], most[half:], out=most[:-half])  # of 2^k steps, where there are so many
        here = size == k
        out[here] = np.maximum(most[after[here] + 1, grid[here]], most[upto[here] + 1 - (1 << k), grid[here]])
    return out


def life_spans(val: np.ndarray, known: np.ndarray, dims: Dims, table: np.ndarray, inside: bool = True, least: int | None = None, life: np.ndarray | None = None, parents: bool = True) -> dict[str, np.ndarray]:
    """rank, parent (the cell itself where not asked for) and life of cells (grid, id), as `sides.life_spans` has them; with `least` and `life` as
    `sides.carve_by_life`."""
    f, (grids, n) = _frame(dims), val.shape
    first, cell = np.arange(grids) * f.size, np.tile(np.arange(f.size), grids)
    low = (1 << f.bits) - 1
    base = f.spread(val if inside else -val, 0, np.int64)
    key = base << f.bits | cell
    free = f.spread(np.ones(val.shape, bool), False, bool)  # neither queued nor carved
    rank, parent = np.full(grids * f.size, -1, np.int32), cell.astype(np.int32)
    spans = least is None
    marked = f.spread(by_table(table, later_mask(ranked(val), dims, 1)) if spans else life >= least, False, bool)  # critical at first; else forced
    left = np.full(grids * f.size, ALL) if inside else np.tile(f.inside, grids)  # neighbours that are not carved
    refused, carved = (np.full(grids * f.size, -1, np.int32) for _ in range(2))  # the steps when it first was
    taken, end, steps = np.zeros(grids, np.int32), np.full(grids, NONE), []
    queues = _Queues(grids * f.size, f.size)

    def carve(at: np.ndarray) -> None:
        g = at // f.size
        rank[at], carved[at] = taken[g], len(steps)
        taken[g] += 1
        free[at] = False
        near = at[:, None] + f.steps
        left[near] ^= BACK
        row, col = np.nonzero(free[near])
        to = near[row, col]
        if inside:
            parent[to] = cell[at][row]
        elif parents:
            row, col = np.nonzero((rank[near] < 0) & (f.inside[near % f.size] != 0))
            parent[near[row, col]] = cell[at][row]
        free[to] = False
        queues.push(to, key[to])

    if inside and val.size:
        carve(first + f.at[np.argmin(val, axis=1)])
    if not inside:
        to = (first[:, None] + f.at)[f.border & ((val > 0) | ~known)]
        free[to] = False
        queues.push(to, key[to])
    over = np.full(grids, np.iinfo(np.int64).min)  # the key at which a life span came to the number of cells
    while True:
        top = queues.next()
        for g in np.flatnonzero(end < top):
            own = slice(first[g], first[g] + f.size)
            waits = np.flatnonzero((refused[own] >= 0) & (rank[own] < 0))
            end[g] = (key[own][waits] + (n - 1 << f.bits)).min() if len(waits) else NONE
            if end[g] < top[g]:  # endless: the grid's carving is over
                over[g] = end[g]
                queues.by_grid[g], top[g], end[g] = NONE, NONE, NONE
        g = np.flatnonzero((top != NONE) & (over == np.iinfo(np.int64).min))
        if not len(g):
            break
        at = first[g] + (top[g] & low)
        queues.drop(at)
        keeps = ~by_table(table, ALL ^ left[at] if inside else left[at])
        if spans:
            back = ~keeps & marked[at] & (refused[at] < 0)
            refused[at[back]] = len(steps)
            end[g[back]] = np.minimum(end[g[back]], key[at[back]] + (n - 1 << f.bits))
            steps.append(np.where(top == NONE, np.iinfo(np.int64).min, top))
        else:
            keeps |= marked[at]
        free[at[~keeps]] = True
        carve(at[keeps])
    if spans:
        life = np.zeros(grids * f.size, np.int64)
        at = np.flatnonzero(refused >= 0)
        g = at // f.size
        last = np.where(rank[at] < 0, len(steps), carved[at]) - 1  # carve() has counted the step already
        after = refused[at]
        some = last > after
        most = np.full(len(at), np.iinfo(np.int64).min)
        if some.any():
            most[some] = _most_between(np.array(steps), g[some], after[some], last[some])
        most = np.where(rank[at] < 0, np.maximum(most, over[g]), most)
        level = (most >> f.bits) + (cell[at] <= (most & low))
        life[at] = np.maximum(level - base[at], 1)
        life = f.cells(life)
    place = np.zeros(f.size, np.int64)
    place[f.at] = np.arange(n)
    ranks = f.cells(rank)
    return {"rank": np.where(ranks < 0, n - 1, ranks), "parent": place[f.cells(parent)], "life": life}


def by_grid(spark, sparse: DataFrame, dims: Dims, work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """(grid_id, schema) from the cells that are not 0 (grid_id, id, val), dealt out by grid_id. work: from the values (grid, id) of a batch and
    the table of masks to the places of grids in the batch and a column for each name of the schema."""
    table = mask_table(spark)
    lists = sparse.groupBy("grid_id").agg(F.collect_list("id").alias("ids"), F.collect_list("val").alias("vals"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                grid, made = work(dense_values(part, dims), bits)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(grid)), *[pa.array(made[n]) for n in names]], ["grid_id", *names])

    return lists.mapInArrow(run, f"grid_id long, {schema}")
