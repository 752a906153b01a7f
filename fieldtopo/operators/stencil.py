"""Neighbourhoods of dense grids by three window passes, one along each axis.

A pass sorts rows of one line of cells and takes the cell before and after, so a 3x3x3 neighbourhood costs three shuffles of n
rows; joining every cell with its 26 neighbours would move 26 n.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import OFFSETS_80
from ..functions.masks import OFFSETS_6, OFFSETS_8, OFFSETS_26


def _pass(df: DataFrame, value: str, along: str, others: list[str], width: int, kind: str) -> DataFrame:
    w = Window.partitionBy(*others).orderBy(along)
    blank = F.array(*[F.lit(None).cast(kind)] * width)
    before, after = F.coalesce(F.lag(value).over(w), blank), F.coalesce(F.lead(value).over(w), blank)
    return df.withColumn(value, F.concat(before, F.col(value), after))


def block(df: DataFrame, value: str, extra: tuple[str, ...] = (), axes: str = "xyz", name: str = "around") -> DataFrame:
    """df with `name`: the values of the 3^k block around each cell (null outside the grid), x fastest; axes "xyzt" for a series of volumes. extra: keys as grid_id or t."""
    kind = dict(df.dtypes)[value]
    out, width = df.withColumn(name, F.array(F.col(value))), 1
    every = "xyzt" if "t" in axes else "xyz"
    for axis in axes:
        out = _pass(out, name, axis, [*extra, *[a for a in every if a != axis]], width, kind)
        width *= 3
    return out


def at(o: tuple[int, ...], name: str = "around") -> Column:
    """The block's value at an offset (dx, dy[, dz])."""
    return F.get(F.col(name), F.lit(sum((d + 1) * 3**i for i, d in enumerate(o))))


def lower_mask(order: str, offsets=OFFSETS_26, name: str = "around", outside: bool = False) -> Column:
    """Bit i is set where neighbour i has a lower rank; neighbours outside the grid count as `outside`."""
    bits = [F.when(F.coalesce(at(o, name) < F.col(order), F.lit(outside)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, o in enumerate(offsets)]
    return reduce(Column.bitwiseOR, bits)


def lower_mask_4d(order: str, name: str = "around") -> tuple[Column, Column]:
    """The 80-bit mask of a block with time, in two longs."""
    return lower_mask(order, OFFSETS_80[:40], name), lower_mask(order, OFFSETS_80[40:], name)


def slice_mask(order: str, name: str = "around", outside: bool = False) -> Column:
    return lower_mask(order, OFFSETS_8, name, outside)


def total(offsets=OFFSETS_6, name: str = "around", default: Column | None = None) -> Column:
    """Sum over neighbours; outside the grid the default (else 0)."""
    return reduce(Column.__add__, [F.coalesce(at(o, name), default if default is not None else F.lit(0)) for o in offsets])
