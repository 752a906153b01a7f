"""The topology tests over arrays of masks, as Arrow-batched functions of columns, and as a bitmap of all 2^26 masks.

The column expressions in `masks` unroll a flood of 26 steps, which is more than generated code holds; over arrays a step is one
operation for a batch, only distinct masks are looked at, and the flood ends when nothing grows. The bitmap (8 MiB, whatever the
data) is made once by Spark, 2^16 masks a row, and broadcast; a test is then one bit.

4-D masks hold the 80 neighbours of a cell, bit order t, z, y, x, the cell itself skipped, in two longs: `lo` has the 40 before
the cell and `hi` the 40 after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .masks import _STEPS, ALL_27, EDGES, FACES

CHUNK_BITS, TABLE_BITS = 16, 26


def _spread(m: np.ndarray) -> np.ndarray:
    """Cells one face step away from marked ones."""
    out = np.zeros_like(m)
    for step, may in _STEPS:
        out |= ((m & may) << step) | ((m >> step) & may)
    return out


def closed_27(m: np.ndarray) -> np.ndarray:
    m = m | (_spread(m & FACES) & EDGES)
    return m | (_spread(m & EDGES) & (ALL_27 & ~FACES & ~EDGES))


def connected_27(m: np.ndarray) -> np.ndarray:
    """Whether the marked cells are one face-connected part; none: false."""
    part = m & -m
    rows = np.flatnonzero(part != m)
    while len(rows):
        here = part[rows]
        more = (here | _spread(here)) & m[rows]
        part[rows] = more
        rows = rows[(more != here) & (more != m[rows])]
    return (m != 0) & (part == m)


def strict_array(mask26: np.ndarray) -> np.ndarray:
    """Strict test of 26-bit masks: after closure the marked and the unmarked cells are not one part each."""
    m = mask26.astype(np.int32)
    m = closed_27((m & ((1 << 13) - 1)) | ((m >> 13) << 14))
    out = ~connected_27(m)
    rest = np.flatnonzero(~out)
    out[rest] = ~connected_27(ALL_27 ^ m[rest])
    return out


def _of_distinct(test: Callable[[np.ndarray], np.ndarray], masks: pd.Series) -> pd.Series:
    values, where = np.unique(masks.to_numpy(np.int64), return_inverse=True)
    return pd.Series(test(values)[where])


def strict(mask26: Column) -> Column:
    """`masks.changes_topology` for volumes: evaluated a batch at a time."""

    @F.pandas_udf("boolean")
    def changes(m: pd.Series) -> pd.Series:
        return _of_distinct(strict_array, m)

    return changes(mask26)


def any_strict(masks: Column) -> Column:
    """Whether one of an array's masks changes topology; all of them go over in one pass."""

    @F.pandas_udf("boolean")
    def changes(m: pd.Series) -> pd.Series:
        flat = np.concatenate([np.zeros(0, np.int64), *m.to_list()])
        found = _of_distinct(strict_array, pd.Series(flat)).to_numpy(bool)
        ends = np.cumsum(m.str.len().to_numpy(np.int64))
        before = np.concatenate(([0], np.cumsum(found)))
        return pd.Series(np.diff(before[np.concatenate(([0], ends))]) > 0)

    return changes(masks)


def table_rows(spark: SparkSession, bits: int = TABLE_BITS) -> DataFrame:
    """(chunk, bits): the strict test of every mask below 2^bits, 2^16 masks a row, lowest bit first."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in pdf["id"]:
                found = strict_array(np.arange(c << CHUNK_BITS, (c + 1) << CHUNK_BITS, dtype=np.int64))
                yield pd.DataFrame({"chunk": [c], "bits": [np.packbits(found, bitorder="little").tobytes()]})

    n = 1 << max(0, bits - CHUNK_BITS)
    return spark.range(n).repartition(min(n, 64), "id").mapInPandas(work, "chunk long, bits binary")


@cache
def _table(application: str) -> object:
    spark = SparkSession.getActiveSession()
    rows, _ = written(table_rows(spark), "topology-table")  # 8 MiB; a lost executor costs no second run
    return spark.sparkContext.broadcast(b"".join(bytes(r.bits) for r in rows.orderBy("chunk").collect()))


def mask_table(spark: SparkSession) -> object:
    """The broadcast table, one bit a mask, lowest first; made at the first use in a session."""
    return _table(spark.sparkContext.applicationId)


def strict_by_table(spark: SparkSession, mask26: Column) -> Column:
    """The same by one bit of the table."""
    table = mask_table(spark)

    @F.pandas_udf("boolean")
    def changes(m: pd.Series) -> pd.Series:
        bits, at = np.frombuffer(table.value, np.uint8), m.to_numpy(np.int64)
        return pd.Series((bits[at >> 3] >> (at & 7) & 1).astype(bool))

    return changes(mask26)


# --- 4-D ---

OFFSETS_4D = [(dx, dy, dz, dt) for dt in (-1, 0, 1) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
OFFSETS_80 = [o for o in OFFSETS_4D if o != (0, 0, 0, 0)]
_LOW_13, _PAST = (1 << 13) - 1, (1 << 27) - 1
_OFF_Z = [sum(1 << i for i, o in enumerate(half) if o[2]) for half in (OFFSETS_80[:40], OFFSETS_80[40:])]


def _blocks(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(n, t, z, y, x) marks; the cell itself is never marked."""
    bits = np.arange(40, dtype=np.int64)
    before, after = (lo[:, None] >> bits) & 1, (hi[:, None] >> bits) & 1
    return np.concatenate((before, np.zeros((len(lo), 1), np.int64), after), axis=1).astype(bool).reshape(-1, 3, 3, 3, 3)


def _closed_4d(b: np.ndarray) -> np.ndarray:
    """A marked cell marks every cell of lower dimension on its border: along each axis the middle marks both ends."""
    b = b.copy()
    for axis in range(1, 5):
        v = np.moveaxis(b, axis, 0)
        v[0] |= v[1]
        v[2] |= v[1]
    return b


def _connected_4d(b: np.ndarray) -> np.ndarray:
    flat = b.reshape(len(b), 81)
    some = flat.any(axis=1)
    part = np.zeros_like(flat)
    part[np.arange(len(b)), flat.argmax(axis=1)] = some
    part = part.reshape(b.shape)
    while True:
        more = part.copy()
        for axis in range(1, 5):
            v, w = np.moveaxis(part, axis, 0), np.moveaxis(more, axis, 0)
            w[0] |= v[1]
            w[2] |= v[1]
            w[1] |= v[0] | v[2]
        more &= b
        if (more == part).all():
            return some & (part == b).reshape(len(b), 81).all(axis=1)
        part = more


def _signs() -> np.ndarray:
    """Signs (-1)^dimension of the 81 places (the cell itself 0); a place has as many dimensions as centred coordinates."""
    return np.array([0 if o == (0, 0, 0, 0) else (-1) ** o.count(0) for o in OFFSETS_4D])


def strict_4d_array(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Either side not one part, or the complement's Euler characteristic other than 1."""
    b = _closed_4d(_blocks(lo, hi))
    rest = ~b
    rest[:, 1, 1, 1, 1] = False
    chi = rest.reshape(len(rest), 81) @ _signs()
    return ~(_connected_4d(b) & _connected_4d(rest)) | (chi != 1)


def _of_pairs(test, lo: pd.Series, hi: pd.Series) -> pd.Series:
    keys, where = np.unique(np.column_stack((lo.to_numpy(np.int64), hi.to_numpy(np.int64))), axis=0, return_inverse=True)
    out = np.concatenate([test(keys[i : i + 8192, 0], keys[i : i + 8192, 1]) for i in range(0, max(len(keys), 1), 8192)])
    return pd.Series(out[where.ravel()])


def strict_4d(lo: Column, hi: Column) -> Column:
    @F.pandas_udf("boolean")
    def changes(a: pd.Series, b: pd.Series) -> pd.Series:
        return _of_pairs(strict_4d_array, a, b)

    return changes(lo, hi)


def euler_4d(lo: Column, hi: Column) -> Column:
    """The Euler characteristic of the closed mask."""

    @F.pandas_udf("long")
    def chi(a: pd.Series, b: pd.Series) -> pd.Series:
        return _of_pairs(lambda x, y: _closed_4d(_blocks(x, y)).reshape(len(x), 81) @ _signs(), a, b)

    return chi(lo, hi)


def slice_of_4d(lo: Column, hi: Column) -> Column:
    """The 26-bit mask of a cell's own time step."""
    return F.shiftright(lo, 27).bitwiseOR(F.shiftleft(hi.bitwiseAND(F.lit(_LOW_13)), 13))


def strict_in_step(lo: Column, hi: Column) -> Column:
    return strict(slice_of_4d(lo, hi))


def combo_4d(lo: Column, hi: Column) -> Column:
    """Critical in its step or in 4-D."""
    return strict_in_step(lo, hi) | strict_4d(lo, hi)


def thick_4d(lo: Column, hi: Column, right: bool) -> Column:
    """Critical in a pair of steps: the side that the pair lacks is all outside, or all inside. On the right of a pair the step
    before is the pair's other one, and takes the place of the step after."""
    if right:
        hi = hi.bitwiseAND(F.lit(_LOW_13)).bitwiseOR(F.shiftleft(lo.bitwiseAND(F.lit(_PAST)), 13))
    return strict_4d(lo.bitwiseAND(F.lit(~_PAST)), hi) | strict_4d(lo.bitwiseOR(F.lit(_PAST)), hi)


def flat_in_z(test: Callable[[Column, Column], Column], lo: Column, hi: Column) -> Column:
    """A test for series of planes: neighbours off the plane all outside, then all inside."""
    out, in_ = [lo.bitwiseAND(F.lit(~_OFF_Z[0])), hi.bitwiseAND(F.lit(~_OFF_Z[1]))], [lo.bitwiseOR(F.lit(_OFF_Z[0])), hi.bitwiseOR(F.lit(_OFF_Z[1]))]
    return test(*out) | test(*in_)
