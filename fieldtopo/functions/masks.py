"""Bit arithmetic over neighbourhood masks, as column expressions: closures, Euler counts and the topology tests.

A 3-D mask holds the 26 neighbours of a cell: bit order z, then y, then x, the cell itself skipped. In the 27-bit layout bit
(dz+1)*9 + (dy+1)*3 + (dx+1) stands for a neighbour and bit 13, the cell, is clear. A 2-D mask holds the 8 neighbours in a slice likewise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSETS_3D = [(dx, dy, dz) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
OFFSETS_26 = [o for o in OFFSETS_3D if o != (0, 0, 0)]
OFFSETS_6 = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
OFFSETS_8 = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]
RING = [0, 1, 2, 4, 7, 6, 5, 3]  # the eight neighbours in a slice, walked around


def _bits(positions) -> int:
    return sum(1 << p for p in positions)


def _place(o: tuple[int, int, int]) -> int:
    return (o[2] + 1) * 9 + (o[1] + 1) * 3 + o[0] + 1


_DIM = {_place(o): 3 - sum(map(abs, o)) for o in OFFSETS_26}  # 2: face, 1: edge, 0: vertex
FACES, EDGES, VERTICES = (_bits(p for p, d in _DIM.items() if d == k) for k in (2, 1, 0))
ALL_27 = FACES | EDGES | VERTICES
_STEPS = [(1, _bits(p for p in range(27) if p % 3 < 2)), (3, _bits(p for p in range(27) if p // 3 % 3 < 2)), (9, _bits(p for p in range(27) if p < 18))]


def wide(mask: Column) -> Column:
    """26 bits to the 27-bit layout."""
    return mask.bitwiseAND(F.lit((1 << 13) - 1)).bitwiseOR(F.shiftleft(F.shiftright(mask, 13), 14))


def _shifted(m: Column, step: int, may: int) -> Column:
    """Bits moved one cell along an axis both ways, without leaving the block."""
    return F.shiftleft(m.bitwiseAND(F.lit(may)), step).bitwiseOR(F.shiftright(m, step).bitwiseAND(F.lit(may)))


def closed(mask: Column) -> Column:
    """27-bit mask closed under vertex connectivity: a marked face marks its edges, a marked edge its vertices."""
    m = mask

    def spread(m: Column, source: int, target: int) -> Column:
        part = m.bitwiseAND(F.lit(source))
        return m.bitwiseOR(reduce(Column.bitwiseOR, [_shifted(part, s, may) for s, may in _STEPS]).bitwiseAND(F.lit(target)))

    return spread(spread(m, FACES, EDGES), EDGES, VERTICES)


def euler(closed_mask: Column) -> Column:
    """Faces minus edges plus vertices of a closed 27-bit mask."""
    count = lambda which: F.bit_count(closed_mask.bitwiseAND(F.lit(which)))
    return (count(FACES) - count(EDGES) + count(VERTICES)).cast("long")


def connected(mask: Column) -> Column:
    """Whether the set bits of a 27-bit mask are one component under face steps. Empty: false."""
    lowest = mask.bitwiseAND(-mask)

    def grow(m: Column, _: Column) -> Column:
        near = reduce(Column.bitwiseOR, [_shifted(m, s, may) for s, may in _STEPS])
        return m.bitwiseOR(near.bitwiseAND(mask))

    return (mask != 0) & (F.aggregate(F.sequence(F.lit(1), F.lit(26)), lowest.cast("long"), grow) == mask)


def changes_topology(mask26: Column) -> Column:
    """Strict test: after closure, the marked and the unmarked cells around are not one component each."""
    m = closed(wide(mask26))
    rest = F.lit(ALL_27).bitwiseXOR(m)
    return ~(connected(m) & connected(rest))


def ring_transitions(mask8: Column) -> Column:
    """Changes between marked and unmarked around a cell in its slice, after marked edges have marked their vertices."""
    bit = lambda i: F.shiftright(mask8, RING[i % 8]).bitwiseAND(F.lit(1))
    # Even ring places are vertices, odd ones edges.
    ring = [F.greatest(bit(i), bit(i - 1), bit(i + 1)) if i % 2 == 0 else bit(i) for i in range(8)]
    return reduce(Column.__add__, [(ring[i] != ring[(i + 1) % 8]).cast("int") for i in range(8)])


def changes_topology_2d(mask8: Column) -> Column:
    """Slice test: the ring around the cell has other than two transitions."""
    return ring_transitions(mask8) != 2
