"""Topology tests against plain graph searches and known table values."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fieldtopo.functions import masks
from fieldtopo.operators.carve import flat_test, strict_test


def _components(cells: set, near) -> int:
    cells, n = set(cells), 0
    while cells:
        n += 1
        stack = [cells.pop()]
        while stack:
            for c in near(stack.pop()) & cells:
                cells.discard(c)
                stack.append(c)
    return n


def _strict(mask: int) -> bool:
    marked = {o for i, o in enumerate(masks.OFFSETS_26) if mask >> i & 1}
    closed = {q for q in masks.OFFSETS_26 if any(all(a in (0, b) for a, b in zip(p, q, strict=True)) for p in marked)}
    near = lambda p: {q for q in masks.OFFSETS_26 if sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1}
    return _components(closed, near) != 1 or _components(set(masks.OFFSETS_26) - closed, near) != 1


def test_slice_cases_have_the_known_counts(spark):
    counts = {r.t: r["count"] for r in spark.range(256).groupBy(masks.ring_transitions(F.col("id")).alias("t")).count().collect()}
    assert counts == {0: 17, 2: 116, 4: 102, 6: 20, 8: 1}
    changing = sorted(r.id for r in spark.range(256).where(masks.changes_topology_2d(F.col("id"))).collect())
    assert changing == [i for i in range(256) if flat_test(i)] and len(changing) == 140


def test_strict_test_equals_graph_search(spark):
    rng = random.Random(7)
    sample = [0, 2**26 - 1, *(rng.getrandbits(26) & rng.getrandbits(26) for _ in range(300)), *(rng.getrandbits(26) | rng.getrandbits(26) for _ in range(150)), *(1 << i for i in range(26))]
    rows = spark.createDataFrame([(m,) for m in sample], "m long").select("m", masks.changes_topology(F.col("m")).alias("c")).distinct().collect()
    assert all(r.c == _strict(r.m) == strict_test(r.m) for r in rows)
    assert {r.m: r.c for r in rows}[0] and {r.m: r.c for r in rows}[2**26 - 1]


def test_euler_of_connected_links(spark):
    """Faces - edges + vertices equals marked minus unmarked components plus one, where there are both (duality)."""
    rng = random.Random(8)
    near = lambda p: {q for q in masks.OFFSETS_26 if sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1}
    sample = [rng.getrandbits(26) & rng.getrandbits(26) & rng.getrandbits(26) for _ in range(200)]
    for r in spark.createDataFrame([(m,) for m in sample], "m long").select("m", masks.closed(masks.wide(F.col("m"))).alias("k"), masks.euler(masks.closed(masks.wide(F.col("m")))).alias("e")).collect():
        marked = {o for o in masks.OFFSETS_26 if r.k >> masks._place(o) & 1}
        rest = set(masks.OFFSETS_26) - marked
        if marked and rest:
            assert r.e == _components(marked, near) - _components(rest, near) + 1
