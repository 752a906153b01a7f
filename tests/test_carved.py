"""What is made of a carving, against plain versions over its rows."""

from __future__ import annotations

from fieldtopo.operators import carve
from fieldtopo.registry import QUERIES
from fieldtopo.sources import grids
from fieldtopo.sources.grids import LI


def test_clamps_files_and_values_follow_the_carving(spark, sf_dir):
    cells = grids.shipped(spark, sf_dir)
    val = {r.id: r.val for r in cells.collect()}
    made = {r.id: (r.order, r.new_val) for r in carve.merged(carve.carve(cells, ["z"], 10), "z").collect()}
    way = sorted(made, key=lambda i: made[i][0])
    assert [made[i][0] for i in way] == list(range(LI.n))
    up, most = {}, 0
    for i in way:
        up[i] = most = max(most, val[i])
    down, least = {}, 10**9
    for i in reversed(way):
        down[i] = least = min(least, val[i])
    assert {r.id: (r.order, r.up_val, r.down_val) for r in QUERIES["clamp_along_carving"](spark, sf_dir).collect()} == {i: (made[i][0], up[i], down[i]) for i in val}
    assert {r.id: (r.ord, r.new_val) for r in QUERIES["simplified_files"](spark, sf_dir).collect()} == made
    strict = {r.id: r.scaled for r in QUERIES["strict_carved_values"](spark, sf_dir).collect()}
    assert len(set(strict.values())) == LI.n and all(v // (2 * LI.n) == made[i][1] for i, v in strict.items())


def test_carving_a_series_leaves_fewer_criticals(spark, sf_dir):
    rows = QUERIES["carve_series"](spark, sf_dir).collect()
    assert len(rows) == 7 and sum(r.after for r in rows) < sum(r.before for r in rows)
