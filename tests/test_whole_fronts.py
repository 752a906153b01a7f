"""Carving of many whole grids in step against the kernels that carve one cell by cell, and the jobs over every cell of their table."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest

from fieldtopo import registry
from fieldtopo.functions.arrays import mask_table
from fieldtopo.jobs import fronts
from fieldtopo.operators import sides, whole_fronts
from fieldtopo.operators.carve import strict_test
from fieldtopo.sources import grids
from fieldtopo.sources.grids import Dims


@pytest.fixture(scope="module")
def table(spark):
    return np.frombuffer(mask_table(spark).value, np.uint8)


def made(seed, dims, n, most):
    rng = np.random.default_rng(seed)
    val = rng.integers(-most, most + 1, (n, dims.n))
    return np.where(val == 0, 1, val), rng.random(val.shape) < 0.8


def frames(dims, val, known):
    i = np.arange(dims.n)
    return [pd.DataFrame({"id": i, "x": i % dims.nx, "y": i // dims.nx % dims.ny, "z": i // (dims.nx * dims.ny), "val": v, "known": k}) for v, k in zip(val, known, strict=True)]


def equal(got, g, want):
    return all((got[c][g] == want[c].to_numpy()).all() for c in got)


@pytest.mark.parametrize("dims,most,endless", [(Dims(5, 4, 4), 300, True), (Dims(5, 4, 4), 3, False), (Dims(6, 1, 5), 9, True), (Dims(8, 7, 6), 40, False), (Dims(1, 1, 1), 3, True)])
def test_life_spans_equal_single_grids(table, dims, most, endless):
    val, known = made(most, dims, 8, most)
    lives = []
    for inside in (True, False):
        got = whole_fronts.life_spans(val, known, dims, table, inside)
        forced = whole_fronts.life_spans(val, known, dims, table, inside, 2, got["life"])
        for g, pdf in enumerate(frames(dims, val, known)):
            assert equal(got, g, sides._life_spans(pdf, inside, None))
            assert equal(forced, g, sides._life_spans(pdf.assign(life=got["life"][g]), inside, 2))
        lives.append(got["life"].max())
    assert (max(lives) >= dims.n) >= endless


@pytest.mark.parametrize("which,features", [("io", 0), ("io", 3), ("i", 2), ("o", 0), ("o", 2), ("io", 40)])
@pytest.mark.parametrize("dims,most", [(Dims(5, 4, 4), 9), (Dims(6, 1, 5), 300), (Dims(8, 7, 6), 40), (Dims(1, 1, 1), 3)])
def test_fronts_equal_single_grids(table, dims, most, which, features):
    val, known = made(most + features, dims, 6, most)
    got = whole_fronts.two_sides(val, known, dims, table, which, features)
    assert all(equal(got, g, sides._two_sides(pdf, which, features)) for g, pdf in enumerate(frames(dims, val, known)))


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    """A few grids of shipments, among them rows without keys, dates or quantities."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    some = rows.where("l_orderkey < 1024").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    day, q = datetime.date(1997, 11, 3), dict(some.dtypes)["l_quantity"]
    odd = [(None, 5, 6, "7", day), (3, None, 6, "7", day), (4, 5, 6, "7", None), (700, 5, 6, None, day), (5000, 15, 15, "50", day)]
    made = spark.createDataFrame(odd, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity string, l_shipdate date")
    kinds = dict(some.dtypes)
    some.unionByName(made.selectExpr(*[f"cast({c} as {q if c == 'l_quantity' else kinds[c]}) as {c}" for c in made.columns])).write.parquet(f"{path}/lineitem.parquet")
    return path


def whole(spark, path):
    """Every cell of every grid, by grid."""
    cells = grids.shipped_blocks(spark, path).toPandas().sort_values("id")
    cells = cells.assign(known=cells["val"] > 0, val=2 * cells["val"] - (2 * fronts.LEVEL - 1))
    out = {None if pd.isna(k) else int(k): part.reset_index(drop=True) for k, part in cells.groupby("grid_id", dropna=False)}
    assert {len(p) for p in out.values()} == {grids.BLOCK.n}
    return out


def outside_criticals(pdf, order):
    g = sides._Grid(pdf)
    return sum(strict_test(sum(bit for bit, j in g.bits[i] if order[j] >= order[i])) for i in range(g.n))


def test_carving_by_side_takes_every_cell(spark, odd_dir):
    want = {}
    for k, pdf in whole(spark, odd_dir).items():
        pdf = pdf.assign(life=sides._life_spans(pdf, False, None)["life"])
        order = np.empty(len(pdf), int)
        order[np.lexsort((pdf["id"], -pdf["val"]))] = np.arange(len(pdf))
        want[k] = outside_criticals(pdf, order.tolist()), outside_criticals(pdf, sides._life_spans(pdf, False, fronts.LONG)["rank"].tolist())
    assert {r.grid_id: (r.before, r.after) for r in registry.QUERIES["carving_by_side"](spark, odd_dir).collect()} == want


def test_life_span_listing_takes_every_cell(spark, odd_dir):
    want = set()
    for k, pdf in whole(spark, odd_dir).items():
        spans = sides._life_spans(pdf, True, None)
        want |= {(k, *map(int, r)) for r in spans.loc[spans["life"] >= fronts.LONG, ["id", "life", "parent"]].to_numpy()}
    got = [tuple(r) for r in registry.QUERIES["life_span_listing"](spark, odd_dir).collect()]
    assert len(got) == len(want) and set(got) == want


def test_jobs_of_fronts_take_every_cell(spark, odd_dir):
    two, one, turned = {}, {}, {}
    for k, pdf in whole(spark, odd_dir).items():
        val = pdf["val"].to_numpy()
        out = sides._two_sides(pdf, "io", fronts.FEATURES + 2)
        inner, outer = ([abs(v) for _, v in sorted(zip(out["opened"][at], out["new_val"][at], strict=True))] for at in ((out["opened"] > 0) & (out["side"] == s) for s in (-1, 1)))
        extra, n = 0, fronts.FEATURES
        while len(inner) > n and len(outer) > n + extra and outer[n + extra] > inner[n]:
            extra += 1
        two[k] = (sum(out["side"] == -1), sum(out["side"] == 1), sum(out["opened"] > 0), sum(out["rank"] < 0), extra)
        for s, which in ((-1, "i"), (1, "o")):
            alone = sides._two_sides(pdf, which, 0)
            one[k, s] = (sum(alone["rank"] >= 0), sum(np.sign(alone["new_val"]) != np.sign(val)))
        out = sides._two_sides(pdf, "io", fronts.FEATURES)
        left = out["rank"] < 0
        new = np.where(left, 1 if sum(left & (out["new_val"] > 0)) > sum(left & (out["new_val"] < 0)) else -1, out["new_val"])
        turned[k] = (sum(np.sign(new) != np.sign(val)), sum(val < 0), sum(new < 0))
    collected = lambda name: [tuple(r) for r in registry.QUERIES[name](spark, odd_dir).collect()]
    assert {r[0]: r[1:] for r in collected("two_sided_carving")} == two
    assert {r[:2]: r[2:] for r in collected("one_sided_carving")} == one
    assert {r[0]: r[1:] for r in collected("fixed_by_fronts")} == turned
