"""Jobs over carving from the sides, in every grid that grows with the tables: fronts, features, life spans, criticals before and after."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import sides, whole_fronts
from ..sources import grids
from ..sources.grids import BLOCK
from .blocks import LEVEL
from .common import job

FEATURES, LONG = 2, 5


def by_grid(spark, sf_dir, work, schema):
    """The work on (values, known, table of masks) of whole grids, below a level inside; cells without any shipment are unknown."""
    sparse = grids.sparse_blocks(spark, sf_dir).withColumn("id", F.when(F.col("grid_id").isNotNull(), F.col("id"))).withColumn("val", F.when(F.col("id").isNotNull(), F.col("val")))
    return whole_fronts.by_grid(spark, sparse, BLOCK, lambda val, table: work(2 * val - (2 * LEVEL - 1), val > 0, table), schema)


@job()
def two_sided_carving(spark, sf_dir):
    """Cells of every grid that the inner and the outer front carve, features opened, cells left, and the features that the outside seems to have beyond."""

    def work(val, known, table):
        made = whole_fronts.two_sides(val, known, BLOCK, table, "io", FEATURES + 2)
        opened = [_opened(made, s) for s in (-1, 1)]
        counts = {"inner": made["side"] == -1, "outer": made["side"] == 1, "opened": made["opened"] > 0, "left": made["rank"] < 0}
        return np.arange(len(val)), {k: v.sum(axis=1) for k, v in counts.items()} | dict(zip(("inner_sizes", "outer_sizes"), opened, strict=True))

    counts = by_grid(spark, sf_dir, work, "inner long, outer long, opened long, left long, inner_sizes array<long>, outer_sizes array<long>")
    return counts.select("grid_id", "inner", "outer", "opened", "left", sides.extra(F.col("inner_sizes"), F.col("outer_sizes"), FEATURES).alias("extra"))


def _opened(made, side):
    """Magnitudes of the features that a front opened in each grid, in their order."""
    rows = ((made["opened"] > 0) & (made["side"] == side)).nonzero()
    size, turn = np.abs(made["new_val"][rows]), made["opened"][rows]
    return [size[rows[0] == g][np.argsort(turn[rows[0] == g])].tolist() for g in range(len(made["side"]))]


@job()
def one_sided_carving(spark, sf_dir):
    """Cells that a front carves on its own, from inside and from outside, and those that got another sign."""

    def work(val, known, table):
        made = [whole_fronts.two_sides(val, known, BLOCK, table, s) for s in ("i", "o")]
        counts = {"carved": [(m["rank"] >= 0).sum(axis=1) for m in made], "turned": [(np.sign(val) != np.sign(m["new_val"])).sum(axis=1) for m in made]}
        return np.tile(np.arange(len(val)), 2), {"side": np.repeat([-1, 1], len(val))} | {k: np.concatenate(v) for k, v in counts.items()}

    return by_grid(spark, sf_dir, work, "side long, carved long, turned long")


@job()
def life_span_listing(spark, sf_dir):
    """Cells whose life span from inside is LONG or more, with the cell that they were queued by."""

    def work(val, known, table):
        made = whole_fronts.life_spans(val, known, BLOCK, table)
        grid, cell = np.nonzero(made["life"] >= LONG)
        return grid, {"id": cell, "life": made["life"][grid, cell], "parent": made["parent"][grid, cell]}

    return by_grid(spark, sf_dir, work, "id long, life long, parent long")


@job()
def carving_by_side(spark, sf_dir):
    """Critical cells of every grid by the outside rule: in the order of the values, and in the order of carving from outside with long-lived cells kept."""

    def work(val, known, table):
        spans = whole_fronts.life_spans(val, known, BLOCK, table, False, parents=False)
        carved = whole_fronts.life_spans(val, known, BLOCK, table, False, LONG, spans["life"], parents=False)
        return np.arange(len(val)), {"before": whole_fronts.criticals(whole_fronts.ranked(-val), BLOCK, table), "after": whole_fronts.criticals(carved["rank"], BLOCK, table)}

    return by_grid(spark, sf_dir, work, "before long, after long")
