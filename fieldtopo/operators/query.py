"""The contour query algebra: selections over the components that a cut leaves in each window of slices.

A window is a run of consecutive slices. Its components at an isovalue are the maximal sets of cells at or below it that are
joined by vertex neighbours within the window; a component is named by its last cell in the filtration, the node of the window's
join tree at the cut. Selections are plain filters over the relation that `window_components` returns, and chain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import OFFSETS_26, closed, euler, wide
from . import stencil
from .trees import _find

FIRST_SLICE, LAST_SLICE = (1 << 9) - 1, ((1 << 9) - 1) << 17


def windows(cells: DataFrame, length: int, step: int, n_slices: int) -> DataFrame:
    """cells once for each window that holds them: window_id, first and last slice. Windows start at 0, step, 2 step, ..."""
    last = (n_slices - length) // step
    ids = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("z") - length + 1) / step).cast("int")), F.least(F.lit(last), F.floor(F.col("z") / step).cast("int")))
    out = cells.where((F.ceil((F.col("z") - length + 1) / step) <= last) & (F.col("z") <= last * step + length - 1)).withColumn("window_id", F.explode(ids))
    return out.withColumn("first", F.col("window_id") * step).withColumn("last", F.col("window_id") * step + length - 1)


def link_terms(cells: DataFrame, order: str = "ord") -> DataFrame:
    """cells with `mask`, their 26-bit lower link in the whole grid."""
    return stencil.block(cells, order).withColumn("mask", stencil.lower_mask(order)).drop("around")


def within_window(mask: Column) -> Column:
    """The mask without neighbours outside the window."""
    mask = F.when(F.col("z") == F.col("first"), mask.bitwiseAND(F.lit(~FIRST_SLICE))).otherwise(mask)
    return F.when(F.col("z") == F.col("last"), mask.bitwiseAND(F.lit(~LAST_SLICE))).otherwise(mask)


def window_components(cells: DataFrame, iso: int, length: int, step: int, n_slices: int) -> DataFrame:
    """window_id, node, n_cells, n_minima, left_overlap, right_overlap, chi of each component at the cut.

    left_overlap and right_overlap count the slice components (8 neighbours) that the component has in the window's first and
    last slice; chi sums 1 - chi(lower link) over its cells.
    """
    linked = link_terms(cells)
    inside = windows(linked, length, step, n_slices).where(F.col("val") <= iso)
    own = within_window(F.col("mask"))
    rows = inside.select("window_id", "id", "x", "y", "z", "ord", (F.col("z") == F.col("first")).alias("on_first"), (F.col("z") == F.col("last")).alias("on_last"), (1 - euler(closed(wide(own)))).alias("term"), (own == 0).alias("minimum"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        place = {c: i for i, c in enumerate(zip(pdf["x"], pdf["y"], pdf["z"], strict=True))}

        def joined(offsets) -> np.ndarray:
            root = np.arange(len(pdf))
            for (x, y, z), i in place.items():
                for dx, dy, dz in offsets:
                    j = place.get((x + dx, y + dy, z + dz))
                    if j is not None and j < i:
                        root[_find(root, j)] = i
            return np.array([_find(root, i) for i in range(len(root))])

        whole, flat = joined(OFFSETS_26), joined([o for o in OFFSETS_26 if o[2] == 0])
        pdf = pdf.assign(node=pdf["id"].to_numpy()[whole], flat=flat)
        out = pdf.groupby("node", as_index=False).agg(n_cells=("id", "size"), n_minima=("minimum", "sum"), chi=("term", "sum"))
        for name, on in (("left_overlap", "on_first"), ("right_overlap", "on_last")):
            n = pdf[pdf[on]].groupby("node")["flat"].nunique()
            out[name] = out["node"].map(n).fillna(0).astype("int64")
        out["window_id"] = pdf["window_id"].iloc[0]
        return out[["window_id", "node", "n_cells", "n_minima", "left_overlap", "right_overlap", "chi"]]

    return rows.groupBy("window_id").applyInPandas(kernel, "window_id int, node long, n_cells long, n_minima long, left_overlap long, right_overlap long, chi long")


def overlaps_between(low: int, high: int) -> Column:
    return F.col("left_overlap").between(low, high) & F.col("right_overlap").between(low, high)


def at_most_minima(most: int) -> Column:
    return F.col("n_minima") <= most


def chi_between(low: int, high: int) -> Column:
    return F.col("chi").between(low, high)


def in_interior(length: int, step: int, slice_size: int) -> Column:
    """The component's last cell lies strictly inside the window."""
    z = F.floor(F.col("node") / slice_size)
    return (z > F.col("window_id") * step) & (z < F.col("window_id") * step + length - 1)
