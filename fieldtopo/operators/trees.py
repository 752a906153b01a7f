"""Join and split trees of bounded groups (slices, windows), and the relations over their edges.

Union-find is sequential within a group, so it is a grouped kernel; the group is a slice or a window, whose size does not grow
with the data. Everything over the finished edges is declarative.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import OFFSETS_26


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _edges(pdf: pd.DataFrame, offsets: list[tuple[int, int, int]]) -> np.ndarray:
    """Upper node of every cell in sweep order (-1 at the end of the sweep): the cell that next touches its component."""
    pdf = pdf.sort_values("ord")
    place = {c: i for i, c in enumerate(zip(pdf["x"], pdf["y"], pdf["z"], strict=True))}
    root, upper = np.arange(len(pdf)), np.full(len(pdf), -1, np.int64)
    for (x, y, z), i in place.items():
        for dx, dy, dz in offsets:
            j = place.get((x + dx, y + dy, z + dz))
            if j is not None and j < i:
                r = _find(root, j)
                if r != i:
                    upper[r] = i
                    root[r] = i
    return upper


def sweep_tree(cells: DataFrame, keys: list[str], offsets=OFFSETS_26) -> DataFrame:
    """(keys, node, upper) of the augmented tree of each group, from cells (keys, id, x, y, z, ord).

    Rising `ord` with vertex neighbours gives the join tree; the reversed order with face neighbours the split tree. The last
    cell of a component has a null upper node."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        upper = _edges(pdf, offsets)
        ids = pdf["id"].to_numpy()
        out = pd.DataFrame({k: pdf[k] for k in keys} | {"node": ids})
        out["upper"] = pd.array(np.where(upper < 0, 0, ids[np.maximum(upper, 0)]), "Int64")
        out.loc[upper < 0, "upper"] = pd.NA
        return out

    types = dict(cells.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "node long", "upper long"])
    return cells.select(*dict.fromkeys([*keys, "id", "x", "y", "z", "ord"])).groupBy(*keys).applyInPandas(kernel, schema)


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, down, up): children below and 0 or 1 upper node."""
    down = edges.where("upper is not null").groupBy(*keys, F.col("upper").alias("node")).agg(F.count("*").alias("down"))
    return edges.join(down, [*keys, "node"], "left").select(*keys, "node", F.coalesce("down", F.lit(0)).cast("long").alias("down"), F.col("upper").isNotNull().cast("long").alias("up"))


def subtree_sums(nodes: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """(keys, node, terms) with every term summed over the node and all below it, from (keys, node, upper, terms).

    Children are done before their parents, each node once, so a group takes linear time."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        place = {n: i for i, n in enumerate(pdf["node"])}
        up = [-1 if u is None or u is pd.NA or u != u else place[int(u)] for u in pdf["upper"]]
        left, sums = [0] * len(up), pdf[terms].to_numpy(np.int64).copy()
        for u in up:
            if u >= 0:
                left[u] += 1
        ready = [i for i, n in enumerate(left) if not n]
        while ready:
            i = ready.pop()
            u = up[i]
            if u >= 0:
                sums[u] += sums[i]
                left[u] -= 1
                if not left[u]:
                    ready.append(u)
        return pd.concat([pdf[[*keys, "node"]].reset_index(drop=True), pd.DataFrame(sums, columns=terms)], axis=1)

    types = dict(nodes.dtypes)
    return nodes.groupBy(*keys).applyInPandas(kernel, ", ".join([*(f"{k} {types[k]}" for k in keys), "node long", *(f"{t} long" for t in terms)]))


def contracted(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, upper) with only leaves, merges and roots: each kept node's upper is its next kept ancestor."""
    deg = degrees(edges, keys)
    kept = deg.where((F.col("down") != 1) | (F.col("up") == 0)).select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("node").alias("kept"))
    types = dict(edges.dtypes)

    def kernel(key: tuple, pdf: pd.DataFrame, keep: pd.DataFrame) -> pd.DataFrame:
        up, stay = dict(zip(pdf["node"], pdf["upper"], strict=True)), set(keep["kept"])
        rows = []
        for n in sorted(stay):
            a = up.get(n)
            while a == a and a is not None and a is not pd.NA and int(a) not in stay:
                a = up.get(int(a))
            rows.append((n, None if a is None or a is pd.NA or a != a else int(a)))
        out = pd.DataFrame({k: [v] * len(rows) for k, v in zip(keys, key, strict=True)})
        out["node"] = [r[0] for r in rows]
        out["upper"] = pd.array([r[1] for r in rows], "Int64")
        return out

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "node long", "upper long"])
    return edges.groupBy(*keys).cogroup(kept.groupBy(*[f"{k}_" for k in keys])).applyInPandas(kernel, schema)


def indented(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, depth, node) of trees (keys, node, upper): every tree from its root down, children in order of their ids, one line each."""
    types = dict(edges.dtypes)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        below: dict[int | None, list[int]] = {}
        for n, u in zip(pdf["node"].tolist(), pdf["upper"].astype(object).where(pdf["upper"].notna(), None), strict=True):
            below.setdefault(None if u is None else int(u), []).append(n)
        rows, stack = [], [(0, n) for n in sorted(below.get(None, []), reverse=True)]
        while stack:
            depth, n = stack.pop()
            rows.append((len(rows), depth, n))
            stack += [(depth + 1, c) for c in sorted(below.get(n, []), reverse=True)]
        out = pd.DataFrame(rows, columns=["line", "depth", "node"])
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(out) for k in keys} | {c: out[c] for c in out})

    return edges.groupBy(*keys).applyInPandas(kernel, "".join(f"{k} {types[k]}, " for k in keys) + "line long, depth long, node long")
