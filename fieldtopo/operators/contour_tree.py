"""Contour trees out of join and split trees, and labels that an induced map puts on their edges.

Trees are rows (keys, node, join_up, split_down): the node's next cell in the rising and in the falling sweep, null at the last. A node's
lower degree in the contour tree is the number of its children in the join tree, its upper degree that in the split tree.
A node without lower edge and with one upper edge is a leaf from below: its edge goes to its join_up. It leaves both trees, in the
split tree its child goes on to its split_down. Leaves from above likewise.

`contour_edges` prunes in rounds, from below and from above in turn. A round takes every leaf with the whole chain over it, of nodes that
have one edge on either side: pointers down the chains are followed in steps that double, so are those past pruned nodes.
Once no volume has more than `most` nodes left, each one's rest is pruned leaf by leaf in a group of its own.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import OFFSETS_6, OFFSETS_26
from ..sources.shared import forget, written
from .trees import _edges

MOST = 1 << 17


def peel(up: list[int], down: list[int]) -> list[tuple[int, int]]:
    """Contour edges (lower, upper) of nodes 0 to n-1 from join_up and split_down (-1: none), leaf by leaf."""
    n = len(up)
    up, down = list(up), list(down)
    below: list[set[int]] = [set() for _ in range(n)]  # children in the join tree
    above: list[set[int]] = [set() for _ in range(n)]  # children in the split tree
    for i in range(n):
        if up[i] >= 0:
            below[up[i]].add(i)
        if down[i] >= 0:
            above[down[i]].add(i)
    leaf = lambda i: len(below[i]) + len(above[i]) == 1
    ready, gone, out = deque(i for i in range(n) if leaf(i)), [False] * n, []
    while ready:
        i = ready.popleft()
        if gone[i] or not leaf(i):
            continue
        gone[i] = True
        if not below[i]:
            own, other, mine, theirs, far = up, down, below, above, up[i]
            out.append((i, far))
        else:
            own, other, mine, theirs, far = down, up, above, below, down[i]
            out.append((far, i))
        mine[own[i]].discard(i)
        (child,) = theirs[i]
        other[child] = other[i]
        if other[i] >= 0:
            theirs[other[i]].discard(i)
            theirs[other[i]].add(child)
        if leaf(far):
            ready.append(far)
    return out


def _follow(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, at) with every pointer followed to the node that points to itself."""
    now, path = written(pointers.select(*keys, "node", "at"), "contour-pointers")
    while True:
        ahead = now.select(*keys, F.col("node").alias("at"), F.col("at").alias("beyond"))
        new, new_path = written(now.join(ahead, [*keys, "at"]).select(*keys, "node", F.col("beyond").alias("at"), (F.col("beyond") != F.col("at")).alias("moved")), "contour-pointers")
        forget(now, path)
        now, path = new.select(*keys, "node", "at"), new_path
        if not new.where("moved").limit(1).count():
            return now


def _round(now: DataFrame, keys: list[str], own: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Edges (keys, node, far) of the chains pruned from one side, and the trees that are left. own: the pointer that pruned nodes' edges follow."""
    n_own = now.where(F.col(own).isNotNull()).groupBy(*keys, F.col(own).alias("node")).agg(F.count("*").alias("n_own"), F.min("node").alias("child"))
    n_other = now.where(F.col(other).isNotNull()).groupBy(*keys, F.col(other).alias("node")).agg(F.count("*").alias("n_other"))
    seen = now.join(n_own, [*keys, "node"], "left").join(n_other, [*keys, "node"], "left").fillna(0, ["n_own", "n_other"])
    seen, path = written(seen, "contour-degrees")
    chain = (F.col("n_own") == 1) & (F.col("n_other") == 1)
    ends = _follow(seen.select(*keys, "node", F.when(chain, F.col("child")).otherwise(F.col("node")).alias("at")), keys)
    leaves = seen.where("n_own = 0 AND n_other = 1").select(*keys, F.col("node").alias("at"))
    pruned, pruned_at = written(ends.join(leaves, [*keys, "at"], "left_semi").select(*keys, "node", F.lit(True).alias("pruned")), "contour-pruned")
    marked = seen.join(pruned, [*keys, "node"], "left").select(*keys, "node", own, other, F.coalesce("pruned", F.lit(False)).alias("pruned"))
    marked, marked_at = written(marked, "contour-marked")
    edges, _ = written(marked.where("pruned").select(*keys, "node", F.col(own).alias("far")), "contour-edges")
    # Past pruned nodes: where a pointer to a pruned node ends. A pruned node that is the last of its sweep ends in itself.
    ways = _follow(marked.select(*keys, "node", F.when(F.col("pruned") & F.col(other).isNotNull(), F.col(other)).otherwise(F.col("node")).alias("at")), keys)
    gone = marked.where("pruned").select(*keys, F.col("node").alias("__to"), F.lit(True).alias("dead"))
    ways = ways.select(*keys, F.col("node").alias(other), F.col("at").alias("__to")).join(gone, [*keys, "__to"], "left")
    left = marked.where("not pruned").join(ways, [*keys, other], "left").select(*keys, "node", own, F.when(F.col("dead").isNull(), F.col("__to")).alias(other))
    left, _ = written(left, "contour-left")
    forget(now, path, pruned_at, marked_at)
    return edges, left


def contour_edges(trees: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """(keys, lower, upper): the augmented contour tree of every volume, from (keys, node, join_up, split_down)."""
    types = dict(trees.dtypes)
    now, _ = written(trees.select(*keys, "node", "join_up", "split_down"), "contour-left")
    found: list[DataFrame] = []
    while (now.groupBy(*keys).count().agg(F.max("count").alias("m")).first().m or 0) > most:
        low, now = _round(now, keys, "join_up", "split_down")
        high, now = _round(now, keys, "split_down", "join_up")
        found += [low.select(*keys, F.col("node").alias("lower"), F.col("far").alias("upper")), high.select(*keys, F.col("far").alias("lower"), F.col("node").alias("upper"))]
        if not low.limit(1).count() and not high.limit(1).count():
            raise ValueError("these trees are not a join tree and a split tree of one order")

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["node"].to_numpy(np.int64)
        place = {i: k for k, i in enumerate(ids.tolist())}
        at = lambda name: [-1 if v is None or v != v else place[int(v)] for v in pdf[name].astype(object).where(pdf[name].notna(), None)]
        edges = np.array(peel(at("join_up"), at("split_down")), np.int64).reshape(-1, 2)
        out = {k: [pdf[k].iloc[0]] * len(edges) for k in keys}
        return pd.DataFrame(out | {"lower": ids[edges[:, 0]], "upper": ids[edges[:, 1]]})

    schema = "".join(f"{k} {types[k]}, " for k in keys) + "lower long, upper long"
    out = now.groupBy(*keys).applyInPandas(rest, schema)
    for part in found:
        out = out.unionByName(part)
    return out


def group_edges(cells: DataFrame, keys: list[str], join_offsets=OFFSETS_26, split_offsets=OFFSETS_6) -> DataFrame:
    """(keys, lower, upper) of bounded groups (slices, pairs): both sweeps and the pruning in one group. cells: (keys, id, x, y, z, ord)."""
    types = dict(cells.dtypes)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        up = _edges(pdf, join_offsets)
        falling = pdf.iloc[::-1].reset_index(drop=True)
        down = _edges(falling.assign(ord=np.arange(len(pdf))), split_offsets)[::-1]
        last = len(pdf) - 1
        edges = np.array(peel(up.tolist(), [last - d if d >= 0 else -1 for d in down.tolist()]), np.int64).reshape(-1, 2)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(edges) for k in keys} | {"lower": ids[edges[:, 0]], "upper": ids[edges[:, 1]]})

    schema = "".join(f"{k} {types[k]}, " for k in keys) + "lower long, upper long"
    return cells.select(*dict.fromkeys([*keys, "id", "x", "y", "z", "ord"])).groupBy(*keys).applyInPandas(kernel, schema)


def induced_labels(edges: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lower, upper, label) of contour trees (keys, lower, upper) of bounded groups: how many contours of a part of the domain an
    edge takes up, from the part's trees (keys, lower, upper). The label is the sum, over all nodes on the edge's lower side, of upper less
    lower degrees in the part's trees: sums over subtrees once the tree is hung up by one node."""
    types = dict(edges.dtypes)
    ends = lambda end, sign: part.select(*keys, F.col(end).alias("node"), F.lit(sign).alias("d"))
    delta = ends("lower", 1).unionByName(ends("upper", -1)).groupBy(*keys, "node").agg(F.sum("d").alias("d"))

    def kernel(key: tuple, e: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate((e["lower"].to_numpy(np.int64), e["upper"].to_numpy(np.int64))))
        lower, upper = np.searchsorted(names, e["lower"]), np.searchsorted(names, e["upper"])
        near: list[list[tuple[int, int]]] = [[] for _ in names]
        for k, (a, b) in enumerate(zip(lower.tolist(), upper.tolist(), strict=True)):
            near[a].append((b, k))
            near[b].append((a, k))
        own = dict(zip(d["node"], d["d"], strict=True))
        sums = [int(own.get(i, 0)) for i in names.tolist()]
        by, order = [(-1, -1)] * len(names), []
        seen, stack = [False] * len(names), [0] if len(names) else []
        while stack:
            i = stack.pop()
            seen[i] = True
            order.append(i)
            for j, k in near[i]:
                if not seen[j]:
                    by[j] = (i, k)
                    stack.append(j)
        label = [0] * len(e)
        for i in reversed(order):
            to, k = by[i]
            if k >= 0:
                sums[to] += sums[i]
                label[k] = sums[i] if lower[k] == i else -sums[i]
        return pd.DataFrame({k: [v] * len(e) for k, v in zip(keys, key, strict=True)} | {"lower": e["lower"].to_numpy(), "upper": e["upper"].to_numpy(), "label": label})

    schema = "".join(f"{k} {types[k]}, " for k in keys) + "lower long, upper long, label long"
    return edges.groupBy(*keys).cogroup(delta.groupBy(*keys)).applyInPandas(kernel, schema)
